"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often the mix takes it. Of all rates that meet the token
constraints, the ones nearest to 1 in relative entropy (weighted by tokens) are wanted. The
constraints: the tokens of each source sum to its target; no rate exceeds `cap`; and, as a
soft constraint with a quadratic penalty, each class of the `keep` column (the language)
holds the share of tokens that it has in the corpus, so that moving weight between sources
doesn't move the languages with it. The convex dual has a variable for every source and every
class, and its solution is an exponential tilt: rate = min(cap, exp(source + class)).

The dual is solved by Newton steps in turn on the two blocks of variables; within a block the
Hessian is diagonal, so no matrix is needed, however many sources there are, and a round is
one distributed aggregation. Documents of one source and class have the same tilt, so the
iterations run on their token sums.

Rates become whole copies by systematic rounding along the documents of a source in the order
of size, with exact integer running sums: the copies of every stretch stay within one of its
rates. Repeated rows are one document with as many rates; its copies are shared out among them, so
theirs differ by one at most. What is still off the target is made up by single copies of single
documents, more or less.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, columns_of_row, cut, repeated, text_of, whole_row

GRID = 1 << 20  # rates are whole multiples of 1 / GRID
SALTS = 64
CLASSES = 1024  # values of keep_col at most


def word_count(text_col: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; 0 for a null text."""
    return F.regexp_count(text_of(text_col), F.lit(WORD_REGEX)).cast("long")


def _places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `place`, 0, 1, ... in an order; no task sorts them all."""
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1))
    start, starts = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        starts += [F.lit(r["part"]), F.lit(start)]
        start += r["n"]
    return dealt.withColumn("place", F.col("place") + (F.element_at(F.create_map(*starts), F.col("part")) if starts else F.lit(0))).drop("part")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """`sources` (source, source_size) with target.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes.
    A target stops at cap times the source's size; the excess is shared again by weight. That
    is min(cap * size, level * weight) for one level. It is found from below: each round is one
    aggregation, in which the sources that the last level fills pass on what they can't take. There
    may be any number of sources.
    """
    placed = _places(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.lit([float(w) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = cut(placed.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    level, full = 0.0, -1
    while True:
        fills = F.col("most") < level * F.col("weight")
        r = rows.agg(F.count_if(fills).alias("full"), F.sum("source_size").alias("all"), F.sum(F.when(fills, F.col("most"))).alias("took"), F.sum(F.when(~fills, F.col("weight"))).alias("open")).first()
        if r["full"] <= full or not r["open"]:
            break
        level, full = (float(r["all"]) - float(r["took"] or 0.0)) / float(r["open"]), r["full"]
    return rows.select("source", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def _level(target: float, mass: np.ndarray, tilt: np.ndarray, cap: float) -> float:
    """x for which sum(mass * min(x * tilt, cap)) is the target: exact Newton steps on its dual variable.

    The sum is piecewise linear and concave in x, so steps from below never overshoot, and
    there are as many pieces as classes.
    """
    x = 0.0
    for _ in range(len(mass) + 2):
        free = x * tilt < cap * (1 - 1e-12)
        slope = float((mass * tilt)[free].sum())
        left = target - float((mass * np.minimum(x * tilt, cap)).sum())
        if slope <= 0 or left <= 1e-12 * max(1.0, target):
            break
        x += left / slope
    return x


def tilts(cells: DataFrame, targets: DataFrame, cap: float, keep_weight: float, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(source, class, rate) from (source, class, tokens) and (source, target).

    All keys are non-null strings. keep_weight 0 leaves the classes free. There are at most
    CLASSES classes, so their dual variables are on the driver; those of the sources never
    are. Each Newton step on the classes is one distributed aggregation: every source solves
    its own constraint under the classes' tilts, and what it takes of each class is summed. Steps
    end when none moves a class by more than `tolerance`; after `rounds` of them, a warning says
    how far the last one went. (The sources' constraints hold in any case.)
    """
    cells = cut(cells.join(targets, "source"))
    shares = {r["class"]: float(r["share"] or 0) for r in cells.groupBy("class").agg(F.sum("tokens").alias("share")).limit(CLASSES + 1).collect()}
    if len(shares) > CLASSES:
        raise ValueError(f"there are more than {CLASSES} classes")
    mu = dict.fromkeys(shares, 0.0)

    def rates(pdf: pd.DataFrame, mu: dict[str, float]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("class", kind="stable")
        mass, tilt = pdf["tokens"].to_numpy(float), np.exp([mu[c] for c in pdf["class"]])
        x = _level(float(pdf["target"].iloc[0]), mass, tilt, cap) if mass.sum() > 0 else 1.0
        return pdf, mass, x * tilt

    def taken(mu: dict[str, float]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, mass, rate = rates(pdf, mu)
            return pd.DataFrame({"class": pdf["class"], "got": mass * np.minimum(rate, cap), "curve": np.where(rate < cap, mass * rate, 0.0)})

        return run

    moved = 0.0
    for _ in range(rounds if keep_weight > 0 else 0):
        got = cells.groupBy("source").applyInPandas(taken(dict(mu)), "class string, got double, curve double").groupBy("class").agg(F.sum("got").alias("got"), F.sum("curve").alias("curve")).collect()
        moved = 0.0
        for r in got:
            share = shares[r["class"]]
            stiff = keep_weight * share
            step = (share - r["got"] - stiff * mu[r["class"]]) / max(r["curve"] + stiff, 1e-9)
            step = max(-1.0, min(1.0, step))
            mu[r["class"]] += step
            moved = max(moved, abs(step))
        if moved < tolerance:
            break
    if moved >= tolerance:
        warnings.warn(f"the classes' tilts still moved by {moved:.2g} after {rounds} rounds", stacklevel=2)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, rate = rates(pdf, mu)
        return pd.DataFrame({"source": pdf["source"], "class": pdf["class"], "rate": np.minimum(rate, cap)})

    return cells.groupBy("source").applyInPandas(final, "source string, class string, rate double")


def _make_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Single copies, one more or one less, that bring one source nearer to its target.

    In each step the one change, or the two, that leave the least are made, until nothing is
    gained; a document changes by one copy at most.
    """
    rows = pdf.sort_values(["size", "sign", "digest", "band", "salt", "place"], kind="stable")
    left, keys = float(rows["left"].iloc[0]), rows[["source", "band", "salt", "place"]].to_numpy()
    moves, sign = (rows["size"] * rows["sign"]).to_numpy(np.int64), rows["sign"].to_numpy()
    open_, out = np.ones(len(rows), bool), []
    while True:  # each step leaves less, and takes a row away
        at = np.flatnonzero(open_)
        at = at[np.argsort(moves[at], kind="stable")]
        v = moves[at]
        if not len(v):
            break
        one = int(np.abs(v - left).argmin())
        partner = np.minimum(np.searchsorted(v, left - v), len(v) - 1)
        below = np.maximum(partner - 1, 0)
        partner = np.where(np.abs(left - v - v[below]) <= np.abs(left - v - v[partner]), below, partner)
        miss = np.where(partner == np.arange(len(v)), np.inf, np.abs(left - v - v[partner]))
        two = int(miss.argmin())
        best = [one] if abs(left - v[one]) <= miss[two] else [two, int(partner[two])]
        if abs(left - v[best].sum()) >= abs(left) - 1e-9:
            break
        left -= float(v[best].sum())
        for k in at[best]:
            out.append((*keys[k], int(sign[k])))
            open_ &= ~(keys[:, 1:] == keys[k, 1:]).all(axis=1)
    return pd.DataFrame(out, columns=["source", "band", "salt", "place", "more"])


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))


def _keys(id_col: str, text_col: str, source_col: str, keep_col: str | None) -> list[Column]:
    """What tells documents apart: (id, text_hash, source, class)."""
    return [F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), _key(F.col(source_col)).alias("source"), (_key(F.col(keep_col)) if keep_col else F.lit("n")).alias("class")]


KEYS = ["id", "text_hash", "source", "class"]


def _plan(docs: DataFrame, weights: tuple[float, ...], cap: int, keep_col: str | None, keep_weight: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A row for all rows of an id, text, source and class, `times` of them: (KEYS, size, times, source_size, target, rate, total).

    total: the copies of all of them together, `cap` for each at most.
    """
    rows = docs.select(*_keys(id_col, text_col, source_col, keep_col), word_count(text_col).alias("size"))
    units = cut(rows.groupBy(*KEYS, "size").agg(F.count("*").alias("times")))
    mass = F.col("size") * F.col("times")
    cells = units.groupBy("source", "class").agg(F.sum(mass).alias("tokens"))
    sizes = units.groupBy("source").agg(F.sum(mass).alias("source_size"))
    named = sizes.withColumn("source", F.when(F.col("source") != "n", F.substr(F.col("source"), F.lit(2))))
    targets = cut(source_targets(named, weights, float(cap)).withColumn("source", _key(F.col("source"))))
    rates = tilts(cells, targets.select("source", "target"), float(cap), keep_weight if keep_col else 0.0)
    rates = cut(rates.withColumn("grid", F.round(F.col("rate") * GRID).cast("long")).drop("rate"))

    digest = F.xxhash64(F.col("id").cast("string"), F.col("text_hash"))
    band = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8)).otherwise(-1).cast("int")
    own = units.join(rates, ["source", "class"])
    own = own.withColumns({"digest": digest, "band": band, "grid": F.col("grid") * F.col("times")}).withColumn("salt", F.pmod("digest", F.lit(SALTS)).cast("int"))
    own = cut(own)
    # running sums of rates: of whole (band, salt) groups first, then within one
    sums = own.groupBy("source", "band", "salt").agg(F.sum("grid").alias("in_group"))
    before = F.sum("in_group").over(Window.partitionBy("source").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_group")
    starts = sums.select("source", "band", "salt", before.alias("before"))
    line = Window.partitionBy("source", "band", "salt").orderBy("size", "digest", "id", "text_hash", "class")
    upto = F.col("before") + F.sum("grid").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + GRID // 2
    placed = own.join(starts, ["source", "band", "salt"]).withColumns({"upto": upto, "place": F.row_number().over(line)})
    copies = F.shiftright("upto", 20) - F.shiftright(F.col("upto") - F.col("grid"), 20)
    most = F.col("times") * cap
    placed = cut(placed.withColumn("total", F.when(F.col("size") > 0, F.least(copies, most)).otherwise(F.col("times"))).drop("upto", "before", "grid"))

    left = targets.join(placed.groupBy("source").agg(F.sum(F.col("total") * F.col("size")).alias("got")), "source").select("source", (F.col("target") - F.col("got")).alias("left"))
    one = F.struct("digest", "place", "size")
    ready = placed.filter("size > 0").groupBy("source", "band", "salt").agg(F.min(F.when(F.col("total") < most, one)).alias("add"), F.min(F.when(F.col("total") > 0, one)).alias("sub"))
    single = ready.select("source", "band", "salt", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("add").alias("d")), F.struct(F.lit(-1).alias("sign"), F.col("sub").alias("d")))).alias("c"))
    single = single.filter("c.d is not null").select("source", "band", "salt", "c.sign", "c.d.digest", "c.d.place", "c.d.size").join(left, "source")
    # at most bands x SALTS x 2 rows of a source, whatever its size
    made_up = single.groupBy("source").applyInPandas(_make_up, "source string, band int, salt int, place int, more int")
    done = placed.join(made_up, ["source", "band", "salt", "place"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0)))
    out = done.join(targets, "source").join(rates.withColumn("rate", F.col("grid") / GRID), ["source", "class"])
    return out.select(*KEYS, "size", "times", "source_size", "target", "rate", "total")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, keep_col: str | None = "lang", keep_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, text_hash, size, source, class, source_size, target, rate, copies, taken) of every document.

    taken = copies * size, with at most `cap` copies. Nulls: a null text has no words; a null
    source or class is one of its own; a null id is an id. Copies of repeated rows (equal id, text,
    source and class) differ by one at most. A source without words has target 0, and its
    documents one copy each. Texts are counted whole, however long. An empty table gives an empty
    result; other columns are ignored. More than CLASSES values of keep_col are an error.
    """
    rows = repeated(_plan(docs, weights, cap, keep_col, keep_weight, id_col, text_col, source_col), "times", "copy")
    copies = F.expr("total div times") + (F.col("copy") <= F.col("total") % F.col("times")).cast("long")
    rows = rows.withColumn("copies", copies.cast("int"))
    return rows.select("id", "text_hash", "size", "source", "class", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    keep_col: str | None = "lang",
    keep_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """`docs` as the mix takes them: every row as often as it has copies, some not at all.

    Rows are those of mix(): told apart by id, text, source and class, so one id may stand for
    several texts or sources. Of rows that are alike in these, the first in the order of all columns
    are taken once more where copies differ. Nulls are as in mix(); texts without words stay
    once; an empty table gives an empty result; all columns stay, whatever their names.
    """
    plan = cut(_plan(docs, weights, cap, keep_col, keep_weight, id_col, text_col, source_col).select(*KEYS, F.expr("total div times").alias("each"), F.expr("total % times").alias("more")))
    own = docs.select(whole_row(docs), *_keys(id_col, text_col, source_col, keep_col)).alias("own")
    like = lambda part: own.join(part.alias("plan"), [F.col(f"own.{k}").eqNullSafe(F.col(f"plan.{k}")) for k in KEYS])
    even = like(plan.filter("more = 0 and each > 0"))
    taken = even.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "each")).alias("copy")).select(*columns_of_row(docs))
    uneven = plan.filter("more > 0")
    if uneven.isEmpty():
        return taken
    # equal rows are counted; different ones of a key are dealt over salts, and get their part of `more` by running sums
    rows = like(uneven).select(*[F.col(f"own.{k}").alias(k) for k in KEYS], "row", "each", "more", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    rows = cut(rows.groupBy(*KEYS, "salt", "row", "each", "more").agg(F.count("*").alias("n")))
    sums = rows.groupBy(*KEYS, "salt").agg(F.sum("n").alias("in_salt"))
    running = lambda by, order, c: F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    starts = sums.withColumn("before", running(KEYS, "salt", "in_salt")).alias("starts")
    met = rows.withColumn("within", running([*KEYS, "salt"], "row", "n")).alias("rows")
    met = met.join(starts, [F.col(f"rows.{k}").eqNullSafe(F.col(f"starts.{k}")) for k in [*KEYS, "salt"]])
    extra = F.least(F.greatest(F.col("more") - F.col("before") - F.col("within"), F.lit(0)), F.col("n"))
    met = met.select("row", (F.col("n") * F.col("each") + extra).alias("total")).filter("total > 0")
    return taken.unionByName(repeated(met, "total", "copy").select(*columns_of_row(docs)))
