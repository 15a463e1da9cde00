"""Secret scans with fixed patterns and character Markov models, in Spark expressions only.

Three patterns give the base spans (see KINDS). Beside them, every run of 20 or more
characters of the kind that keys are written in is scored with two character Markov models:
the log-likelihood of its character pairs under a model of random strings, less that under a
model of ordinary identifiers, per pair. Runs above the threshold are spans of kind `random`.
A unit that repeats at once counts once, and a run that has fewer than 20 characters then, or
fewer different ones than a key would, is ordinary: pairs alone don't tell a periodic run, or one
of few letters, from a random one.

Both models are counts of character pairs in labelled samples: random strings are digests
written in the usual alphabets, ordinary ones are runs of the corpus
as they stand, its words joined as identifiers are, and numbers, dates and rules. A model is a table of (number of characters)^2 figures, so it goes into the
plan as a literal. Nothing here runs Python on the executors.

Spark has no function that gives the places of all matches. They follow from splitting the
text at the matches: the pieces between, and the matches, alternate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of_row, cut, text_of, whole_row

#: Fixed patterns of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more: a run that is too short holds no longer one
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 or more, for the same reason
KINDS = ("assign", "access", "hex", "random")

#: What a key may be written in; runs of it are candidates. Others than these end a run.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
LEAST_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: A unit of up to 16 characters, repeated at once so often that chance doesn't explain it in any alphabet of keys.
REPEATED = r"(.)\1{7,}|(..)\2{3,}|(.{3,16}?)\3{2,}"
#: Different characters that a key has at least: of 20 hexadecimal digits, one run in some 50,000 has fewer.
LEAST_MARKS = 7

SMOOTH = 20.0  # pairs that a prior distribution counts as
SPAN = "struct<start:int,kind:int,end:int>"
LEAST_PRIOR = 0.1  # a prior distribution's least part: the samples don't hold every word
BLOCK = 4096  # code points of a text that are cut at once


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walk(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """What a walk along an array gives: an array of type `kind`.

    step(state, item) is (next state, whether the item gives something, what). Appending to an
    array copies it, so items are walked in blocks of about the root of their number: n items
    take n * sqrt(n) copied places rather than n * n.
    """

    def block(state: Column, own: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            state, gives, what = step(acc["state"], item)
            return F.struct(state.alias("state"), F.when(gives, F.concat(acc["out"], F.array(what))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(own, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def blocks(items: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(items).cast("double")))).cast("int")
        first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        step_on = lambda acc, k: _let(block(acc["state"], F.slice(items, k * size + 1, size)), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), first, step_on, lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(items) > 0, _let(items, blocks)).otherwise(F.array().cast(f"array<{kind}>"))


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """[(start, kind, end)] of the leftmost matches that don't overlap, in code points.

    Matches whose group `value_group` has fewer than `least` characters are dropped, and those
    for which keep(match) doesn't hold. Texts without a match are read once only.
    """
    found = lambda group, f: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), f)
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    here = found(value_group, lambda m: (F.char_length(m) >= least) & (keep(m) if keep else F.lit(True)))
    steps = F.arrays_zip(gaps.alias("gap"), found(0, lambda m: F.char_length(m)).alias("m"), here.alias("keep"))

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        end = at + s["gap"] + F.coalesce(s["m"], F.lit(0))
        # the last gap has no match after it
        return end, s["m"].isNotNull() & s["keep"], F.struct((at + s["gap"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    return F.when(F.rlike(text, F.lit(pattern)), _walk(steps, F.lit(0), SPAN, step)).otherwise(F.array().cast(f"array<{SPAN}>"))


@dataclass
class Markov:
    """For each pair of ALPHABET's characters, the log ratio of random to ordinary; fixed size."""

    log_ratio: list[float]
    threshold: float


def _pair_counts(samples: DataFrame) -> dict[tuple[int, str], int]:
    """Pairs of neighbouring ALPHABET characters in (label, text): (label, pair) to count, (number of characters)^2 of each label at most."""
    pairs = samples.select("label", F.explode(F.regexp_extract_all("text", F.lit(r"(?=([A-Za-z0-9+/_=-]{2}))"), F.lit(1))).alias("pair"))
    return {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}


def rule_counts(words: int, rules: int) -> dict[str, int]:
    """Pairs in rules, which nobody needs to write out: of each two of five marks in turn, and of each other character alone.

    There are `rules` of each kind, with as many repeats as `words` in all.
    """
    marks, out = "+/_-=", {}
    for a in marks:
        for b in marks:
            # a rule of n times ab has n pairs ab, and n - 1 pairs ba between them
            out[a + b] = out.get(a + b, 0) + words
            out[b + a] = out.get(b + a, 0) + words - rules
    return out | {c + c: words - rules for c in ALPHABET if c not in marks}


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """n random strings labelled 1: digests in hexadecimal, both kinds of base64, letters and digits, and capitals."""
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    letters = F.translate(base64, "+/", "xQ")
    kinds = F.array(F.substring(digest, 1, 40), base64, F.upper(letters), letters, F.translate(base64, "+/", "-_"))
    text = F.get(kinds, F.col("id").cast("int") % 5)
    return spark.range(n).select(F.lit(1).alias("label"), text.alias("text"))


def ordinary_samples(docs: DataFrame, text_col: str, key_col: str, n: int, per_document: int = 200) -> tuple[DataFrame, DataFrame]:
    """Ordinary runs of about n documents labelled 0; and (words), how many of each are used.

    The documents are drawn by a hash of the key. Each gives its own runs of ALPHABET, without
    what the fixed patterns match; its words, joined as identifiers are; and for as many words,
    numbers and dates, alone and in names. Of a document with more runs or words, about
    `per_document` of each are drawn by a hash. Rules, as long as there are words, are counted by
    rule_counts().
    """
    total = F.lit(max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.lit("secrets")), F.lit(1 << 30)) / (1 << 30)
    some_of = lambda every: F.filter(every, lambda x, k: F.pmod(F.xxhash64(x, k), F.greatest(F.size(every), F.lit(per_document))) < per_document)
    found = lambda text, pattern: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some_of)
    text = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    rows = docs.select(text_of(text_col).alias("text"), draw.alias("draw")).filter(F.col("draw") < F.lit(n) / total)
    rows = rows.select(found(F.col("text"), r"\b[A-Za-z]{2,}\b").alias("w"), found(text, r"[A-Za-z0-9+/_=-]{2,}").alias("own"))
    some = lambda x, k, salt, m: F.pmod(F.xxhash64(x, k, F.lit(salt)), F.lit(m))
    day = lambda x, k: F.date_add(F.lit("1990-01-01").cast("date"), some(x, k, "day", 20_000).cast("int"))
    number = lambda x, k: F.lpad(some(x, k, "number", 10**9).cast("string"), 9, "0")
    date = lambda mark: lambda x, k: F.date_format(day(x, k), f"yyyy{mark}MM{mark}dd")
    dated = lambda mark: lambda x, k: F.concat(F.lower(x), F.lit(mark), F.date_format(day(x, k), "yyyyMMdd"), F.lit(mark), F.substring(number(x, k), 1, 6))
    joined = F.array(
        F.array_join("w", "_"),
        F.array_join("w", "-"),
        F.array_join("w", "/"),
        F.array_join(F.transform("w", lambda s: F.lower(s)), ""),
        F.array_join(F.transform("w", lambda s: F.initcap(s)), ""),
        F.upper(F.array_join("w", "_")),
        F.array_join(F.transform("w", number), ""),
        *[F.array_join(F.transform("w", date(m)), m) for m in "-/_"],
        *[F.array_join(F.transform("w", dated(m)), m) for m in "-/_"],
    )
    rows = cut(rows)  # some hundreds
    return rows.select(F.lit(0).alias("label"), F.explode(F.concat("own", joined)).alias("text")), rows.select(F.size("w").alias("words"))


def fit(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", n: int = 300, threshold: float = 0.6) -> Markov:
    """Count the labelled samples (20 n digests, and ordinary runs of about n documents).

    The samples are bounded by n; the driver gets len(ALPHABET)^2 counts of each label. Both
    models are mixed with one of the kinds of characters (small, capital, digit, or the mark
    itself), and that with an even one, each by the same share for both labels, which falls with the
    number of pairs that the rarer of both has seen of a character.
    threshold: mean log ratio of a pair from which a run counts as random.
    """
    import math

    ordinary, words = ordinary_samples(docs, text_col, key_col, n)
    size = len(ALPHABET)
    counts = [[0] * (size * size) for _ in range(2)]
    told = words.filter("words > 0").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    for own in (_pair_counts(random_samples(docs.sparkSession, 20 * n).union(ordinary)), {(0, pair): n for pair, n in rule_counts(told["words"], told["n"]).items()}):
        for (label, pair), n in own.items():
            counts[label][ALPHABET.index(pair[0]) * size + ALPHABET.index(pair[1])] += n
    kinds = ["lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else c for c in ALPHABET]
    few, ratio = [{}, {}], []  # pairs of kinds of characters
    for own, c in zip(few, counts):
        for k, n in enumerate(c):
            pair = kinds[k // size], kinds[k % size]
            own[pair] = own.get(pair, 0) + n
    for a in range(size):
        rows = [c[a * size : (a + 1) * size] for c in counts]
        rough = [[own[kinds[a], k] / kinds.count(k) for k in kinds] for own in few]
        even = [1 / size] * size
        p, q = _mixed(rows, _mixed(rough, [even, even]))[::-1]
        ratio += [round(math.log(x / y), 4) for x, y in zip(p, q)]
    return Markov(ratio, threshold)


def _mixed(rows: list[list[float]], prior: list[list[float]]) -> list[list[float]]:
    """Both labels' counts as shares, mixed with prior ones; the prior's part is the same for both."""
    part = max(LEAST_PRIOR, SMOOTH / (SMOOTH + min(map(sum, rows))))
    return [[(1 - part) * n / (sum(row) or 1) + part * x for n, x in zip(row, own)] for row, own in zip(rows, prior)]


def log_ratio(run: Column, model: Markov) -> Column:
    """Mean log-likelihood ratio of a run's character pairs."""
    size = len(ALPHABET)
    table = F.lit(model.log_ratio)
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(
        at,
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when((acc["last"] > 0) & (c > 0), F.element_at(table, (acc["last"] - 1) * size + c)).otherwise(F.lit(0.0))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.char_length(run) - 1, F.lit(1))


def is_random(run: Column, model: Markov) -> Column:
    """Whether a run, its repeated units written once, is long and varied enough for a key, and random to the models."""

    def told(once: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(once, ""))) >= LEAST_MARKS
        return (F.char_length(once) >= LEAST_RUN) & varied & (log_ratio(once, model) >= model.threshold)

    return _let(F.regexp_replace(run, REPEATED, "$1$2$3"), told)


def random_spans(text: Column, model: Markov) -> Column:
    """Spans of runs that the models find random."""
    return spans(text, RUN, 3, keep=lambda run: is_random(run, model))


def scan(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, random): the spans of each kind, of every whole text.

    A span is (start, kind, end) in code points, end exclusive; kind is its place in KINDS. A
    null or empty text has none. A `random` span may cover base spans; base spans always
    stay. Repeated rows give repeated rows; an empty table an empty result; other columns
    are ignored.
    """
    # inline keeps the optimizer from repeating the spans wherever they are used
    return docs.select(F.col(id_col).alias("id"), F.inline(F.array(F.struct(*columns(text_of(text_col), model)))))


def columns(text: Column, model: Markov) -> list[Column]:
    """The four span columns of a text column."""
    return [
        spans(text, ASSIGN, 0, 2, 8).alias("assign"),
        spans(text, ACCESS, 1).alias("access"),
        spans(text, HEX, 2).alias("hex"),
        random_spans(text, model).alias("random"),
    ]


def listed(found: Column) -> Column:
    """kind:start:end of spans, by start, then kind, joined by commas."""
    kinds = F.lit(list(KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is given in blocks of BLOCK."""
    a, b = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    within = F.substring(block(a), start - a * BLOCK + 1, end - start)
    across = F.concat(F.substring(block(a), start - a * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(block(b), F.lit(1), end - b * BLOCK))
    return F.when(a == b, within).otherwise(across)


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by a mark.

    The text between spans is cut from blocks, as a cut reads from the beginning of its string.
    """

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["end"]), s["start"] >= at, F.struct(at.alias("start"), F.lit(0).alias("kind"), s["start"].alias("end"))

    gaps = _walk(F.array_sort(found), F.lit(0), SPAN, step)
    cut = lambda blocks: F.array_join(F.transform(gaps, lambda g: F.concat(_piece(blocks, g["start"], g["end"]), F.lit(mark))), "")
    last = F.array_max(F.transform(found, lambda s: s["end"]))
    whole = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda blocks: F.concat(cut(blocks), _piece(blocks, last, F.char_length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact(docs: DataFrame, model: Markov, text_col: str = "text") -> DataFrame:
    """`docs` with the secrets of every text replaced.

    Texts without any, empty ones and nulls stay as they are; repeated rows give repeated rows;
    an empty table gives an empty result; all columns stay, whatever their names.
    """
    every = F.concat(*columns(text_of(text_col), model)).alias("spans")
    found = docs.select(whole_row(docs), F.inline(F.array(F.struct(every))))
    text = F.col(f"row.`{text_col}`")
    return found.select(*columns_of_row(docs, **{text_col: F.when(F.size("spans") > 0, redacted(text, F.col("spans"))).otherwise(text)}))
