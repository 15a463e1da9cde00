"""Evaluation of predicted probabilities: metrics, calibration, temporal splits and folds."""

from __future__ import annotations

from collections import Counter
from datetime import date
from functools import reduce
from math import ceil, inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.tables import cut, discard, new_folder, stored
from . import keys

#: Ranges of probabilities in which ranks are counted apart, so that no task sorts a whole group.
RANK_BINS = 1024
#: About how many rows are shuffled at once, and in how many turns at most.
SLICE_ROWS, MOST_SLICES = 20_000_000, 8
#: About how many of them a task sorts.
TASK_ROWS = 200_000


def _quantiles(each: DataFrame, p: str, bins: int = RANK_BINS) -> list[float]:
    return [b for b in each.approxQuantile(p, [k / bins for k in range(1, bins)], 0.5 / bins) if isfinite(b)]


def _dealt(each: DataFrame, p: str, out: str, borders: list[float]) -> DataFrame:
    if not borders:
        return each.withColumn(out, F.lit(0))
    dealt = Bucketizer(splits=[-inf, *sorted(set(borders)), inf], inputCol=p, outputCol=out, handleInvalid="keep").transform(each)
    return dealt.withColumn(out, F.col(out).cast("int"))


def _ranges(each: DataFrame, p: str, out: str, bins: int = RANK_BINS) -> DataFrame:
    """`each` with the number of the range that its value is in; the ranges hold about as many rows each.

    Their borders are quantiles, so values that lie close together are told apart as well as any.
    """
    return _dealt(each, p, out, _quantiles(each, p, bins))


def evaluation_dataset(fights: DataFrame, ratings: DataFrame, history: DataFrame) -> DataFrame:
    """(fight_id, date, fighter_1_id, fighter_2_id, y, p_win_rate, p_elo) of decided fights.

    ratings: two rows a fight with expected_score; history: with win_rate_before. Draws and
    no contests are left out; a decided fight without a rating, or one with two rows of a
    fighter, fails the job.
    """
    decided = fights.filter(~F.coalesce(F.col("fighter_1_result").isin("D", "NC"), F.lit(False)))
    elo = ratings.select("fight_id", F.col("fighter_id").alias("fighter_1_id"), F.col("expected_score").alias("p_elo"))
    rate = lambda n: history.select("fight_id", F.col("fighter_id").alias(f"fighter_{n}_id"), F.col("win_rate_before").alias(f"win_rate_{n}"))
    one = ["fight_id", "fighter_1_id"]
    met = decided.join(keys.unique(elo, one, "ratings"), one, "left").join(keys.unique(rate(1), one, "history"), one, "left")
    two = ["fight_id", "fighter_2_id"]
    met = met.join(keys.unique(rate(2), two, "history"), two, "left")
    y = F.when(F.col("fighter_1_result") == "W", 1).when(F.col("fighter_1_result") == "L", 0)
    rated = F.when(F.col("p_elo").isNull(), F.raise_error(F.lit("a decided fight has no rating")).cast("double")).otherwise(F.col("p_elo"))
    return met.select("fight_id", "date", "fighter_1_id", "fighter_2_id", y.alias("y"), scores.win_rate_probability(F.col("win_rate_1"), F.col("win_rate_2")).alias("p_win_rate"), rated.alias("p_elo"))


def by_model(dataset: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """Long form: (keep..., model, y, p), a row for each model column."""
    return dataset.select(*keep, "y", F.inline(F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).alias("p")) for k, c in models.items()])))


def metrics(predictions: DataFrame, by: list[str], y: str = "y", p: str = "p", least: float = 1e-6, many: str | None = None) -> DataFrame:
    """(by..., n, log_loss, brier_score, accuracy, roc_auc) of each group.

    Rows without a label or a probability are left out. p >= 0.5 predicts side 1. The AUC is
    exact, ties counted half, and null where there is one class only: it is summed over
    distinct probabilities in RANK_BINS ranges, whose totals are small. many: the column of `by` that is an
    array of all groups that a row is in.

    The rows are written once, and go when their ranges are summed. They are shuffled once, a slice of the ranges at
    a time, and dealt to their `many` groups after that. Where one probability has a hundredth of the
    rows, equal ones are counted before.
    """
    spark, path = predictions.sparkSession, new_folder(predictions.sparkSession, "metrics")
    told = predictions.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, F.col(y).cast("double").alias("__y"), F.col(p).alias("__p"))
    rows = stored(told, path)
    borders, own = _quantiles(rows, "__p"), [c for c in by if c != many]
    tied = max(Counter(borders).values(), default=0) > RANK_BINS // 100
    q = scores.clip(F.col("__p"), least)
    loss = -(F.col("__pos") * F.log(q) + F.col("__neg") * F.log(1 - q))
    brier = F.col("__pos") * F.pow(F.col("__p") - 1, 2) + F.col("__neg") * F.pow(F.col("__p"), 2)
    hits = F.when(F.col("__p") >= 0.5, F.col("__pos")).otherwise(F.col("__neg"))
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    dealt = _dealt(rows, "__p", "__bin", borders).select(*by, "__bin", "__p", F.col("__y").alias("__pos"), (1 - F.col("__y")).alias("__neg"))
    n = rows.count()
    slices, found = max(1, min(MOST_SLICES, ceil(n / SLICE_ROWS))), []
    for k in range(slices):
        part = dealt.filter(F.pmod("__bin", F.lit(slices)) == k)
        if tied:
            part = part.groupBy(*by, "__bin", "__p").agg(*sums("__pos", "__neg"))
        part = part.repartition(ceil(n / slices / TASK_ROWS) or 1, *own, "__bin")
        if many:
            part = part.withColumn(many, F.explode(many))
        each = part.groupBy(*by, "__bin", "__p").agg(*sums("__pos", "__neg"))
        lower = F.coalesce(F.sum("__neg").over(Window.partitionBy(*by, "__bin").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        each = each.withColumns({"__won": F.col("__pos") * (lower + F.col("__neg") / 2), "__loss": loss, "__brier": brier, "__hits": hits})
        found.append(cut(each.groupBy(*by, "__bin").agg(*sums("__pos", "__neg", "__won", "__loss", "__brier", "__hits"))))
    discard(spark, path)
    below = F.coalesce(F.sum("__neg").over(Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bins = reduce(DataFrame.union, found).withColumn("__won", F.col("__won") + F.col("__pos") * below)
    n = F.sum(F.col("__pos") + F.col("__neg"))
    return bins.groupBy(*by).agg(n.cast("long").alias("n"), (F.sum("__loss") / n).alias("log_loss"), (F.sum("__brier") / n).alias("brier_score"), (F.sum("__hits") / n).alias("accuracy"), F.try_divide(F.sum("__won"), F.sum("__pos") * F.sum("__neg")).alias("roc_auc"))


def calibration(predictions: DataFrame, by: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """(by..., bin, lo, hi, n, mean_predicted, observed_win_rate, gap); bins are closed on the right."""
    edges = [k * (1 / bins) for k in range(bins)] + [1.0]
    place = F.lit(1)
    for e in edges[1:-1]:
        place = place + (F.col(p) > F.lit(e)).cast("int")
    rows = predictions.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("bin", place)
    out = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_win_rate"))
    at = lambda k: F.element_at(F.lit(edges), F.col("bin") + k)
    return out.withColumns({"lo": at(0), "hi": at(1), "gap": F.col("mean_predicted") - F.col("observed_win_rate")})


def fold_start(day: Column, first: date, step_years: int) -> Column:
    """The start of the walk-forward fold that a date is in; null before the first."""
    months = (F.year(day) * 12 + F.month(day)) - (first.year * 12 + first.month)
    fold = F.floor(months / (12 * step_years)).cast("int")
    if first.day != 1:
        raise ValueError("folds start on the first of a month")
    return F.when(day >= F.lit(first), F.add_months(F.lit(first), fold * (12 * step_years)))


MOST_FOLDS = 10_000


def in_folds(rows: DataFrame, folds: DataFrame, day: str = "date") -> DataFrame:
    """`rows` with fold and start of the named fold that their date is in; null where there is none.

    folds: (fold, start, end), the end excluded; lengths and gaps as one likes. They are checked first: names
    are unique, a fold ends after it starts, and none meets another. MOST_FOLDS at most. Rows meet
    the folds of their year by an equal join, so no row is compared with all folds.
    """
    known = [r.asDict() for r in folds.select("fold", "start", "end").orderBy("start").limit(MOST_FOLDS + 1).collect()]
    if len(known) > MOST_FOLDS:
        raise ValueError(f"there are more than {MOST_FOLDS} folds")
    if any(None in r.values() for r in known) or len({r["fold"] for r in known}) < len(known):
        raise ValueError("folds need names of their own, a start and an end")
    if wrong := [r["fold"] for r in known if r["start"] >= r["end"]] + [b["fold"] for a, b in zip(known, known[1:]) if b["start"] < a["end"]]:
        raise ValueError(f"folds are empty or meet others: {wrong}")
    years = F.explode(F.sequence(F.year("start"), F.year(F.date_sub("end", 1)))).alias("__year")
    own = folds.select("fold", "start", "end", years)
    dated = rows.withColumn("__year", F.year(day)).alias("x")
    met = dated.join(F.broadcast(own).alias("y"), (F.col("x.__year") == F.col("y.__year")) & (F.col(f"x.{day}") >= F.col("start")) & (F.col(f"x.{day}") < F.col("end")), "left")
    return met.select(*[F.col(f"x.`{c}`").alias(c) for c in rows.columns], "fold", "start")


#: Bounds of probabilities in the log loss: of evaluated ratings, of the Glicko-2 and schedule
#: experiments, and of the performance models (the least step of a double above 1).
LEAST, LEAST_EXPERIMENT, LEAST_MODEL = 1e-6, 1e-15, 2.0**-52


def split_metrics(predictions: DataFrame, cutoff: date, by: list[str], least: float = LEAST) -> DataFrame:
    """Metrics of everything from a date on."""
    return metrics(predictions.filter(F.col("date") >= F.lit(cutoff)), by, least=least).withColumn("fold", F.lit("test"))


def with_pooled(predictions: DataFrame, by: list[str], least: float = LEAST) -> DataFrame:
    """Metrics of each fold, and of all predictions together (fold "pooled")."""
    return metrics(predictions.withColumn("fold", F.array(F.col("fold"), F.lit("pooled"))), [*by, "fold"], least=least, many="fold")


def by_named_fold(predictions: DataFrame, folds: DataFrame, by: list[str], least: float = LEAST) -> DataFrame:
    """Metrics of each named fold (in_folds) that has rows, and pooled over all of them (fold "pooled")."""
    dealt = in_folds(predictions, folds).filter("fold is not null")
    return with_pooled(dealt.drop("start"), by, least)


def walk_forward(predictions: DataFrame, first: date, step_years: int, by: list[str], cutoff: date | None = None, least: float = LEAST) -> DataFrame:
    """Metrics of each fold that has rows, and pooled over all of them (fold "pooled").

    cutoff: also of everything from that date on (fold "test").
    """
    fold = fold_start(F.col("date"), first, step_years).cast("string")
    every = [fold, F.when(fold.isNotNull(), F.lit("pooled"))]
    if cutoff is not None:
        every.append(F.when(F.col("date") >= F.lit(cutoff), F.lit("test")))
    return metrics(predictions.withColumn("fold", F.array_compact(F.array(*every))).filter("size(fold) > 0"), [*by, "fold"], least=least, many="fold")


def pooled_by_size(fold_metrics: DataFrame, by: list[str], names: tuple[str, ...] = ("log_loss", "brier_score", "accuracy", "roc_auc")) -> DataFrame:
    """Means of fold metrics weighted by n: not the metrics of pooled predictions."""
    rows = fold_metrics.filter("fold <> 'pooled'")
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c) for c in names])


def best_per_fold(fold_metrics: DataFrame, metric: str = "log_loss", config: str = "config") -> DataFrame:
    """The config with the least metric in each fold; ties go to the first by name."""
    return fold_metrics.groupBy("fold").agg(F.min_by(F.col(config), F.struct(F.col(metric), F.col(config))).alias(config), F.min(metric).alias(metric))
