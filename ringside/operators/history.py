"""What is known before a fight: counts, sums and means of earlier fights only.

All frames end at the row before, so nothing of a fight reaches its own features. Windows of
one operator share a partition and order, hence one shuffle and one sort. A fighter with very many
fights would fill a task; with `block`, the fights are dealt by fighter and stretch of time: figures of
whole stretches are summed first, and within one only its own rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HISTORY, PERCENTAGES
from ..sources.tables import cut


ORDER = ("date", "fight_id", "fighter_id")


def prior(rows: DataFrame, values: dict[str, Column], order: tuple[str, ...] = ORDER, block: str | None = None, by: str = "fighter_id", last: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with __n (how many come before), and __sum_<k> and __count_<k> of the non-null values of those, null and 0 without any.

    block: "month", "year" and so on, by which the first column of `order`, a date, is cut; none: one
    window a fighter. last: also __last_<k>, the value in the row before.
    """
    last = last or {}
    put = rows.withColumns({f"__v_{k}": v for k, v in values.items()} | {f"__w_{k}": v for k, v in last.items()})
    if block is not None:
        put = put.withColumn("__block", F.trunc(order[0], block))
    own = [by] if block is None else [by, "__block"]
    line = Window.partitionBy(*own).orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    inner = {"__n": F.row_number().over(line) - 1} | {f"__sum_{k}": F.sum(f"__v_{k}").over(upto) for k in values} | {f"__count_{k}": F.count(f"__v_{k}").over(upto) for k in values} | {f"__last_{k}": F.lag(f"__w_{k}").over(line) for k in last}
    told = put.withColumns(inner)
    if block is not None:
        # a row for each fighter and stretch
        whole = put.groupBy(*own).agg(F.count("*").alias("n"), *[F.sum(f"__v_{k}").alias(f"s_{k}") for k in values], *[F.count(f"__v_{k}").alias(f"c_{k}") for k in values], *[F.max_by(F.struct(f"__w_{k}"), F.struct(*order)).alias(f"l_{k}") for k in last])
        line = Window.partitionBy(by).orderBy("__block")
        upto = line.rowsBetween(Window.unboundedPreceding, -1)
        starts = whole.select(F.col(by).alias("__by"), F.col("__block").alias("__of"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"), *[F.sum(f"s_{k}").over(upto).alias(f"s_{k}") for k in values], *[F.coalesce(F.sum(f"c_{k}").over(upto), F.lit(0)).alias(f"c_{k}") for k in values], *[F.lag(f"l_{k}").over(line).alias(f"l_{k}") for k in last])
        told = told.join(starts, F.col(by).eqNullSafe(F.col("__by")) & F.col("__block").eqNullSafe(F.col("__of")))
        add = lambda k: F.when(F.col(f"__sum_{k}").isNull(), F.col(f"s_{k}")).when(F.col(f"s_{k}").isNull(), F.col(f"__sum_{k}")).otherwise(F.col(f"__sum_{k}") + F.col(f"s_{k}"))
        first = F.col("__n") == 0
        both = {f"__last_{k}": F.when(first, F.col(f"l_{k}.__w_{k}")).otherwise(F.col(f"__last_{k}")) for k in last} | {f"__sum_{k}": add(k) for k in values} | {f"__count_{k}": F.col(f"__count_{k}") + F.col(f"c_{k}") for k in values}
        told = told.withColumns(both | {"__n": F.col("__n") + F.col("n")})
    return told.select(*rows.columns, "__n", *[f"__{what}_{k}" for k in values for what in ("sum", "count")], *[f"__last_{k}" for k in last])


def fight_history(long: DataFrame, sums: list[str] | None = None, means: list[str] | None = None, block: str | None = None) -> DataFrame:
    """`long` (two rows a fight, with date) with career counts, win rate, sums and means before.

    A sum is null until a value has been seen; a mean divides by the values that are there. block: see prior().
    """
    sums = HISTORY if sums is None else sums
    means = list(PERCENTAGES) if means is None else means
    results = {"wins": "W", "losses": "L", "draws": "D", "nc": "NC"}
    values = {name: F.when(F.coalesce(F.col("result"), F.lit("")) == r, F.lit(1)) for name, r in results.items()}
    met = prior(long, values | {c: F.col(c) for c in dict.fromkeys([*sums, *means])}, block=block)
    out = {"career_fights_before": F.col("__n").cast("int")} | {f"{name}_before": F.col(f"__count_{name}") for name in results}
    out["win_rate_before"] = F.try_divide(F.col("__count_wins"), F.col("__n"))
    mean = lambda c: F.try_divide(F.col(f"__sum_{c}"), F.col(f"__count_{c}"))
    for c in sums:
        out[f"sum_{c}_before"] = F.col(f"__sum_{c}")
        out[f"avg_{c}_before"] = mean(c)
    for c in means:
        out[f"avg_{c}_before"] = mean(c)
    return met.select(*[c for c in long.columns if c not in out], *[v.alias(k) for k, v in out.items()])


#: Running features of the performance models: name to the per-fight value that is averaged.
STRIKING = ["significant_strikes_landed", "significant_strikes_attempted", "significant_strikes_pct", "total_strikes_landed", "total_strikes_attempted"]
GRAPPLING = ["takedowns_landed", "takedowns_attempted", "takedown_pct", "submission_attempts", "reversals"]
DOMINANCE = ["knockdowns", "control_time_seconds"]


def performance_running(long: DataFrame, features: list[str] | None = None, block: str | None = None) -> DataFrame:
    """`long` with the mean of each feature over the fighter's earlier fights, null without any. block: see prior()."""
    features = [*STRIKING, *GRAPPLING, *DOMINANCE] if features is None else features
    met = prior(long, {c: F.col(c) for c in features}, ("date", "fight_id"), block)
    out = {f"avg_{c}": F.try_divide(F.col(f"__sum_{c}"), F.col(f"__count_{c}")) for c in features}
    return met.select(*[c for c in long.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def continuity(ratings: DataFrame, block: str | None = None) -> DataFrame:
    """Each row with the fighter's previous rating_after, date and career count. block: see prior()."""
    names = {"previous_rating_after": "rating_after", "previous_date": "date", "previous_career_fights": "career_fights_before"}
    met = prior(ratings, {}, ("date", "fight_id"), block, last={k: F.col(c) for k, c in names.items()})
    return met.select(*[c for c in ratings.columns if c not in names], *[F.col(f"__last_{k}").alias(k) for k in names])


def strength_of_schedule(bouts: DataFrame, initial: float = 1500.0, block: str | None = None) -> DataFrame:
    """Bouts (one row, ratings before of both sides) with the mean rating of earlier opponents.

    Only bouts with a winner may be given; without an earlier one the mean is `initial`. block: see
    prior().
    """
    bouts = cut(bouts)  # read for both sides, and for the result: ratings are walked once
    view = lambda a, b: F.struct(F.lit(a).alias("side"), F.col(f"fighter_{a}_id").alias("fighter_id"), F.col(f"rating_{b}_before").alias("opponent_rating"))
    long = bouts.select("fight_id", "date", F.inline(F.array(view(1, 2), view(2, 1))))
    met = prior(long, {"met": F.col("opponent_rating")}, ("date", "fight_id"), block)
    sos = F.coalesce(F.try_divide(F.col("__sum_met"), F.col("__count_met")), F.lit(initial))
    both = met.withColumn("sos", sos).groupBy("fight_id").agg(F.max(F.when(F.col("side") == 1, F.col("sos"))).alias("sos_1_before"), F.max(F.when(F.col("side") == 2, F.col("sos"))).alias("sos_2_before"))
    return bouts.join(both, "fight_id").withColumns({"elo_difference": F.col("rating_1_before") - F.col("rating_2_before"), "sos_difference": F.col("sos_1_before") - F.col("sos_2_before")})


def latest(ratings: DataFrame, top: int | None = None) -> DataFrame:
    """The last row of every fighter; of those, the `top` with the highest rating."""
    keys = [c for c in ("config", "fighter_id") if c in ratings.columns]
    # an aggregation, which combines the rows of a fighter before they are shuffled
    newest = ratings.groupBy(*keys).agg(F.max_by(F.struct(*ratings.columns), F.struct("date", "fight_id")).alias("last"))
    out = newest.select("last.*")
    return out if top is None else out.orderBy(F.desc("rating_after"), "fighter_id").limit(top)
