"""From round statistics to fighter totals, and between one and two rows a fight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..schemas import CONTROL, COUNTS, DIFFERENCES, PAIRS, PERCENTAGES, SUMS


def numeric_rounds(rounds: DataFrame, strict: bool = True) -> DataFrame:
    """Text statistics as numbers. strict: junk fails the job; else it becomes null."""
    cols = [F.col("fight_id"), F.col("fighter_id"), F.col("fighter_name"), F.col("round")]
    for p in PAIRS:
        landed, attempted = (text.landed_attempted if strict else text.landed_attempted_lenient)(F.col(p))
        cols += [landed.alias(f"{p}_landed"), attempted.alias(f"{p}_attempted")]
    cols += [(text.percentage if strict else text.percentage_lenient)(F.col(p)).alias(p) for p in PERCENTAGES]
    cols += [(F.col(c).cast("double") if strict else F.col(c).cast("string").try_cast("double")).alias(c) for c in COUNTS]
    return rounds.select(*cols, (text.clock_seconds if strict else text.clock_seconds_lenient)(F.col("control_time")).alias(CONTROL))


def fighter_totals(rounds: DataFrame, null_as_zero: bool = True) -> DataFrame:
    """Sums of a fighter's rounds in a fight, from one aggregation.

    null_as_zero: a figure missing in all rounds sums to 0, and percentages are 0 to 100; else
    it stays null, and they are 0 to 1. Rows with a null key are left out.
    """
    key = ["fight_id", "fighter_id", "fighter_name"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)) if null_as_zero else F.sum(c)
    sums = [total(c).alias(c) for c in SUMS]
    out = rounds.dropna(subset=key).groupBy(*key).agg(*sums, F.countDistinct("round").alias("rounds_with_stats"))
    rate = scores.safe_percentage if null_as_zero else scores.ratio
    pct = lambda p: rate(F.col(f"{p}_landed"), F.col(f"{p}_attempted"))
    return out.withColumns({"significant_strikes_pct": pct("significant_strikes"), "takedown_pct": pct("takedowns")})


def bout_wide(fights: DataFrame, totals: DataFrame) -> DataFrame:
    """fights with both sides' statistics and their differences.

    Fights whose totals don't have exactly two fighters keep null statistics.
    """
    stats = [*SUMS, "rounds_with_stats", *PERCENTAGES]
    two = totals.groupBy("fight_id").agg(F.countDistinct("fighter_id").alias("n")).filter("n = 2").select("fight_id")
    own = totals.join(two, "fight_id", "left_semi")
    out = fights
    for side in (1, 2):
        part = own.select("fight_id", F.col("fighter_id").alias(f"fighter_{side}_id"), F.col("fighter_name").alias(f"stats_fighter_{side}_name"), *[F.col(c).alias(f"{c}_fighter_{side}") for c in stats])
        out = out.join(part, ["fight_id", f"fighter_{side}_id"], "left")
    return out.withColumns({f"{c}_diff": F.col(f"{c}_fighter_1") - F.col(f"{c}_fighter_2") for c in DIFFERENCES})


def sides(fights: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows a fight, one from each fighter's view: `keep`, side, fighter, opponent, results."""
    has_names = "fighter_1_name" in fights.columns
    view = lambda a, b: F.struct(
        F.lit(a).alias("side"),
        F.col(f"fighter_{a}_id").alias("fighter_id"),
        *([F.col(f"fighter_{a}_name").alias("fighter_name")] if has_names else []),
        F.col(f"fighter_{b}_id").alias("opponent_id"),
        *([F.col(f"fighter_{b}_name").alias("opponent_name")] if has_names else []),
        F.col(f"fighter_{a}_result").alias("result"),
        F.col(f"fighter_{b}_result").alias("opponent_result"),
    )
    return fights.select(*keep, F.inline(F.array(view(1, 2), view(2, 1))))


def bout_long(fights: DataFrame, totals: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows a fight with that fighter's statistics: one explode and one join."""
    stats = totals.drop("fighter_name")
    out = sides(fights, keep).join(stats, ["fight_id", "fighter_id"], "left")
    # the time within the last round only
    return out.withColumn("fight_duration_seconds", text.ending_seconds(F.col("ending_time"))) if "ending_time" in keep else out


def contingency(fights: DataFrame) -> DataFrame:
    """How often each pair of results occurs; pairs with a null are left out."""
    pair = ["fighter_1_result", "fighter_2_result"]
    return fights.dropna(subset=pair).groupBy(*pair).agg(F.count("*").alias("fights"))


def canonical(fights: DataFrame) -> DataFrame:
    """Fights turned so that fighter_1_id < fighter_2_id; ids, names and results go together."""
    turn = F.col("fighter_1_id") > F.col("fighter_2_id")
    parts = [p for p in ("id", "name", "result") if f"fighter_1_{p}" in fights.columns]
    swapped = {f"fighter_{a}_{p}": F.when(turn, F.col(f"fighter_{b}_{p}")).otherwise(F.col(f"fighter_{a}_{p}")) for p in parts for a, b in ((1, 2), (2, 1))}
    same = F.when(F.col("fighter_1_id") == F.col("fighter_2_id"), F.raise_error(F.lit("a fighter meets themselves")))
    return fights.withColumns(swapped).withColumn("fighter_1_id", F.coalesce(same.cast(fights.schema["fighter_1_id"].dataType), F.col("fighter_1_id")))


def any_present(rows: DataFrame, by: list[str], columns: list[str], *more: Column) -> DataFrame:
    """(by..., has_<column>...): whether any row of a group has a value there; and `more` aggregates."""
    return rows.groupBy(*by).agg(*[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in columns], *more)
