"""Data-quality checks as reports: (check, violations), one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..schemas import CONTROL, COUNTS, PAIRS, PERCENTAGES
from .keys import missing_from


def _counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that meet each condition, from one pass; a null condition is not met."""
    got = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return got.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").cast("long").alias("violations")) for k in checks])))


def _size(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def _counts_with_keys(df: DataFrame, checks: dict[str, Column], keys: list[str], extra: dict[str, Column]) -> DataFrame:
    """_counts(), and figures of whole keys, from one pass and one shuffle: the conditions are counted by key first.

    extra: a check to its violations in one key, an expression over aggregates such as F.count("*").
    """
    names = {k: f"__{n}" for n, k in enumerate([*checks, *extra])}
    by = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(names[k]) for k, c in checks.items()], *[c.cast("long").alias(names[k]) for k, c in extra.items()])
    got = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names.values()])
    return got.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(c).alias("violations")) for k, c in names.items()])))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def offending(df: DataFrame, condition: Column, keys: list[str], show: list[str], top: int = 20) -> DataFrame:
    """The first `top` rows, by their keys, that meet a condition: a sample for a report."""
    return df.filter(F.coalesce(condition, F.lit(False))).select(*keys, *show).orderBy(*keys).limit(top)


def failures(report: DataFrame) -> list[str]:
    """The checks with violations; at most one line a check."""
    return [f"{r['check']}: {r['violations']}" for r in report.filter("violations > 0").collect()]


def require(df: DataFrame, columns: list[str], unique: list[str] | None = None, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """The input contract: columns are there, the key is unique and not null, values are known."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    parts = []
    if unique:
        parts.append(duplicate_keys(df, unique))
    unknown = {f"unknown {c}": F.col(c).isNull() | ~F.col(c).isin(*v) for c, v in (enums or {}).items()}
    if unknown:
        parts.append(_counts(df, unknown))
    if parts and (bad := failures(_together(parts))):
        raise ValueError("; ".join(bad))
    return df


def duplicate_keys(df: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Rows beyond the first of their key."""
    extra = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations"))
    return extra.select(F.lit(name or f"duplicate {', '.join(keys)}").alias("check"), "violations")


def etl_integrity(events: DataFrame, fighters: DataFrame, fights: DataFrame, rounds: DataFrame) -> DataFrame:
    """Unresolved and duplicate ids, foreign keys and impossible pairs of results.

    Every table is scanned once: each row gives its keys, tagged with what they are there, and all keys
    of all tables meet in one aggregation.
    """
    key = lambda kind, tag, c: F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), c.cast("string").alias("key"))
    pair = F.concat_ws("/", F.coalesce("fighter_1_result", F.lit("?")), F.coalesce("fighter_2_result", F.lit("?")))
    parts = [
        (events, [key("event", "events", F.col("event_id"))]),
        (fighters, [key("fighter", "fighters", F.col("fighter_id"))]),
        (fights, [key("fight", "fights", F.col("fight_id")), key("event", "fights", F.col("event_id")), key("fighter", "fights 1", F.col("fighter_1_id")), key("fighter", "fights 2", F.col("fighter_2_id")), key("pair", "fights", pair.isin("W/L", "L/W", "D/D", "NC/NC"))]),
        (rounds, [key("fight", "rounds", F.col("fight_id")), key("fighter", "rounds", F.col("fighter_id")), key("round", "rounds", F.col("round")), key("line", "rounds", F.to_json(F.struct("fight_id", "fighter_id", "round")))]),
    ]
    told = _together([df.select(F.inline(F.array(*keys))) for df, keys in parts])
    tags = ["events", "fighters", "fights", "fights 1", "fights 2", "rounds"]
    met = told.groupBy("kind", "key").agg(*[F.count_if(F.col("tag") == t).alias(t) for t in tags])
    own = {"event": "events", "fighter": "fighters", "fight": "fights"}
    kind = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, c)), F.lit(0)).cast("long")
    lost = lambda k, tag: kind(k, F.when(F.col("key").isNull(), F.col(f"`{tag}`")))
    unknown = lambda k, tag: kind(k, F.when(F.col("key").isNotNull() & (F.col(own[k]) == 0), F.col(f"`{tag}`")))
    twice = lambda k, tag: kind(k, F.greatest(F.col(tag) - 1, F.lit(0)))
    checks = {
        "fights without fight_id": lost("fight", "fights"),
        "fights without event_id": lost("event", "fights"),
        "fights without fighter_1_id": lost("fighter", "fights 1"),
        "fights without fighter_2_id": lost("fighter", "fights 2"),
        "impossible results": kind("pair", F.when(F.col("key") == "false", F.col("fights"))),
        "rounds without fight_id": lost("fight", "rounds"),
        "rounds without fighter_id": lost("fighter", "rounds"),
        "rounds without round": lost("round", "rounds"),
        "duplicate event_id": twice("event", "events"),
        "duplicate fighter_id": twice("fighter", "fighters"),
        "duplicate fight_id": twice("fight", "fights"),
        "duplicate fight_id, fighter_id, round": twice("line", "rounds"),
        "fights of unknown events": unknown("event", "fights"),
        "fights of unknown fighters (1)": unknown("fighter", "fights 1"),
        "fights of unknown fighters (2)": unknown("fighter", "fights 2"),
        "rounds of unknown fights": unknown("fight", "rounds"),
        "rounds of unknown fighters": unknown("fighter", "rounds"),
    }
    sums = met.agg(*[c.alias(f"__{n}") for n, c in enumerate(checks.values())])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"__{n}").alias("violations")) for n, k in enumerate(checks)])))


def numeric_rounds(rounds: DataFrame) -> DataFrame:
    """Landed over attempted, negative figures, percentages out of range, rounds below 1."""
    checks: dict[str, Column] = {}
    for p in PAIRS:
        checks[f"{p}: landed over attempted"] = F.col(f"{p}_landed") > F.col(f"{p}_attempted")
        checks[f"{p}: negative"] = F.least(f"{p}_landed", f"{p}_attempted") < 0
    checks |= {f"{p}: out of range": ~F.col(p).between(0, 100) for p in PERCENTAGES}
    checks |= {f"{c}: negative": F.col(c) < 0 for c in (*COUNTS, CONTROL)}
    checks["round below 1"] = F.coalesce(F.col("round") < 1, F.lit(True))
    return _counts_with_keys(rounds, checks, ["fight_id", "fighter_id", "round"], {"duplicate fight_id, fighter_id, round": F.count("*") - 1})


def same_rows(original: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has, and the difference of their row counts."""
    side = lambda df, one: df.select(*keys, F.lit(one).alias("__one"))
    met = side(original, 1).unionByName(side(result, 0)).groupBy(*keys).agg(F.sum("__one").alias("__a"), F.sum(1 - F.col("__one")).alias("__b"))
    null = F.lit(False)  # a null key has no partner
    for k in keys:
        null = null | F.col(k).isNull()
    lost, added = (F.count_if((F.col(x) > 0) & ((F.col(y) == 0) | null)) for x, y in (("__a", "__b"), ("__b", "__a")))
    rows = F.coalesce(F.abs(F.sum(F.col("__a") - F.col("__b"))), F.lit(0)).cast("long")
    told = met.agg(lost.alias("keys lost"), added.alias("keys added"), rows.alias("row count differs"))
    return told.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("violations")) for c in told.columns])))


def fighter_totals(totals: DataFrame) -> DataFrame:
    checks = {f"{p}: landed over attempted": F.col(f"{p}_landed") > F.col(f"{p}_attempted") for p in PAIRS}
    checks |= {f"{p}: out of range": ~F.col(p).between(0, 100) for p in PERCENTAGES}
    checks["no rounds"] = F.col("rounds_with_stats") < 1
    return _counts_with_keys(totals, checks, ["fight_id", "fighter_id"], {"duplicate fight_id, fighter_id": F.count("*") - 1})


def bout_features(fights: DataFrame, wide: DataFrame, with_stats: int | None = None) -> DataFrame:
    """Rows kept, statistics on one side only, and the expected number of fights with them."""
    one, two = F.col("rounds_with_stats_fighter_1").isNull(), F.col("rounds_with_stats_fighter_2").isNull()
    parts = [same_rows(fights, wide, ["fight_id"]), _counts(wide, {"statistics of one side only": one != two})]
    if with_stats is not None:
        got = wide.agg(F.count_if(~one & ~two).alias("n"))
        parts.append(got.select(F.lit("fights with statistics differ").alias("check"), F.abs(F.col("n") - with_stats).alias("violations")))
    return _together(parts)


def long_table(long: DataFrame) -> DataFrame:
    """Two rows a fight, nobody against themselves, known results, sensible durations."""
    checks = {
        "fighter meets themselves": F.col("fighter_id") == F.col("opponent_id"),
        "unknown result": ~F.coalesce(F.col("result").isin("W", "L", "D", "NC"), F.lit(False)),
        "results don't match": F.concat_ws("/", "result", "opponent_result").isin("W/W", "L/L", "W/D", "D/W"),
    }
    if "fight_duration_seconds" in long.columns:
        checks["negative duration"] = F.col("fight_duration_seconds") < 0
    two = (F.count("*") == 2) & F.coalesce(F.min("fighter_id") != F.max("fighter_id"), F.lit(False))
    return _counts_with_keys(long, checks, ["fight_id"], {"fights without two rows": (~two).cast("int")})


def history(rows: DataFrame) -> DataFrame:
    """Counters that add up, win rates in range, careers without gaps (recomputed)."""
    line = Window.partitionBy("fighter_id").orderBy("date", "fight_id", "fighter_id")
    again = rows.withColumns({"__n": F.row_number().over(line) - 1, "__last": F.lag("career_fights_before").over(line)})
    four = F.col("wins_before") + F.col("losses_before") + F.col("draws_before") + F.col("nc_before")
    checks = {
        "counters don't add up": four != F.col("career_fights_before"),
        "win rate out of range": ~F.col("win_rate_before").between(0, 1),
        "win rate of a debut": (F.col("career_fights_before") == 0) & F.col("win_rate_before").isNotNull(),
        "career differs when recounted": F.col("__n") != F.col("career_fights_before"),
        "career has a gap": F.col("career_fights_before") != F.coalesce(F.col("__last") + 1, F.lit(0)),
    }
    return _counts(again, checks)


def ratings(rows: DataFrame, initial: float = 1500.0, half_life_years: float | None = None, tolerance: float = 1e-8) -> DataFrame:
    """Debuts start at `initial`, no contests change nothing, figures are finite, and every
    rating follows from the last one (after decay), for rows of one config."""
    line = Window.partitionBy("fighter_id").orderBy("date", "fight_id")
    met = rows.withColumns({"__last": F.lag("rating_after").over(line), "__date": F.lag("date").over(line)})
    expected, days, factor = (F.col("__last"), F.lit(0), F.lit(1.0)) if half_life_years is None else scores.apply_recency(F.col("__last"), F.col("__date"), F.col("date"), initial, half_life_years)
    checks = {
        "debut not at the start": F.col("is_debut") & (F.col("rating_before") != initial),
        "no contest changed a rating": (F.col("result") == "NC") & (F.col("rating_before") != F.col("rating_after")),
        "not finite": ~scores.finite(F.col("rating_before")) | ~scores.finite(F.col("rating_after")) | ~scores.finite(F.col("expected_score")),
        "rating does not follow the last": ~scores.close(F.col("rating_before"), expected, tolerance, tolerance),
        "days differ": F.col("__date").isNotNull() & (F.col("days_since_last_fight") != days),
        "recency factor differs": ~scores.close(F.col("recency_factor"), F.coalesce(factor, F.lit(1.0)), tolerance, 0.0),
        "decay away from the start": F.abs(F.col("rating_before") - initial) > F.abs(F.col("rating_historical_before") - initial) + tolerance,
    }
    return _counts(met, checks)
