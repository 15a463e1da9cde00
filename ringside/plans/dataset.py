"""Raw tables to processed ones: identities, deduplication, foreign keys; written only if valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import keys, quality
from ..schemas import COUNTS, PAIRS, PERCENTAGES, RAW
from ..sources import tables

# Other names of events and fighters, and an event that the raw table lacks.
EVENT_ALIASES = {
    "ufc fight night: lopes vs. silva": "Noche UFC: Lopes vs. Silva",
    "ufc fight night: grasso vs. shevchenko 2": "Noche UFC: Grasso vs. Shevchenko 2",
}
MISSING_EVENTS = {"ufc - road to ufc 4.6": ("August 22, 2025", "Shanghai, Hebei, China")}
FIGHTER_ALIASES = {
    "Bibulatov Magomed": "Magomed Bibulatov",
    "Kai Kamaka": "Kai Kamaka III",
    "Patricio Freire": "Patricio Pitbull",
    "Rafael Cerquiera": "Rafael Cerqueira",
}


def build_fighters(raw: DataFrame) -> DataFrame:
    """(fighter_id, name, first_name, last_name, nickname, _ord), the first row of every id."""
    blank = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    rows = raw.select(text.url_id(F.col("URL")).alias("fighter_id"), text.full_name(F.col("FIRST"), F.col("LAST")).alias("name"), blank("FIRST").alias("first_name"), blank("LAST").alias("last_name"), F.col("NICKNAME").alias("nickname"), "_ord")
    return keys.first_wins(rows.filter("fighter_id is not null"), ["fighter_id"])


def all_names(raw: DataFrame) -> DataFrame:
    """Rows for the name map: also those without an id, which claim their names."""
    return raw.select(text.url_id(F.col("URL")).alias("fighter_id"), F.col("FIRST").alias("first_name"), F.col("LAST").alias("last_name"), "_ord")


def build_events(events: DataFrame, details: DataFrame) -> DataFrame:
    """(event_id, event_name, date, location): the first row of each id and name, and events
    that only the fight details name, under a synthetic id."""
    name = text.canonical_name(F.col("EVENT"), EVENT_ALIASES)
    rows = events.select(text.url_id(F.col("URL")).alias("event_id"), name.alias("event_name"), F.to_date(text.strip(F.col("DATE")), "MMMM d, yyyy").alias("date"), F.col("LOCATION").alias("location"), "_ord").filter("event_id is not null")
    own = keys.first_wins(keys.first_wins(rows, ["event_id"]), ["event_name"]).drop("_ord")
    named = details.select(name.alias("event_name")).filter("event_name <> ''").distinct()
    meta = lambda n: F.try_element_at(F.create_map(*[F.lit(x) for k, v in MISSING_EVENTS.items() for x in (k, v[n])]), text.normalize_text(F.col("event_name")))
    needed = named.select(text.synthetic_id(F.col("event_name")).alias("event_id"), "event_name", F.to_date(meta(0), "MMMM d, yyyy").alias("date"), meta(1).alias("location"))
    return keys.append_missing(own, needed, ["event_name"])


def build_fights(details: DataFrame, results: DataFrame, events: DataFrame, names: DataFrame) -> DataFrame:
    """One row a fight: the first detail and the first result of its id."""
    own = details.select(text.url_id(F.col("URL")).alias("fight_id"), text.canonical_name(F.col("EVENT"), EVENT_ALIASES).alias("event_name"), text.strip(F.col("BOUT")).alias("bout"), "_ord").filter("fight_id is not null")
    told = results.select(text.url_id(F.col("URL")).alias("fight_id"), "OUTCOME", F.col("WEIGHTCLASS").alias("weight_class"), F.col("METHOD").alias("method"), F.col("ROUND").try_cast("int").alias("ending_round"), F.col("TIME").alias("ending_time"), F.col("`TIME FORMAT`").alias("time_format"), F.col("REFEREE").alias("referee"), F.col("DETAILS").alias("details"), "_ord").filter("fight_id is not null")
    met = keys.first_wins(own, ["fight_id"]).join(keys.first_wins(told, ["fight_id"]).drop("_ord"), "fight_id", "left")
    met = met.join(events.select("event_name", "event_id"), "event_name", "left")
    (one, two), (r1, r2) = text.bout_sides(F.col("bout")), text.outcome_sides(F.col("OUTCOME"))
    met = met.withColumns({"fighter_1_name": one, "fighter_2_name": two, "fighter_1_result": r1, "fighter_2_result": r2})
    met = keys.resolve(keys.resolve(met, names, "fighter_1_name", "fighter_1_id"), names, "fighter_2_name", "fighter_2_id")
    cols = "fight_id event_id event_name bout fighter_1_id fighter_2_id fighter_1_name fighter_2_name fighter_1_result fighter_2_result weight_class method ending_round ending_time time_format referee details _ord".split()
    return met.select(*cols)


def build_round_stats(stats: DataFrame, fights: DataFrame, names: DataFrame) -> DataFrame:
    """(fight_id, fighter_id, fighter_name, round, text statistics), one row each.

    Rows without a fighter are placeholders and left out. Where one event has a bout more
    than once, its rows are dealt to the fights in equal blocks in file order. Equal
    duplicates keep the first; differing ones fail the job.
    """
    rows = stats.filter(F.col("FIGHTER").isNotNull()).select(
        text.canonical_name(F.col("EVENT"), EVENT_ALIASES).alias("event_name"),
        text.normalize_text(F.col("BOUT")).alias("bout_key"),
        text.strip(F.col("FIGHTER")).alias("fighter_name"),
        text.round_number(F.col("ROUND")).alias("round"),
        *[F.col(f"`{raw}`").alias(own) for own, raw in {**COUNTS, **PAIRS, **PERCENTAGES, "control_time": "CTRL"}.items()],
        "_ord",
    )
    owners = fights.select("event_name", text.normalize_text(F.col("bout")).alias("bout_key"), "fight_id", "_ord")
    dealt = keys.assign_blocks(rows, owners, ["event_name", "bout_key"], "fight_id")
    dealt = tables.cut(keys.resolve(dealt, names, "fighter_name", "fighter_id"))  # the checks read it, and the result
    key, values = ["fight_id", "fighter_id", "round"], [*COUNTS, *PAIRS, *PERCENTAGES, "control_time"]
    bad = {"unresolved fight": "fight_id", "unresolved fighter": "fighter_id", "bad round": "round"}
    lost = dealt.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(k) for k, c in bad.items()]).first().asDict()
    numbered, again = keys.repeats(dealt, key)
    lost["conflicting duplicates"] = not keys.conflicting_duplicates(numbered.join(again, "__at", "left_semi"), key, values).isEmpty()
    if any(lost.values()):
        raise ValueError("round statistics: " + ", ".join(k for k, is_there in lost.items() if is_there))
    return numbered.join(again.filter("__place > 1"), "__at", "left_anti").select(*key[:2], "fighter_name", "round", *values)


def build(spark: SparkSession, raw_folder: str) -> dict[str, DataFrame]:
    """The processed tables from the five raw CSV files."""
    paths = {k: f"{raw_folder}/{k}.csv" for k in RAW}
    tables.must_exist(spark, *paths.values())
    raw = {k: tables.read_csv(spark, p, RAW[k]) for k, p in paths.items()}
    names = keys.few(keys.name_map(all_names(raw["fighter_details"]), FIGHTER_ALIASES))
    events = build_events(raw["event_details"], raw["fight_details"])
    fights = build_fights(raw["fight_details"], raw["fight_results"], events, names).persist()
    rounds = build_round_stats(raw["fight_stats"], fights, names)
    return {"fighters": build_fighters(raw["fighter_details"]).drop("_ord"), "events": events, "fights": fights.drop("_ord"), "round_stats": rounds}


def run(spark: SparkSession, raw_folder: str, out_folder: str) -> None:
    """Build, check and write; nothing is written if a check fails."""
    built = build(spark, raw_folder)
    tables.write_if_valid(spark, built, out_folder, lambda t: quality.etl_integrity(t["events"], t["fighters"], t["fights"], t["round_stats"]))
