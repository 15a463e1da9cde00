"""Raw tables of the dataset job, as views over the order tables: every bout is a night of its own.

Rows that the job has to clear up are among them: repeated ones, names under other ids, nights that only
the details name, results that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COUNTS, PAIRS, PERCENTAGES
from ..sources.tables import table
from . import competition


def url(kind: str, key: Column) -> Column:
    """An address that ends in an id of 16 hexadecimal digits."""
    return F.concat(F.lit("http://site/"), F.substring(F.md5(F.concat(F.lit(kind), key.cast("string"))), 1, 16))


def _night(k: Column) -> Column:
    return F.when(k % 500 == 0, "UFC - Road to UFC 4.6").otherwise(F.concat(F.lit("Night "), k.cast("string")))


def _some_again(rows: DataFrame, condition: str, **other: Column) -> DataFrame:
    """`rows` and, after them, those that meet a condition with other values."""
    again = rows.filter(condition).withColumns(other | {"_ord": F.col("_ord") + (1 << 40)})
    return rows.unionByName(again)


def fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.lit("Fighter").alias("FIRST"), k.cast("string").alias("LAST"), F.lit("").alias("NICKNAME"), url("f", k).alias("URL"), k.alias("_ord"))
    return _some_again(rows, "s_suppkey % 4 = 1", URL=url("other", k), LAST=F.concat(F.lit(" "), F.col("LAST"))).drop("s_suppkey")


def events(bouts: DataFrame) -> DataFrame:
    k = F.col("fight_id")
    rows = bouts.filter("fight_id % 11 <> 0 and fight_id % 500 <> 0").select(k, _night(k).alias("EVENT"), url("e", k).alias("URL"), F.date_format("date", "MMMM d, yyyy").alias("DATE"), F.lit("Here").alias("LOCATION"), k.alias("_ord"))
    return _some_again(rows, "fight_id % 6 = 1", URL=url("later", k), LOCATION=F.lit("There")).drop("fight_id")


def details(bouts: DataFrame) -> DataFrame:
    k = F.col("fight_id")
    bout = F.concat("fighter_1_name", F.when(k % 2 == 0, " vs. ").otherwise(" VS  "), "fighter_2_name")
    rows = bouts.select(k, _night(k).alias("EVENT"), bout.alias("BOUT"), url("b", k).alias("URL"), k.alias("_ord"))
    return _some_again(rows, "fight_id % 20 = 3", BOUT=F.lit("Nobody vs. No One")).drop("fight_id")


def results(bouts: DataFrame) -> DataFrame:
    k = F.col("fight_id")
    text = lambda v, name: F.lit(v).alias(name)
    rows = bouts.filter("fight_id % 17 <> 0").select(k, url("b", k).alias("URL"), F.concat_ws("/", "fighter_1_result", "fighter_2_result").alias("OUTCOME"), F.col("weight_class").alias("WEIGHTCLASS"), text("Decision", "METHOD"), (k % 5 + 1).cast("string").alias("ROUND"), F.col("ending_time").alias("TIME"), text("3 Rnd", "TIME FORMAT"), text("Ref", "REFEREE"), text("", "DETAILS"), k.alias("_ord"))
    return _some_again(rows, "fight_id % 30 = 7", OUTCOME=F.lit("D/D")).drop("fight_id")


def stats(bouts: DataFrame, rounds: DataFrame) -> DataFrame:
    names = bouts.select("fight_id", F.concat(F.upper("fighter_1_name"), F.lit(" vs. "), "fighter_2_name").alias("BOUT"))
    text = {**COUNTS, **PAIRS, **PERCENTAGES, "control_time": "CTRL"}
    shown = rounds.join(names.withColumn("BOUT", F.when(F.col("fight_id") % 2 == 0, F.col("BOUT")).otherwise(F.replace("BOUT", F.lit(" vs. "), F.lit(" vs ")))), "fight_id")
    order = F.struct("fight_id", "fighter_id", "round")
    rows = shown.select("fight_id", "round", _night(F.col("fight_id")).alias("EVENT"), "BOUT", F.concat(F.lit("Round "), F.col("round").cast("string")).alias("ROUND_"), F.col("fighter_name").alias("FIGHTER"), *[F.col(own).cast("string").alias(raw) for own, raw in text.items()], order.alias("_ord"))
    again = rows.filter("fight_id % 40 = 5 and round = 1")
    nobody = rows.filter("fight_id % 90 = 8 and round = 1").withColumn("FIGHTER", F.lit(None).cast("string"))
    return rows.union(again).union(nobody).drop("fight_id", "round").withColumnRenamed("ROUND_", "ROUND")
