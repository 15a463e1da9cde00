"""The competition domain as views over the order tables.

A bout is an order with two suppliers or more; its sides are the first two by line number and
key. Division and results follow from priority, key and quantities; statistics of a round are
text made from a line's figures, so that the parsers have something to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import features
from ..schemas import PAIRS
from ..sources.tables import table

#: The weight class label of each order priority.
LABELS = {"1-URGENT": "Women's Flyweight Bout", "2-HIGH": "Light Heavyweight Title Bout", "3-MEDIUM": "Lightweight Bout", "4-NOT SPECIFIED": "Catch Weight Bout", "5-LOW": "Tournament Bout"}


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fight_id, date, event_id, fighter ids, names and results, weight_class, division, ending_time)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    side = lines.groupBy(F.col("l_orderkey").alias("fight_id"), F.col("l_suppkey").alias("s")).agg(F.min("l_linenumber").alias("line"), F.sum("l_quantity").alias("qty"))
    # the two smallest of a few sides, without a second shuffle
    pair = side.groupBy("fight_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("line", "s", "qty"))), 1, 2).alias("x")).filter("size(x) = 2")
    a, b = F.col("x")[0], F.col("x")[1]
    first = F.when(F.col("fight_id") % 97 == 0, "NC").when(a["qty"] == b["qty"], "D").when(a["qty"] > b["qty"], "W").otherwise("L")
    second = F.when(F.col("fighter_1_result") == "W", "L").when(F.col("fighter_1_result") == "L", "W").otherwise(F.col("fighter_1_result"))
    sides = pair.select("fight_id", a["s"].alias("fighter_1_id"), b["s"].alias("fighter_2_id"), first.alias("fighter_1_result")).withColumn("fighter_2_result", second)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fight_id"), F.to_date("o_orderdate").alias("date"), F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), F.col("o_orderpriority")).alias("weight_class"))
    named = {f"fighter_{n}_name": F.concat(F.lit("Fighter "), F.col(f"fighter_{n}_id").cast("string")) for n in (1, 2)}
    clock = F.concat((F.col("fight_id") % 5).cast("string"), F.lit(":"), F.lpad((F.col("fight_id") % 60).cast("string"), 2, "0"))
    return sides.join(orders, "fight_id").withColumns(named | {"division": text.division(F.col("weight_class")), "event_id": F.date_format("date", "yyyyMMdd"), "ending_time": F.when(F.col("fight_id") % 13 != 0, clock)})


def rounds(spark: SparkSession, sf_dir: str, fights: DataFrame | None = None) -> DataFrame:
    """Round statistics as text, of the two sides of every bout."""
    fights = bouts(spark, sf_dir) if fights is None else fights
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    both = fights.select("fight_id", F.explode(F.array("fighter_1_id", "fighter_2_id")).alias("fighter_id"))
    # the lines of both sides are all lines of their order and supplier, so they are numbered after the join
    rows = lines.join(both, (F.col("l_orderkey") == F.col("fight_id")) & (F.col("l_suppkey") == F.col("fighter_id"))).withColumn("round", F.row_number().over(order))
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey")
    pair = lambda k: F.concat(((q + k) % 13).cast("string"), F.lit(" of "), ((q + k) % 13 + (p + k) % 9).cast("string"))
    count = lambda n, m: F.when(p % n != 0, F.col("l_linenumber") % m)
    pct = lambda n: F.when(p % n == 0, F.lit("---")).otherwise(F.concat((p % 101).cast("string"), F.lit("%")))
    clock = F.concat((F.col("l_suppkey") % 10).cast("string"), F.lit(":"), F.lpad((p % 60).cast("string"), 2, "0"))
    return rows.select(
        "fight_id",
        "fighter_id",
        F.concat(F.lit("Fighter "), F.col("fighter_id").cast("string")).alias("fighter_name"),
        "round",
        count(11, 3).alias("knockdowns"),
        count(7, 2).alias("submission_attempts"),
        count(5, 4).alias("reversals"),
        *[F.when((p + k) % 17 != 0, pair(k)).alias(name) for k, name in enumerate(PAIRS)],
        pct(10).alias("significant_strikes_pct"),
        pct(6).alias("takedown_pct"),
        F.when(p % 3 == 0, F.lit(None)).when(p % 3 == 1, F.lit("--")).otherwise(clock).alias("control_time"),
    )


def totals(spark: SparkSession, sf_dir: str, null_as_zero: bool = True) -> DataFrame:
    return features.fighter_totals(features.numeric_rounds(rounds(spark, sf_dir)), null_as_zero)


KEEP = ["fight_id", "date", "weight_class", "division", "ending_time"]


def long(spark: SparkSession, sf_dir: str, null_as_zero: bool = True) -> DataFrame:
    """Two rows a bout with that side's statistics."""
    fights = bouts(spark, sf_dir)
    numbers = features.numeric_rounds(rounds(spark, sf_dir, fights))
    return features.bout_long(fights, features.fighter_totals(numbers, null_as_zero), KEEP)
