"""Exact order statistics of many groups at once, by rounds of narrowing histograms.

A round is one aggregation: the values of every group that still lie in its interval are counted in
bins, and the interval becomes the bin that holds the wanted rank, from its least value to its
greatest. The first bins are powers of two by sign, so that any range of doubles is reached; the later
ones are BINS equal parts, which a double's 52 bits of fraction allow few of. A task hands on a row a bin
at most, whatever the number of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

BINS = 4096
MOST_GROUPS = 100_000  # intervals are broadcast up to so many groups


def _power(v: Column) -> Column:
    """A number that never falls where v rises: the power of two, by sign."""
    size = F.floor(F.log2(F.abs(v))) + 1100
    return F.when(F.isnan(v), 6000).when(F.abs(v) == float("inf"), F.signum(v) * 5000).when(v == 0, 0).otherwise(F.signum(v) * size).cast("int")


def _narrowed(bins: DataFrame, by: list[str]) -> DataFrame:
    """(by..., which, k, lo, hi): the bin that holds rank k, which is counted anew from its first value."""
    line = Window.partitionBy(*by, "which").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = bins.withColumn("upto", F.sum("n").over(line))
    own = upto.filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
    return cut(own.select(*by, "which", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "lo", "hi"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, median) of each group's non-null values; the mean of the two in the middle of an even number.

    Exact, with NaN above all other values. A group without values has no row. At most 7 jobs,
    whatever the number of groups, unless the column is not a double.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    first = cut(rows.groupBy(*by, _power(F.col("v")).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    counts = cut(first.groupBy(*by).agg(F.sum("n").alias("count")))
    if counts.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"there are more than {MOST_GROUPS} groups")
    ranks = counts.select(*by, F.posexplode(F.array(F.expr("(count - 1) div 2"), F.expr("count div 2"))).alias("which", "k"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    met = first.alias("x").join(F.broadcast(ranks).alias("y"), same("x", "y")).select(*[F.col(f"x.{c}").alias(c) for c in by], "which", "k", "bin", "n", "lo", "hi")
    found = _narrowed(met, by)
    done = [found.filter("lo <=> hi")]
    while not (left := found.filter("not (lo <=> hi)")).isEmpty():
        # lo is in the first bin and hi in the last, so an interval always shrinks
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        inside = rows.alias("x").join(F.broadcast(left).alias("y"), [*same("x", "y"), F.col("v").between(F.col("lo"), F.col("hi"))])
        bins = inside.select(*[F.col(f"x.{c}").alias(c) for c in by], "which", "k", bin_.alias("bin"), "v").groupBy(*by, "which", "k", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = _narrowed(bins, by)
        done.append(found.filter("lo <=> hi"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    middle = every.groupBy(*by).agg((F.sum("lo") / 2).alias("median"))
    return counts.alias("x").join(middle.alias("y"), same("x", "y")).select(*[F.col(f"x.{c}").alias(c) for c in by], F.col("count").alias("n"), "median")
