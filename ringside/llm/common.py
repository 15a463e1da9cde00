"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, discard, new_folder, shared_folder, stored, table

__all__ = ["WORD_REGEX", "bounded_batches", "columns_of_row", "cut", "discard", "drawn", "looked_up", "new_folder", "repeated", "shared_folder", "stored", "table", "text_of", "whole_row"]

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java/RE2 class.
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def text_of(col: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns in one, named row, so that their names can't clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def columns_of_row(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of `docs` from whole_row(), some of them replaced."""
    return [new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def bounded_batches(spark: SparkSession, rows: int = 500, max_bytes: str = "16m") -> None:
    """Bound what a Python worker holds at once: Arrow batches by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", max_bytes)


def drawn(rows: DataFrame, key: str | Column, size: int, salt: str) -> DataFrame:
    """The first `size` rows in the order of a hash of the key; ties in the hash are broken by it.

    Which rows those are doesn't depend on how the table is partitioned. A count gives the
    share of hashes that surely holds enough rows, so a task hands on its share of `size` only,
    however many tasks there are.
    """
    at = F.col(key) if isinstance(key, str) else key
    place = F.pmod(F.xxhash64(at.cast("string"), F.lit(salt)), F.lit(1 << 40))
    n = rows.count()
    if n > 4 * size:
        # ten standard deviations above `size`: missing rows is out of the question, unless
        # keys repeat; then the whole table is ordered
        share = (size + 10 * size**0.5 + 100) / n
        few = rows.filter(place < F.lit(int(share * (1 << 40))))
        if few.limit(size).count() >= size:
            rows = few
    return rows.orderBy(place, at.cast("string")).limit(size)


def looked_up(rows: DataFrame, names: DataFrame, key: list[str], every: int, most: int = 1000) -> DataFrame:
    """`rows` with the columns of `names` (one row a key), joined on a non-null `key`.

    names has a column __n, how many of the `every` rows of `rows` have its key. A key of more than
    an `most`-th of them would fill a task; such keys, which are `most` at most, are broadcast, and
    only the others are joined by a shuffle. Rows of keys that `names` lacks are left out.
    """
    bound = max(1, every // most)
    hot, own = names.filter(F.col("__n") > bound).drop("__n"), names.filter(F.col("__n") <= bound).drop("__n")
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(own, key))


def repeated(rows: DataFrame, times: str, out: str, step: int = 4096) -> DataFrame:
    """Each row `times` times, numbered from 1 in `out`; in two steps, so that no array is long."""
    first = rows.withColumn("__first", F.explode(F.expr(f"sequence(1L, cast({times} as long), {step}L)")))
    return first.withColumn(out, F.explode(F.expr(f"sequence(__first, least(__first + {step - 1}, cast({times} as long)))"))).drop("__first")
