"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; row r of a source of n rows
has the fractional rank (2r - 1) / 2n. Sorted by it, every stretch of the table holds each
source in proportion, so equal cuts give shards that match the mixture, with row counts at
most one apart.

Neither ranking sorts a source, or the table, in one task: the shuffled order is dealt into
ranges of the hash, counts per (source, range) give each range's first rank, and rows are
ranked within a range only. The fractional order is cut into equal ranges in the same way. There are as many
ranges as keep a range at BIN_ROWS rows or so. What crosses the network is a narrow row per document, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_row

STEP = 4096  # equal rows that are told apart at once
LEAST_BINS, BIN_ROWS = 1024, 1 << 20


def _starts(df: DataFrame, by: list[str], many: Column) -> DataFrame:
    """For every (by..., bin), the number of rows in the bins before it, and in all of them."""
    counts = df.groupBy(*by, "bin").agg(F.sum(many).alias("n"))
    group = Window.partitionBy(*by)
    before = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return counts.select(*by, "bin", before.alias("before"), F.sum("n").over(group).alias("every"))


def interleave(rows: DataFrame, shards: int, source_col: str = "source", order: Column | None = None, seed: int = 7, bins: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """`rows` with shard and slot (the place within the shard, gapless from 0).

    rows: narrow rows (ids and figures, no texts); all columns are kept, whatever their names,
    but for own ones named shard and slot. order: more columns that tell rows of one id apart.
    A null source is a source of its own, a null id like an empty one. Rows that are equal in
    all columns are interchangeable: they are counted first, take consecutive ranks, and each gets a place.
    Fewer rows than shards leave shards empty; an empty table gives an empty result. bins: the number
    of ranges, else it follows from the number of rows.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), order if order is not None else F.lit("")))
    mixed = rows.select(whole_row(rows), source.alias("source"), digest.alias("digest")).groupBy("row", "source", "digest").agg(F.count("*").alias("times"))
    mixed = cut(mixed)
    if bins is None:
        bins = max(LEAST_BINS, (mixed.agg(F.sum("times")).first()[0] or 0) // BIN_ROWS)
    mixed = mixed.withColumn("bin", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * bins / (1 << 32)).cast("long"))
    starts = _starts(mixed, ["source"], F.col("times"))
    in_bin = Window.partitionBy("source", "bin").orderBy("digest", f"row.`{id_col}`").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = mixed.join(starts, ["source", "bin"]).withColumn("rank", F.col("before") + F.sum("times").over(in_bin) - F.col("times"))
    # one row a rank; very many equal rows in two steps, so that no array is long
    ranked = ranked.select("row", "source", "every", "rank", "times", F.explode(F.expr(f"sequence(1L, times, {STEP}L)")).alias("k"))
    ranked = ranked.withColumn("within", F.explode(F.expr(f"sequence(k, least(k + {STEP - 1}, times))"))).withColumn("rank", F.col("rank") + F.col("within"))
    ranked = ranked.withColumn("share", (2 * F.col("rank") - 1) / (2 * F.col("every"))).select("row", "source", "rank", "share")
    ranked = cut(ranked.withColumn("bin", F.least(F.floor(F.col("share") * bins), F.lit(bins - 1)).cast("long")).withColumn("all_bins", F.lit(0)))
    starts = _starts(ranked, ["all_bins"], F.lit(1)).drop("all_bins")  # at most `bins` rows
    in_bin = Window.partitionBy("bin").orderBy("share", "source", "rank")
    placed = ranked.join(F.broadcast(starts), "bin").withColumn("at", F.col("before") + F.row_number().over(in_bin) - 1).withColumn("shard", F.expr(f"(at * {shards}) div every"))
    # the first place of shard k is ceil(k * all / shards)
    slot = F.col("at") - F.expr(f"(shard * every + {shards - 1}) div {shards}")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c not in ("shard", "slot")], F.col("shard").cast("int").alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, source, shard, slot) of every document.

    size: UTF-8 bytes of the text plus 1 (a null text has none); text_crc32: of those bytes,
    unsigned. Counts of shards differ by one row at most. Texts are read whole, however long; null
    ids, repeated rows and empty tables are as in interleave(); other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.col(source_col).alias("source"),
    )
    return interleave(rows, shards, "source", F.col("text_crc32").cast("string"), seed)
