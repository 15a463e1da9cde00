"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of characters. The distinct blocks of all texts are
sorted and numbered; a text is then a row of integer names. Adjacent names are paired, the
distinct pairs sorted and numbered in turn, and so on until each text has one name. Texts that
end after the same number of rounds have the same name if, and only if, they are equal: nothing
rests on a hash without collisions.

Hashes do decide where a block goes. A block travels once, to the task of its hash, where the
least and the greatest block of that hash are compared: if they are equal, the hash stands for
that block alone, and its number is looked up by the hash. Blocks whose hashes collide are sorted
themselves and looked up by their whole contents.

Equal blocks and pairs are combined before they are shuffled, and names that very many rows
look up are broadcast (see common.looked_up), so no task gets all copies of a text. A round
halves the names of a text: n blocks take log2(n) rounds of narrow rows. Each round is written to
the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, looked_up, repeated, text_of, whole_row

BLOCK = 4096
RANGES = 1 << 12  # the numbers of one range of keys are dealt out by one sort


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int, route: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, sha, parts, at, block, h) of every block; an empty text is one empty block."""
    text = text_of(text_col)
    cuts = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), cuts.alias("cuts"))
    rows = rows.select("doc_id", "sha", F.size("cuts").alias("parts"), F.posexplode("cuts").alias("at", "block"))
    return rows.withColumn("h", route(F.col("block")))


def _numbered(distinct: DataFrame, key: list[str]) -> DataFrame:
    """`distinct` (key..., __n) with an integer name each: its place in the sorted keys of its range."""
    ranged = distinct.withColumn("range", F.pmod(F.xxhash64(*key), F.lit(RANGES)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*key)).cast("long")
    return cut(ranged.withColumn("name", place * RANGES + F.col("range")).drop("range"))


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, sha, parts, at, times, name) of every block; each row of a text has its own."""
    own = ["doc_id", "sha", "parts", "at"]
    places = cut(blocks.drop("block"))
    met = cut(blocks.groupBy("h").agg(F.count("*").alias("__n"), (F.min("block") == F.max("block")).alias("alone")))
    told = met.agg(F.sum("__n").alias("every"), F.count_if(~F.col("alone")).alias("collided")).first()
    every = told["every"] or 0
    found = looked_up(places, _numbered(met.filter("alone").drop("alone"), ["h"]), ["h"], every).select(*own, "name")
    if told["collided"]:
        rest = looked_up(blocks, met.filter("not alone").drop("alone"), ["h"], every)
        names = _numbered(rest.groupBy("h", "block").agg(F.count("*").alias("__n")), ["h", "block"])
        # negative, so that they differ from the names of those above
        found = found.unionByName(looked_up(rest, names, ["h", "block"], every).select(*own, (-F.col("name")).alias("name")))
    return found.withColumn("times", F.lit(1).cast("long"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, sha, times, round, name): texts are equal if, and only if, round and name are.

    One row for all rows of the same id and text, `times` of them; rows of one id are told apart
    by the SHA-256 of their texts. A null text is an empty one. Texts are read whole, however
    long; an empty table gives an empty result; other columns are ignored. route: the hash that
    deals out the blocks; it decides nothing but where work is done.
    """
    named = cut(_named_blocks(_blocks(docs, id_col, text_col, block, route)))
    most, own, k = named.agg(F.max("parts")).first()[0] or 1, ["doc_id", "sha"], 0
    # rows of the same id and text are one from the first round on, and their blocks are counted
    done = [named.filter("parts = 1").groupBy(*own).agg(F.sum("times").alias("times"), F.max("name").alias("name")).withColumn("round", F.lit(0))]
    while most > 1:
        most, k = (most + 1) // 2, k + 1
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = named.filter("parts > 1").groupBy(*own, F.expr("(parts + 1) div 2").cast("int").alias("parts"), F.expr("at div 2").cast("int").alias("at"))
        pairs = cut(pairs.agg(half(0).alias("left"), F.coalesce(half(1), F.lit(0)).alias("right"), F.sum(F.when(F.col("at") == 0, F.col("times"))).alias("times")))
        names = _numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("__n")), ["left", "right"])
        named = looked_up(pairs, names, ["left", "right"], pairs.count()).drop("left", "right")
        done.append(named.filter("parts = 1").select(*own, "times", "name", F.lit(k).alias("round")))
    return reduce(DataFrame.unionByName, done).select(*own, "times", "round", "name")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of `docs`.

    keep_id: the largest id of those with an equal text, which stays; a null id is the smallest.
    Of repeated rows of that id one is kept. Nulls, empty and long texts, and empty tables are as
    in identities().
    """
    found = cut(identities(docs, id_col, text_col, block, route))
    groups = found.groupBy("round", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("__n"))
    rows = repeated(looked_up(found, cut(groups), ["round", "name"], found.count()), "times", "copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` of each group of equal texts, with all its columns: that of the largest id.

    Of rows with that id and text, the first in the order of all columns stays.
    """
    stays = duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), "text_sha256")
    rows = docs.select(whole_row(docs), F.col(id_col).alias("__id"), F.sha2(text_of(text_col), 256).alias("text_sha256"))
    met = rows.join(stays.withColumnRenamed("__id", "kept_id").withColumnRenamed("text_sha256", "kept_sha"), F.col("__id").eqNullSafe(F.col("kept_id")) & (F.col("text_sha256") == F.col("kept_sha")))
    return met.groupBy("__id", "text_sha256").agg(F.min("row").alias("row")).select("row.*")
