"""Target-distribution importance resampling of documents by hashed n-grams.

Every n-gram of one to three words falls into one of `buckets` by its CRC-32. A bucket's gain is the
log-ratio of its smoothed share in a target corpus and in the raw one; a document's weight is the
sum of the gains of its n-grams. Gumbel noise from a hash of the id makes the highest scores a
sample without replacement, in proportion to exp(weight).

N-grams are found by suffix arrays of word ids, within a partition: the words of a stretch of
texts get integer ids, and all suffixes are sorted by their first three ids, no more being
needed. Neighbours in that order share a prefix, their LCP (at most 3), so the occurrences of an n-gram are
a run in which LCP >= n. Each run is hashed once, and its bucket is scattered back to the places of
its occurrences. A suffix ends with its text.

CRC-32 is linear: that of a joined string follows from those of its parts and the length of the last,
by tables. So words are hashed one by one, runs by arrays.

A stretch holds a bounded number of words; a longer text is cut into stretches that overlap by two
words, so memory doesn't grow with the text. Counts of buckets are summed over all documents:
each task hands on one row a bucket at most. Weights take a second scan, which is cheaper than
keeping a bucket for every occurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, repeated, text_of

BUCKETS = 10_000
MOST_ORDER = 3
STRETCH = 1 << 23  # bytes of texts from which on a suffix array is built
STRETCH_WORDS = 1 << 20  # of one text
TABLED = 255  # lengths of words that have a table


#: Each byte as it stands in a word, A-Z in lower case; a blank where it is in none.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@cache
def _zeros() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC of value b becomes when n zero bytes follow, to be joined by xor."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> np.uint32(1)), crc >> np.uint32(1))
    out = np.zeros((TABLED + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(1, TABLED + 2):
            last = out[n - 1, k]
            out[n, k] = crc[last & np.uint32(255)] ^ (last >> np.uint32(8))
    return out


def _followed(crc: np.ndarray, more: np.ndarray, length: np.ndarray, longest: int) -> np.ndarray:
    """CRCs of strings that are followed by others, of which CRC and length are given."""
    if longest > TABLED + 1:  # a step for each stretch of the longest one
        left, out = length.copy(), crc
        while left.any():
            step = np.minimum(left, TABLED + 1)
            out = _followed(out, np.zeros_like(out), step, TABLED + 1)
            left -= step
        return out ^ more
    z = _zeros()
    return z[length, 0, crc & 255] ^ z[length, 1, (crc >> 8) & 255] ^ z[length, 2, (crc >> 16) & 255] ^ z[length, 3, crc >> 24] ^ more


def _stretches(text: bytes, words: int = STRETCH_WORDS) -> Iterator[tuple[bytes, int]]:
    """(words and blanks, number of words at the end that only follow others)."""
    clean = text.translate(LOWER)
    if len(clean) <= 2 * words:  # a word and its blank have two bytes at least
        yield clean, 0
        return
    there = np.frombuffer(clean, np.uint8) != 32
    starts = np.flatnonzero(there & ~np.concatenate([[False], there[:-1]]))
    for k in range(0, len(starts), words):
        after = min(k + words + MOST_ORDER - 1, len(starts))
        yield clean[starts[k] : starts[after] if after < len(starts) else len(clean)], max(0, after - k - words)


def _runs(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, one place of each run, run of each occurrence, its place) of all n-grams, n from 1 to 3.

    ids: of the words, from 1; ends: for each place, the words left in its text, itself included.
    """
    n, top = len(ids), int(ids.max()) + 1
    padded = np.concatenate([ids, [0, 0]])
    second, third = np.where(ends > 1, padded[1 : n + 1], 0), np.where(ends > 2, padded[2 : n + 2], 0)
    if top**3 < 1 << 63:
        order = np.argsort((ids * top + second) * top + third)
    else:
        order = np.lexsort((third, second, ids))
    differs = np.ones(n, bool)
    for k, level in enumerate((ids, second, third)):
        own = level[order]
        # LCP <= k: a new run of (k + 1)-grams begins
        changed = own[1:] != own[:-1]
        differs[1:] = changed if k == 0 else differs[1:] | changed
        there = own > 0
        places = order[there]
        if not len(places):
            return
        run = np.cumsum((differs & there)[there]) - 1
        yield k + 1, places[(differs & there)[there]], run, places


def buckets_of(words: pa.Array, lengths: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of every n-gram occurrence; words of texts one after another, `lengths` words each."""
    coded = words.dictionary_encode()
    own = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.array([len(w) for w in own], np.int64) + 1
    first = np.array([zlib.crc32(w) for w in own], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in own], np.uint32)
    longest = int(size.max())
    last = np.repeat(np.cumsum(lengths), lengths)
    left = last - np.arange(len(ids))
    crc: list[np.ndarray] = []
    for n, ones, run, places in _runs(ids + 1, left):
        if n == 1:
            at = first[ids[ones]]
        else:
            word = ids[ones + n - 1]
            at = _followed(crc[-1][ones], after[word], size[word], longest)
        # hashed once a run; scattered to all occurrences
        whole = np.zeros(len(ids), np.uint32)
        whole[places] = at[run]
        crc.append(whole)
        yield places, (at % np.uint32(buckets)).astype(np.int64)[run]


def _in_stretch(pending: list[tuple[int, bytes, int]], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """_found() of stretches (document, text, words that only follow)."""
    parts = pc.ascii_split_whitespace(pa.array([x[1] for x in pending], pa.large_binary()).view(pa.large_string()))
    there = pc.greater(pc.binary_length(parts.values), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy()]
    lengths = np.diff(before)
    if not lengths.any():
        return
    document = np.repeat([x[0] for x in pending], lengths)
    # words that only follow others belong to the next stretch
    counted = np.repeat(np.cumsum(lengths) - [x[2] for x in pending], lengths) > np.arange(len(document))
    told = np.bincount(document[counted], minlength=n)
    for places, bucket in buckets_of(parts.values.filter(there).view(pa.large_binary()), lengths, buckets):
        use = counted[places]
        yield document[places[use]], bucket[use], told
        told = np.zeros_like(told)


def _found(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document and bucket of every occurrence in `texts`, words of each document that are met first), bit by bit."""
    pending, size = [], 0
    for k, text in enumerate(texts):
        for clean, follow in _stretches(text.as_py() or b""):
            pending.append((k, clean, follow))
            size += len(clean)
            if size >= STRETCH:
                yield from _in_stretch(pending, len(texts), buckets)
                pending, size = [], 0
    if pending:
        yield from _in_stretch(pending, len(texts), buckets)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often n-grams of all texts fall into each bucket; those that none meets are left out.

    A null or empty text has none; texts are read whole; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in _found(batch.column(0), buckets):
                n += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of the ratio of smoothed shares in target and raw counts."""
    told = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    all_s, all_t = (float((counts.agg(F.sum("n")).first()[0] or 0) + buckets) for counts in (raw, target))
    share = (F.col("t") + 1).cast("double") * all_s / ((F.col("s") + 1).cast("double") * all_t)
    return told.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def noise(id_col: str | Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from a hash of the id; a null id counts as empty."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(told, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row; gain: that of each bucket, as many as there are buckets.

    A null or empty text has no words and weight 0. Repeated rows stay repeated.
    """
    each = np.array(gain, np.float64)  # whole numbers: their sums are exact

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for document, bucket, told in _found(batch.column(1), len(each)):
                words += told
                features += np.bincount(document, minlength=n)
                weight += np.bincount(document, each[bucket], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """`rows` with rank, their place in that order from 1; and how many they are.

    The rows are dealt into ranges by the order and sorted there; counts of the ranges give the first
    rank of each. `order` must tell rows apart, else equal ones stay in one range.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33))
    starts, n = [], 0
    for r in placed.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():  # a row for each range
        starts.append((r["range"], n))
        n += r["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))
    return placed.join(before, "range").withColumn("rank", F.col("before") + F.col("at") + 1).drop("range", "at", "before"), n


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is that of a drawn row, else null.

    Drawn: of the rows with `least_words` or more, `percent` of a hundred, rounded down: those with the highest scores,
    ties to the smaller id, null first. Null, empty and long texts, repeated rows (each can be drawn)
    and empty tables are as in weights(); an empty target has equal shares.
    """
    told = gains(docs.sparkSession, cut(bucket_counts(docs, text_col, buckets)), cut(bucket_counts(target, target_text, buckets)), buckets)
    each = [r["gain"] for r in told.orderBy("bucket").collect()]  # one for each bucket
    own = weights(docs, each, id_col, text_col).withColumnRenamed("id", "doc_id")
    own = own.withColumn("score", F.col("weight") + noise("doc_id", seed))
    # repeated rows are told apart by a number, so that a range can end between them
    rows = repeated(cut(own.groupBy(*own.columns).agg(F.count("*").alias("times"))), "times", "copy").drop("times")
    able, n = ranked(rows.filter(F.col("n_words") >= least_words), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight"), F.col("copy")])
    able = able.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return able.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("copy")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of `docs` that resample() draws, with all their columns; ids must tell rows apart."""
    found = resample(docs, target, id_col=id_col, **more).filter("rank is not null").select(F.col("doc_id").alias("__drawn"))
    return docs.join(found, docs[id_col].eqNullSafe(found["__drawn"]), "left_semi")
