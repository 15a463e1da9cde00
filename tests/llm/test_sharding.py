import zlib
from collections import Counter

from ringside.llm import queries, sharding

from .fixtures import documents


def test_query(spark, small):
    rows = queries.op1_sharding(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_every_shard_matches_the_mixture_and_brute_force(spark, small):
    rows = queries.op1_sharding(spark, small).collect()
    all_ = Counter(r.source for r in rows)
    for s in range(16):
        own = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(own[k] - all_[k] / 16) <= 2 for k in all_)
    again = queries.op1_sharding(spark, small).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    # the same order from a plain sort
    import hashlib

    key = {r.doc_id: hashlib.md5(f"7:{r.doc_id}:{r.text_crc32}".encode()).hexdigest() for r in rows}
    share = {}
    for source in all_:
        own = sorted((r.doc_id for r in rows if r.source == source), key=key.get)
        share |= {d: ((2 * k + 1) / (2 * len(own)), "s" + source) for k, d in enumerate(own)}
    want = sorted(share, key=share.get)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == want


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = sharding.shard_documents(docs, shards=5, text_col="text").collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in sorted(counts) for k in range(counts[s])]
    assert [r.text_crc32 for r in rows if r.doc_id == 3] == [0]
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shard_documents(docs.limit(2), shards=4).collect()) == [(0, 0), (2, 0)]


def test_many_equal_rows_and_columns_of_any_name(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "STEP", 7)
    hot = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).alias("__bin"), F.lit(2).alias("bin"), F.lit(3).alias("row"))
    rows = hot.union(spark.range(100).select("id", F.lit("b"), F.lit(1), F.lit(2), F.lit(3)))
    out = sharding.interleave(rows, 7)
    assert out.columns == [*rows.columns, "shard", "slot"]
    found = out.collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == 600 and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s in sorted(counts) for k in range(counts[s])]
    assert all(abs(sum(r.source == "b" for r in found if r.shard == s) - 100 / 7) <= 2 for s in counts)


def test_the_number_of_ranges_changes_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    placed = lambda: sorted(tuple(r) for r in sharding.shard_documents(docs).select("doc_id", "shard", "slot").collect())
    want = placed()
    monkeypatch.setattr(sharding, "LEAST_BINS", 3)
    assert placed() == want
    monkeypatch.setattr(sharding, "BIN_ROWS", 2)
    assert placed() == want
