"""Block naming against plain grouping by text."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringside.llm import exact_dedup

from .fixtures import ROWS, documents


def plain(rows):
    """Every row's result by a dictionary of texts."""
    texts, top = Counter(t or "" for _, t in rows), {}
    for i, t in rows:
        if i is not None and (top.get(t or "") is None or i > top[t or ""]):
            top[t or ""] = i
    seen, out = set(), []
    for i, t in rows:
        t = t or ""
        kept = i == top.get(t) and t not in seen
        if kept:
            seen.add(t)
        out.append((i, top.get(t), texts[t], kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_awkward_documents(spark):
    assert ours(exact_dedup.duplicates(documents(spark))) == plain([(r[0], r[1]) for r in ROWS])


@pytest.mark.parametrize(("block", "route"), [(1, F.xxhash64), (3, F.length), (4, lambda c: F.lit(1))])
def test_short_blocks_and_collisions(spark, block, route):
    """Where blocks collide, the sort of whole blocks decides."""
    texts = ["abcabcabcabc", "abcabcabcabd", "abcabcabcab", "abc", "abd", "", None, "aaaaaaaaa", "aaaaaaaaaa", "aaaaaaaa", "\n\n\n", "\n\n", "😀😀😀a", "😀😀a", "é", "é"]
    rows = [(k % 23, texts[k * 7 % len(texts)]) for k in range(80)] + [(None, "abc"), (None, "lonely"), (None, "lonely")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(exact_dedup.duplicates(df, block=block, route=route)) == plain(rows)


def test_hot_text_and_tails(spark):
    """A third of all rows equal, and texts that differ in the last character only."""
    rows = [(k, "same text " * 900) for k in range(400)] + [(1000 + k, "x" * 9000 + str(k % 50)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(exact_dedup.duplicates(df, block=1000)) == plain(rows)


def test_empty_table(spark):
    assert exact_dedup.duplicates(documents(spark, [])).count() == 0


def test_whole_rows_stay(spark):
    docs = documents(spark)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert {r["text"] or "" for r in left.collect()} == {r[1] or "" for r in ROWS} and left.count() == len({r[1] or "" for r in ROWS})
