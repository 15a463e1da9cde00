"""N-gram buckets, weights and draws against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ringside.llm import importance

from .fixtures import ROWS, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, buckets=10_000):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(rows, target, percent=5, least=20):
    """(doc_id, n_words, n_features, weight, score, rank) of every row."""
    raw, wanted = Counter(), Counter()
    for _, text in rows:
        raw.update(grams(text)[1])
    for text in target:
        wanted.update(grams(text)[1])
    s, t = raw.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    out = []
    for i, text in rows:
        n, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(([*r, ranks.get(id(r))] for r in out), key=str)


def ours(df):
    return sorted((list(r) for r in df.collect()), key=str)


def test_awkward_documents(spark):
    target = ["the lazy dog jumps", None, "", "fox über den Deich"]
    found = importance.resample(documents(spark), spark.createDataFrame([(t,) for t in target], "text string"), percent=60, least_words=2)
    assert ours(found) == plain([(r[0], r[1]) for r in ROWS], target, 60, 2)


def test_long_words_and_texts_in_stretches(spark, monkeypatch):
    """Words longer than the table, non-ASCII letters, and texts that are cut into stretches."""
    rng = np.random.default_rng(3)
    words = ["a", "B", "cc", "é", "x" * 300, "日本語", "y" * 700, "0", "Zz"]
    texts = [" ".join(rng.choice(words, n)) + end for n in (0, 1, 2, 3, 7, 8, 9, 10, 50, 301) for end in ("", " ", ".\n")]
    whole = [[b for d, b, _ in importance._found(importance.pa.array([t.encode()]), 997) for b in b] for t in texts]
    for words_each in (2, 3, 8):
        monkeypatch.setattr(importance, "STRETCH", 40)
        monkeypatch.setattr(importance._stretches, "__defaults__", (words_each,))
        for t, first in zip(texts, whole):
            found = list(importance._found(importance.pa.array([t.encode()]), 997))
            assert sorted(b for _, many, _ in found for b in many) == sorted(first) == sorted(grams(t, 997)[1])
            assert sum(int(told.sum()) for _, _, told in found) == grams(t)[0]


def test_large_ids_sort_by_keys():
    """Too many words for one number a suffix."""
    ids = np.array([5, 3 << 20, 5, 3 << 20, 7, 1 << 22, 7], np.int64)
    left = np.array([4, 3, 2, 1, 3, 2, 1])
    for n, ones, run, places in importance._runs(ids, left):
        of = {}
        for r, p in zip(run, places):
            of.setdefault(tuple(ids[p : p + n]), set()).add(r)
        assert all(len(v) == 1 for v in of.values()) and len(of) == len(ones) == len({min(v) for v in of.values()})
        assert len(places) == sum(left >= n)


def test_ranks_over_many_ranges(spark):
    """Thousands of rows, ties and repeats, against a plain sort."""
    rows = [(k // 2 if k % 3 else 7, f"{'alpha beta gamma ' * 7} {k % 5}") for k in range(3000)]
    target = ["alpha beta 3"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert ours(importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))) == plain(rows, target)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert importance.resample(empty, empty.select("text")).count() == 0
    assert importance.resample(documents(spark), empty.select("text")).count() == len(ROWS)


def test_drawn_rows_keep_their_columns(spark):
    docs = documents(spark, [r for r in ROWS if r[0] not in (6, None)])
    kept = importance.drawn(docs, docs.select("text"), percent=50, least_words=2)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
