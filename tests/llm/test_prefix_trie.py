"""The trie against a plain one over lists of turns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ringside.llm import prefix_trie, queries


def rebuilt(rows):
    """{conv: turns} as the query wants them."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1], r[2] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    heads = lambda c: zlib.crc32(str(c).encode()) % 6
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: heads(c)] + t[heads(c) :] for c, t in own.items()}


def plain(convs):
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        childless = [p for p in under if not any(len(q) == len(p) + 1 and q[:-1] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(children), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, 2, "s") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string, at int, size int, said string")


AWKWARD = (
    [(c, t, "user" if t % 2 else "bot", f"text {t} {c % 3 if t > 3 else ''}") for c in (100, 101, 102, 103, 104, 105, 7, 207, 299) for t in range(1 + c % 7)]
    + [(100, None, None, None), (110, None, "user", ""), (110, None, "user", ""), (111, 0, None, "x"), (111, 0, "", "x"), (-5, 3, "user", "négative 😀"), (-105, 1, "user", "y"), (-100, 1, "a", "base")]
    + [(None, 1, "user", "of none"), (500, 1, "user", "z" * 100_000), (501, 1, "user", "z" * 100_000), (502, 2, "u", "abc"), (503, 2, "ua", "bc"), (503, 9, "", None)]
)


def test_rebuilt_conversations(spark):
    found = queries.prefix_trie_of(frame(spark, AWKWARD))
    assert ours(found) == plain(rebuilt(AWKWARD))


def test_given_conversations(spark):
    """Branches at every depth, repeats, one that is the prefix of others, without rebuilding."""
    convs = {c: [("u", f"{c // 4 ** (5 - d) % 4 if d < 5 else c % 9} {'m' * d}") for d in range(c % 8)] for c in range(400)}
    convs |= {1000 + k: [("u", "same"), ("b", "answer"), ("u", "more")] for k in range(300)} | {5000 + k: [("u", str(d)) for d in range(60)] + [("u", f"tail {k}")] for k in range(5)}
    rows = [(c, t, r, x) for c, told in convs.items() for t, (r, x) in enumerate(told)]
    turns = prefix_trie.turns(frame(spark, rows))
    members = spark.createDataFrame([(c,) for c in convs], "conv long")
    assert ours(prefix_trie.prefix_trie(turns, members)) == plain(convs)
    assert ours(prefix_trie.prefix_trie(turns)) == plain({c: t for c, t in convs.items() if t})


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    convs = {c: [("u", "same")] for c in range(-20, 40)}
    rows = [(c, 0, "u", "same") for c in convs]
    assert ours(prefix_trie.prefix_trie(prefix_trie.turns(frame(spark, rows)))) == plain(convs)


def test_empty_table(spark):
    assert queries.prefix_trie_of(frame(spark, AWKWARD).filter(F.lit(False))).count() == 0


def test_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ours(queries.op11_prefix_trie(spark, small)) == plain(rebuilt(rows))
