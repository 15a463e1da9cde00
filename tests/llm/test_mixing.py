from collections import defaultdict

import numpy as np
import pytest

from ringside.llm import mixing, queries

from .fixtures import documents


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Sources in order, null last; what a target can't take is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total, spent = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            give = min(left * weight[s] / total, cap * sizes[s] - target[s])
            target[s] += give
            spent += give
            if cap * sizes[s] - target[s] < 1e-9:
                open_.discard(s)
        left -= spent
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 500, "d": 3, None: 20}, {"z": 7}, {"a": 0, "b": 10}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_query(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op2_mixing(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split())
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
    assert target == pytest.approx(brute_targets(sizes))
    assert all(r.source_size == sizes[docs[r.doc_id].source] for r in rows)
    # whole documents, of which a source has ten here
    assert all(abs(taken[s] - target[s]) <= max(20, 0.05 * target[s]) for s in target)
    again = queries.op2_mixing(spark, small).collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}


def test_rates_solve_the_dual():
    mass, tilt = np.array([5.0, 30.0, 2.0]), np.array([1.0, 2.5, 0.3])
    for target in (1.0, 40.0, 90.0, 111.0):
        x = mixing._level(target, mass, tilt, 3.0)
        assert (mass * np.minimum(x * tilt, 3.0)).sum() == pytest.approx(target)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert len({r.copies for r in rows if r.id == 6}) == 1
    assert all(r.taken == 0 and r.copies == 1 for r in rows if r["size"] == 0)
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.take(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.copies for r in rows)


def test_one_id_in_two_sources_and_columns_of_any_name(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "a", "en", "x"), (1, text, "b", "en", "y"), (1, "another text of this id", "b", "en", "z"), (None, text, None, None, "u"), (2, "w " * 90, "c", "de", "v"), (2, "w " * 90, "c", "de", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, __copy string").withColumnsRenamed({}).selectExpr("*", "1 as copies", "2 as id", "3 as `row`", "4 as class", "5 as text_hash")
    plan = mixing.mix(docs).collect()
    want = sorted((str(r.id), r.text_hash, r.source) for r in plan for _ in range(r.copies))
    kept = mixing.take(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.copies for r in plan)
    named = kept.selectExpr("cast(doc_id as string) as i", "xxhash64(text) as h", "coalesce(concat('s', source), 'n') as s").collect()
    assert sorted((str(r.i), r.h, r.s) for r in named) == want
    of = {(r.id, r.source, r.text_hash): r.copies for r in plan}
    assert len(of) == 5


def test_targets_of_many_sources(spark):
    import random

    rng = random.Random(9)
    sizes = {f"s{k}": rng.choice([0, 1, 7, 50, 900, 20_000]) for k in range(700)} | {None: 5}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_repeated_rows_meet_the_target(spark):
    """200 equal rows of one source: their copies differ by one at most, and the targets are met."""
    rows = [(1, "ten words " * 5, "a", "en", k // 100) for k in range(200)]
    rows += [(1000 + k, f"w{k} " * (1 + k % 19), "b", "en", 0) for k in range(200)] + [(2000 + k, f"v{k} " * (1 + k % 23), "c", "de", 0) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, more int")
    plan = mixing.mix(docs).collect()
    assert len(plan) == 600
    for s in "abc":
        own = [r for r in plan if r.source == f"s{s}"]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
        assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in own)
    same = [r.copies for r in plan if r.id == 1]
    assert len(same) == 200 and max(same) - min(same) <= 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.id, r.copies) for r in again) == sorted((r.id, r.copies) for r in plan)
    kept = mixing.take(docs).collect()
    taken = {}
    for r in kept:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {i: n for i in {r.id for r in plan} if (n := sum(r.copies for r in plan if r.id == i))}
    # rows alike in id and text, but not in another column, are taken equally often but for one copy each
    halves = [sum(r.doc_id == 1 and r.more == k for r in kept) for k in (0, 1)]
    assert sum(halves) == sum(same) and all(min(same) * 100 <= h <= max(same) * 100 for h in halves)


def test_many_repeats_of_one_row(spark):
    """More repeats than one array of numbers holds."""
    docs = spark.range(30_000).selectExpr("7 as doc_id", "'one two three' as text", "'a' as source", "'en' as lang").union(spark.range(50).selectExpr("id", "'some other words here'", "'b'", "'en'"))
    plan = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    assert {r["source"]: r["count(1)"] for r in plan} == {"sa": 30_000, "sb": 50}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 4 for r in plan)


def test_too_many_classes_fail(spark):
    docs = spark.range(mixing.CLASSES + 1).selectExpr("id as doc_id", "'one two' as text", "'a' as source", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="classes"):
        mixing.mix(docs).count()
