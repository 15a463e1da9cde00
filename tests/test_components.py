"""Components against a plain search, and leagues that never meet."""

import random
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from ringside.operators import ratings
from ringside.operators.components import connected


def plain(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def test_components(spark):
    rng = random.Random(2)
    chain = [(1000 + k, 1001 + k) for k in range(60)]
    rng.shuffle(chain)
    star = [(5000, 5001 + k) for k in range(50)]
    sparse = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    edges = [*chain, *star, *sparse, (7, 7), (9999, 9999), (None, 3), (4, None), (1, 2), (2, 1)]
    got = connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == plain(edges)
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def bouts(spark, leagues):
    rng, rows = random.Random(6), []
    for k in range(600):
        league = rng.randrange(leagues)
        a, b = rng.sample(range(8), 2)
        w = rng.choice([("W", "L"), ("L", "W"), ("D", "D"), ("NC", "NC")])
        rows.append((k, date(2000, 1, 1) + timedelta(days=k // 2), f"{league}-{a}", f"{league}-{b}", *w, rng.choice(["Lightweight", "Catch Weight", None])))
    return spark.createDataFrame(rows, "fight_id long, date date, fighter_1_id string, fighter_2_id string, fighter_1_result string, fighter_2_result string, division string")


def test_leagues_apart_give_the_same_ratings(spark):
    df = bouts(spark, 6)
    configs = {"a": ratings.EloConfig(), "b": ratings.EloConfig(half_life_years=1.0)}
    whole, apart = ratings.elo(df, configs), ratings.elo(df, configs, apart=True)
    assert whole.columns == apart.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))
    assert sorted(map(str, ratings.glicko2(df).collect())) == sorted(map(str, ratings.glicko2(df, apart=True).collect()))


def test_leagues_are_walked_in_several_tasks(spark):
    configs = {"a": ratings.EloConfig(), "b": ratings.EloConfig(base_k=10.0)}
    tasks = lambda df: df.withColumn("task", F.spark_partition_id()).groupBy("config", "task").count().collect()
    assert len(tasks(ratings.elo(bouts(spark, 6), configs))) == 2
    found = tasks(ratings.elo(bouts(spark, 6), configs, apart=True))
    assert len(found) >= 6 and len({r["task"] for r in found}) == len(found)


def test_rounds_go_over_ids_not_edges(spark):
    """Many bouts of a few competitors leave a spanning forest for the rounds."""
    from ringside.operators import components

    edges = pd.DataFrame([(max(a, b), min(a, b)) for a in range(40) for b in range(40) for _ in range(3)], columns=["u", "v"])
    left = pd.concat(components._forest(iter([edges[:2000], edges[2000:]])))
    assert len(left) < 2 * 40 and set(left["u"]) | set(left["v"]) == set(range(40)) and set(plain(left.values.tolist()).values()) == {0}


def test_queries_walk_leagues_apart(spark):
    """A table of several leagues isn't walked in one task."""
    from ringside.plans import experiments

    df = bouts(spark, 5)
    seen = []
    plain_elo = ratings.elo

    def noted(*a, **b):
        seen.append(b.get("apart"))
        return plain_elo(*a, **b)

    ratings.elo = noted
    try:
        experiments.sweep(df, {"a": ratings.EloConfig()}, date(2000, 1, 1), 1)
    finally:
        ratings.elo = plain_elo
    assert seen == [True]


def test_a_bout_without_one_side_stays_with_the_other(spark):
    rows = [(0, date(2000, 1, 1), None, "x", "L", "W", None), (1, date(2000, 1, 2), "x", "y", "W", "L", None), (2, date(2000, 1, 3), "p", "q", "W", "L", None)]
    df = spark.createDataFrame(rows, bouts(spark, 2).schema)
    whole, apart = ratings.elo(df, {"a": ratings.EloConfig()}), ratings.elo(df, {"a": ratings.EloConfig()}, apart=True)
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))


def test_configs_of_many_leagues_share_a_task(spark):
    """Bouts are shuffled once for all configs, not once for each."""
    configs = ratings.candidate_configs()
    assert ratings._packs(list(configs), 1, 12) == [[k] for k in configs] and ratings._packs(list(configs), 360, 12) == [list(configs)]
    df = bouts(spark, 20)
    apart = ratings.elo(df, configs, apart=True).withColumn("task", F.spark_partition_id())
    found = apart.groupBy("task").agg(F.countDistinct("config").alias("n")).collect()
    assert len(found) > 4 and {r["n"] for r in found} == {len(configs)}
    whole = ratings.elo(df, configs)
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.drop("task").collect()))


def test_leagues_are_sought_once(spark, monkeypatch):
    df = ratings.with_leagues(bouts(spark, 6))
    monkeypatch.setattr(ratings, "connected", None)
    configs = {"a": ratings.EloConfig()}
    assert sorted(map(str, ratings.elo(df, configs, apart=True).collect())) == sorted(map(str, ratings.elo(df.drop("league"), configs).collect()))
