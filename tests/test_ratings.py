"""Ratings against hand-made figures, a plain loop, and properties."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ringside.operators import features, history, quality, ratings
from ringside.operators.ratings import EloConfig, GlickoWalk

SCHEMA = "fight_id long, date date, fighter_1_id long, fighter_2_id long, fighter_1_result string, fighter_2_result string, division string"
A, B, X, Y = 1, 2, 3, 4


def bouts(spark, rows):
    return spark.createDataFrame([(k, *r, *(("Lightweight",) if len(r) == 5 else ())) for k, r in enumerate(rows)], SCHEMA)


def walked(spark, rows, config=None, dialect=ratings.PRODUCTION):
    return sorted(ratings.elo(bouts(spark, rows), {"c": config or EloConfig()}, dialect).collect(), key=lambda r: (r.date, r.fight_id))


STEPS = [(date(2000, 1, 1), A, B, "W", "L"), (date(2004, 1, 1), A, X, "NC", "NC"), (date(2008, 1, 1), A, Y, "W", "L")]


def test_no_contest_stores_the_decayed_rating_in_production(spark):
    got = walked(spark, STEPS, EloConfig(half_life_years=4.0))
    assert (got[0].rating_1_after, got[0].rating_2_after) == (1532.0, 1468.0)
    assert (got[1].rating_1_before, got[1].rating_1_after) == (1516.0, 1516.0)
    assert got[2].rating_1_before == 1508.0


def test_no_contest_only_moves_the_clock_elsewhere(spark):
    got = walked(spark, STEPS, EloConfig(half_life_years=4.0), ratings.WIN_LOSS)
    assert got[1].rating_1_before == 1516.0 and got[2].rating_1_before == 1516.0


def test_draws(spark):
    rows = [(date(2000, 1, 1), A, B, "D", "D"), (date(2000, 2, 1), A, B, "W", "L")]
    assert [r.career_1 for r in walked(spark, rows)] == [0, 1]
    assert [r.career_1 for r in walked(spark, rows, None, ratings.WIN_LOSS)] == [0, 0]
    assert len(walked(spark, rows, None, ratings.SHARED_K)) == 1


def test_division_switch(spark):
    day = date(2000, 1, 1)
    rows = [(day + timedelta(k), A, B, "W", "L", d) for k, d in enumerate(["Lightweight", "Catch Weight", "Welterweight", "Welterweight", "Lightweight", None])]
    got = walked(spark, rows)
    assert [r.switch_1 for r in got] == [False, False, False, False, True, False]
    assert got[3].k_1 == 32.0 and got[4].k_1 == 64.0


def random_rows(n=300, people=12, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        one, two = rng.sample(range(people), 2)
        r = rng.choice([("W", "L"), ("L", "W"), ("D", "D"), ("NC", "NC")])
        out.append((date(2000, 1, 1) + timedelta(rng.randrange(1500)), one, two, *r, rng.choice(["Lightweight", "Welterweight", "Catch Weight", None])))
    return out


def test_plain_loop(spark):
    rows = random_rows()
    got = walked(spark, rows, EloConfig(half_life_years=1.0))
    rating, count, since, division, last = {}, {}, {}, {}, {}
    for k, (day, one, two, r1, r2, div) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        row = next(r for r in got if r.fight_id == k)
        eff, ks = [], []
        for f in (one, two):
            if div in ("Lightweight", "Welterweight") and division.get(f) in ("Lightweight", "Welterweight") and division[f] != div:
                since[f] = 0
            r = rating.get(f, 1500.0)
            eff.append(r if f not in last else 1500 + (r - 1500) * 0.5 ** ((day - last[f]).days / 365.25))
            ks.append(64 if count.get(f, 0) < 3 or since.get(f, 0) < 3 else 32)
        e = 1 / (1 + 10 ** ((eff[1] - eff[0]) / 400))
        s = {"W": 1, "L": 0, "D": 0.5}.get(r1)
        new = eff if s is None else [eff[0] + ks[0] * (s - e), eff[1] + ks[1] * (e - s)]
        assert (row.rating_1_before, row.rating_2_before) == pytest.approx(eff)
        assert (row.rating_1_after, row.rating_2_after) == pytest.approx(new)
        for f, r in zip((one, two), new):
            rating[f], count[f], since[f], last[f] = r, count.get(f, 0) + 1, since.get(f, 0) + 1, day
            division[f] = div or division.get(f)


def test_equal_k_is_zero_sum_and_prefixes_are_stable(spark):
    rows = random_rows(seed=2)
    got = walked(spark, rows, EloConfig(boosted_k=32.0))
    assert all(r.rating_1_after + r.rating_2_after == pytest.approx(r.rating_1_before + r.rating_2_before) for r in got)
    cut = sorted(r[0] for r in rows)[200]
    ids = [k for k, r in enumerate(rows) if r[0] < cut]
    part = ratings.elo(bouts(spark, rows).filter(F.col("date") < F.lit(cut)), {"c": EloConfig(boosted_k=32.0)})
    full = {r.fight_id: r for r in got}
    assert {r.fight_id: r.rating_1_before for r in part.collect()} == {k: full[k].rating_1_before for k in ids}


def test_configs_walk_apart(spark):
    rows = bouts(spark, random_rows(80))
    configs = ratings.half_life_configs()
    both = ratings.elo(rows, configs)
    for k in ("baseline", "half_life_2y"):
        own = ratings.elo(rows, {k: configs[k]})
        assert sorted(both.filter(F.col("config") == k).collect()) == sorted(own.collect())
    with pytest.raises(ValueError):
        EloConfig(half_life_years=0.0)


def test_validator_accepts_and_rejects(spark):
    rows = bouts(spark, random_rows(120))
    told = ratings.by_fighter(ratings.elo(rows, {"c": EloConfig(half_life_years=2.0)}), rows)
    assert quality.failures(quality.ratings(told, half_life_years=2.0)) == []
    broken = told.withColumn("rating_before", F.col("rating_before") + F.when(F.col("fight_id") == 60, 9).otherwise(0))
    assert quality.failures(quality.ratings(broken, half_life_years=2.0))


def test_glicko_published_example():
    got = GlickoWalk(tau=0.5).update((1500.0, 200.0, 0.06), [(1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 0.0)])
    assert got[0] == pytest.approx(1464.06, abs=0.02) and got[1] == pytest.approx(151.52, abs=0.02) and got[2] == pytest.approx(0.05999, abs=1e-4)


def test_glicko_uses_the_snapshot(spark):
    rows = bouts(spark, [(date(2000, 1, 1), A, B, "W", "L"), (date(2000, 2, 1), A, B, "D", "D"), (date(2000, 3, 1), B, A, "W", "L")])
    got = sorted(ratings.glicko2(rows).collect(), key=lambda r: r.date)
    assert len(got) == 2
    assert got[0].rating_1_after - 1500 == pytest.approx(1500 - got[0].rating_2_after)
    assert got[1].rating_2_before == pytest.approx(got[0].rating_1_after)


def test_history(spark):
    rows = [(date(2000, 1, k + 1), A, B, *r) for k, r in enumerate([("W", "L"), ("NC", "NC"), ("L", "W")])]
    values = {0: None, 1: 4.0, 2: None}
    long = features.sides(bouts(spark, rows), ["fight_id", "date"]).withColumn("v", F.when(F.col("fight_id") == 1, 4.0))
    got = sorted(history.fight_history(long, sums=["v"], means=["v"]).filter("fighter_id = 1").collect(), key=lambda r: r.date)
    assert values and [r.career_fights_before for r in got] == [0, 1, 2] and [r.wins_before for r in got] == [0, 1, 1]
    assert [r.nc_before for r in got] == [0, 0, 1] and [r.win_rate_before for r in got] == [None, 1.0, 0.5]
    assert [r.sum_v_before for r in got] == [None, None, 4.0] and [r.avg_v_before for r in got] == [None, None, 4.0]


def test_unknown_result_names_the_bout(spark):
    with pytest.raises(Exception, match="unknown result 'X' of 1"):
        walked(spark, [(date(2000, 1, 1), A, B, "X", "L")])


def test_one_task_for_each_config_and_one_walk_of_a_sweep(spark):
    from ringside.plans import experiments

    rows = bouts(spark, random_rows(80))
    configs = ratings.candidate_configs()
    rated = ratings.elo(rows, configs)
    places = rated.select("config", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) == len(configs) == len({r.p for r in places})
    swept = experiments.sweep(rows, configs, date(2000, 1, 1), 1, cutoff=date(2002, 1, 1))
    assert "MapInPandas" not in swept._jdf.queryExecution().toString()
    assert {r.fold for r in swept.collect()} == {"2000-01-01", "2001-01-01", "2002-01-01", "2003-01-01", "2004-01-01", "pooled", "test"}


def test_one_folder_for_each_config(spark, tmp_path):
    from ringside.plans import experiments

    configs = ratings.half_life_configs((None, 2.0))
    rated = ratings.elo(bouts(spark, random_rows(30)), configs, only=["expected_1"])
    experiments.write_by_config(rated, str(tmp_path / "rated"))
    assert {p.name for p in (tmp_path / "rated").iterdir() if p.is_dir()} == {f"config={k}" for k in configs}
    back = spark.read.parquet(str(tmp_path / "rated"))
    assert back.filter("config = 'baseline'").count() == 30 and back.count() == 60


def test_what_a_walk_gives_leaves_it_as_arrow(spark):
    rated = ratings.elo(bouts(spark, random_rows(50)), {"a": EloConfig(half_life_years=2.0)}, apart=True)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    got = rated.orderBy("date", "fight_id").collect()
    walk = ratings.EloWalk(EloConfig(half_life_years=2.0), ratings.PRODUCTION)
    rows = bouts(spark, random_rows(50)).orderBy("date", "fight_id").collect()
    want = [walk.step(r.date.toordinal(), r.fighter_1_id, r.fighter_2_id, r.fighter_1_result, r.fighter_2_result, r.division) for r in rows]
    assert [tuple(r[n] for n, _ in ratings.ELO_FIELDS) for r in got] == want
