"""Histories by stretches of time, and sweeps that go on where they stopped."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ringside.operators import evaluate, history, ratings
from ringside.plans import experiments

SCHEMA = "fight_id long, fighter_id long, date date, result string, v double, w long, rating_after double, career_fights_before int"


def rows(spark, n=700):
    rng, out = random.Random(3), []
    for k in range(n):
        who = 1 if rng.random() < 0.6 else rng.randrange(12)
        out.append((k, who, date(2000, 1, 1) + timedelta(days=rng.randrange(900)), rng.choice(["W", "L", "D", "NC", None]), rng.choice([None, rng.random()]), rng.choice([None, rng.randrange(9)]), rng.choice([None, rng.random()]), k))
    return spark.createDataFrame(out, SCHEMA)


def told(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-1.0).fillna(-1).collect())


@pytest.mark.parametrize("block", ["month", "year", "week"])
def test_stretches_give_the_same_figures(spark, block):
    df = rows(spark)
    names = dict(sums=["v", "w"], means=["v"])
    assert told(history.fight_history(df, **names).drop("result", "date")) == told(history.fight_history(df, **names, block=block).drop("result", "date"))
    assert told(history.performance_running(df, ["v", "w"]).drop("result", "date")) == told(history.performance_running(df, ["v", "w"], block).drop("result", "date"))
    plain, dealt = history.continuity(df).drop("result", "date"), history.continuity(df, block).drop("result", "date")
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))


def test_against_a_plain_walk(spark):
    got = {r.fight_id: r for r in history.fight_history(rows(spark), sums=["v"], means=["w"], block="month").collect()}
    past = {}
    for r in sorted(got.values(), key=lambda r: (r.fighter_id, r.date, r.fight_id)):
        own = past.setdefault(r.fighter_id, [])
        values = [x.v for x in own if x.v is not None]
        counts = [x.w for x in own if x.w is not None]
        assert r.career_fights_before == len(own) and r.wins_before == sum(x.result == "W" for x in own) and r.nc_before == sum(x.result == "NC" for x in own)
        assert r.sum_v_before == (pytest.approx(sum(values)) if values else None)
        assert r.avg_w_before == (pytest.approx(sum(counts) / len(counts)) if counts else None)
        own.append(r)


def test_a_fighter_of_many_fights_is_dealt_over_tasks(spark):
    df = spark.range(200_000).select(F.col("id").alias("fight_id"), F.lit(7).cast("long").alias("fighter_id"), F.date_add(F.lit(date(2000, 1, 1)), (F.col("id") % 3000).cast("int")).alias("date"), F.lit("W").alias("result"), F.lit(1.0).alias("v"))
    size = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = lambda block: sorted(r.n for r in history.fight_history(df, sums=["v"], means=[], block=block).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("sum_v_before")).collect())
        assert per_task(None) == [200_000]
        assert len(per_task("month")) > 2 and max(per_task("month")) < 100_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", size)
    most = history.fight_history(df, sums=["v"], means=[], block="month").agg(F.max("career_fights_before"), F.max("sum_v_before")).first()
    assert tuple(most) == (199_999, 199_999.0)


def test_latest(spark):
    df = rows(spark)
    got = {r.fighter_id: r.fight_id for r in history.latest(df).collect()}
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.date, r.fight_id)):
        want[r.fighter_id] = r.fight_id
    assert got == want
    assert history.latest(df).columns == df.columns


def test_close_probabilities_fall_into_many_ranges(spark):
    rng = random.Random(4)
    pairs = [(int(rng.random() < 0.5), 0.5 + rng.randrange(3000) * 1e-7) for _ in range(1500)]
    df = spark.createDataFrame([("m", y, p) for y, p in pairs], "model string, y int, p double")
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.metrics(df, ["model"]).first().roc_auc == pytest.approx(want)
    many = spark.range(100_000).select((0.5 + F.col("id") * 1e-9).alias("p"))
    sizes = [r["count"] for r in evaluate._ranges(many, "p", "bin").groupBy("bin").count().collect()]
    assert max(sizes) < 400


def test_a_sweep_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    fights = spark.createDataFrame([(k, date(2000, 1, 1) + timedelta(days=5 * k), *rng.sample("abcdef", 2), *rng.choice([("W", "L"), ("L", "W"), ("D", "D")]), None) for k in range(300)], "fight_id long, date date, fighter_1_id string, fighter_2_id string, fighter_1_result string, fighter_2_result string, division string")
    folder = str(tmp_path / "sweep")
    all_, walks, elo = ratings.candidate_configs(), [], ratings.elo

    def noted(bouts, configs, *a, **k):
        walks.append(sorted(configs))
        return elo(bouts, configs, *a, **k)

    monkeypatch.setattr(ratings, "elo", noted)
    some = {k: all_[k] for k in ("baseline_v0.1", "scale_200", "provisional_3")}
    assert experiments.resume_sweep(fights, some, folder) == list(some)
    more = some | {k: all_[k] for k in ("scale_600", "provisional_9")}
    assert experiments.resume_sweep(fights, more, folder) == ["scale_600", "provisional_9"]
    assert experiments.resume_sweep(fights, more, folder) == []
    changed = more | {"scale_200": ratings.EloConfig(scale=201.0)}
    assert experiments.resume_sweep(fights, changed, folder) == ["scale_200"]
    assert walks == [sorted(some), ["provisional_9", "scale_600"], ["scale_200"]]
    metrics = lambda df: sorted((r.config, r.fold, r.n, round(r.log_loss, 9)) for r in df.collect())
    whole = experiments.sweep(fights, changed, date(2001, 1, 1), 1)
    assert metrics(experiments.written_sweep(spark, folder, date(2001, 1, 1), 1)) == metrics(whole)
