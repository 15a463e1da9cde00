"""Metrics, calibration, folds and models on small rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ringside.operators import evaluate, models


def told(spark, pairs):
    return spark.createDataFrame([("m", y, p) for y, p in pairs], "model string, y int, p double")


def test_auc_with_ties(spark):
    row = evaluate.metrics(told(spark, [(1, 0.5), (0, 0.5), (1, 0.8), (0, 0.2)]), ["model"]).first()
    assert row.roc_auc == 0.875 and row.n == 4 and row.accuracy == 0.75


def test_auc_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(400)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.metrics(told(spark, rows), ["model"]).first().roc_auc == pytest.approx(want)


def test_one_class_has_no_auc(spark):
    assert evaluate.metrics(told(spark, [(1, 0.5), (1, 0.7)]), ["model"]).first().roc_auc is None


def test_calibration_edges(spark):
    got = {r.p: r.bin for r in told(spark, [(1, 0.0), (1, 0.1), (1, 0.3), (0, 1.0)]).select("p").collect() for r in evaluate.calibration(told(spark, [(1, r.p)]), ["model"]).withColumn("p", F.lit(r.p)).collect()}
    assert got == {0.0: 1, 0.1: 1, 0.3: 3, 1.0: 10}


def test_folds(spark):
    days = [date(2010, 12, 31), date(2011, 1, 1), date(2013, 12, 31), date(2014, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(evaluate.fold_start(F.col("d"), date(2011, 1, 1), 3)).collect()] == [None, date(2011, 1, 1), date(2011, 1, 1), date(2014, 1, 1)]


def test_weighted_pooling_differs_from_pooled(spark):
    rows = spark.createDataFrame([("m", "a", 1, 0.1, 0.2, 0.0, 1.0), ("m", "b", 3, 0.5, 0.4, 1.0, None), ("m", "pooled", 4, 9.0, 9.0, 9.0, 9.0)], "model string, fold string, n long, log_loss double, brier_score double, accuracy double, roc_auc double")
    got = evaluate.pooled_by_size(rows, ["model"]).first()
    assert (got.n, got.log_loss, got.accuracy, got.roc_auc) == (4, pytest.approx(0.4), 0.75, 1.0)


def test_preparation_and_logit(spark):
    rows = [(x, None if k % 5 == 0 else float(k), 1 if x + (k % 3) > 2 else 0) for k, x in enumerate([0.0, 1.0, 2.0, 3.0, 4.0] * 12)]
    df = spark.createDataFrame(rows, "x double, z double, target int")
    fitted = models.fit_logit(df, ["x", "z"])
    assert fitted.preparation.names == ["x", "z", "z__missing"]
    # the optimum of the penalised likelihood, by plain gradient descent
    import numpy as np

    z = np.array([r[1] if r[1] is not None else np.nan for r in rows])
    X = np.c_[[r[0] for r in rows], np.where(np.isnan(z), np.nanmedian(z), z), np.isnan(z)].astype(float)
    X = (X - X.mean(0)) / X.std(0)
    y = np.array([r[2] for r in rows], float)
    w, b = np.zeros(3), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(X @ w + b)))
        w, b = w - 0.01 * (X.T @ (p - y) + w), b - 0.01 * (p - y).sum()
    assert fitted.coefficients == pytest.approx(list(w), abs=1e-4) and fitted.intercept == pytest.approx(b, abs=1e-4)
    with pytest.raises(ValueError):
        models.fit_logit(df.filter("target = 1"), ["x"])


def test_temporal_experiment_skips_what_it_cannot_train(spark):
    rows = [(k, date(2000 + k // 10, 1, 1 + k % 10), float(k % 2), k % 2, 0.5) for k in range(40)]
    df = spark.createDataFrame(rows, "fight_id long, date date, f double, target int, elo_probability double")
    told, weights = models.temporal_experiment(df, date(2000, 1, 1), 1, {"base": [], "f": ["f"]})
    got = {(r.model, r.fold): r.n for r in evaluate.metrics(told, ["model", "fold"]).collect()}
    assert ("f", "2000-01-01") not in got and got[("f", "2001-01-01")] == 10 and got[("base", "2000-01-01")] == 10
    assert weights.count() == 3


def test_metrics_in_slices_against_all_pairs(spark, monkeypatch):
    """Rows of several groups are written once, shuffled in slices, and leave nothing behind."""
    import random
    from pathlib import Path

    from ringside.sources.tables import shared_folder

    rng = random.Random(3)
    for values in ([0.1, 0.25, 0.5, 0.8], None):  # few and many probabilities
        rows = [(rng.choice("ab"), rng.choice(["x", None]), rng.randrange(2), rng.choice(values) if values else rng.random()) for _ in range(300)]
        df = spark.createDataFrame(rows, "model string, fold string, y int, p double").withColumn("fold", F.array_compact(F.array("fold", F.lit("all"))))
        monkeypatch.setattr(evaluate, "SLICE_ROWS", 100)
        monkeypatch.setattr(evaluate, "TASK_ROWS", 30)
        shared = Path(shared_folder(spark).removeprefix("file:"))
        before = set(shared.rglob("*.parquet"))
        got = {(r.model, r.fold): r for r in evaluate.metrics(df, ["model", "fold"], many="fold").collect()}
        assert set(shared.rglob("*.parquet")) <= before
        assert set(got) == {(m, f) for m in "ab" for f in ("x", "all")}
        for (m, f), r in got.items():
            own = [(y, p) for k, g, y, p in rows if k == m and f in (g, "all")]
            pairs = [(p > q) + (p == q) / 2 for y, p in own if y for z, q in own if not z]
            assert r.n == len(own) and r.roc_auc == pytest.approx(sum(pairs) / len(pairs))
            assert r.brier_score == pytest.approx(sum((y - p) ** 2 for y, p in own) / len(own))
            assert r.accuracy == pytest.approx(sum((p >= 0.5) == (y == 1) for y, p in own) / len(own))
