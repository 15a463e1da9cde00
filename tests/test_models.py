"""Exact medians and batched fits against plain versions and MLlib."""

import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ringside.operators import evaluate, models, select


def test_medians_of_many_groups(spark):
    rng = random.Random(5)
    groups = {
        "even": [1.0, 2.0],
        "odd": [3.0, -1.0, 2.5],
        "ties": [7.0] * 500 + [rng.random() for _ in range(499)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(701)],
        "close": [1.0 + k * 2.0**-52 for k in range(801)],
        "zeros": [0.0, -0.0, 0.0, -1e-320, 5e-324],
        "infinite": [float("inf"), float("-inf"), 1.0, 2.0, float("inf")],
        "one": [42.0],
        "whole": [float(rng.randrange(10)) for _ in range(2000)],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["n"], r["median"]) for r in select.medians(df, ["g"], "v").collect()}
    assert got == {g: (len(own), pytest.approx(statistics.median(own), rel=1e-15)) for g, own in groups.items()}
    assert select.medians(df.withColumn("g", F.lit(None).cast("string")), ["g"], "v").count() == 1
    assert select.medians(df.limit(0), ["g"], "v").count() == 0


def test_a_task_hands_on_bins_not_values(spark):
    """The largest shuffle of a round has a row a bin and task at most."""
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    first = df.groupBy("g", select._power(F.col("v")).alias("bin")).count()
    assert first.count() < 40
    want = df.agg(F.median("v")).first()[0]
    assert select.medians(df, ["g"], "v").first()["median"] == want


def data(spark, n=900):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(5, 30) if rng.random() > 0.2 else None, float(rng.randrange(4))
        y = int(rng.random() < 1 / (1 + 2.718281828 ** -(0.8 * a - 0.02 * (b or 0) + 0.3 * c)))
        rows.append((k, date(2000, 1, 1) + timedelta(days=k), a, b, c, y, rng.random()))
    return spark.createDataFrame(rows, "fight_id long, date date, a double, b double, c double, target int, elo_probability double")


def by_mllib(train, features):
    """Coefficients and intercept of MLlib on imputed and scaled features."""
    prep = models.prepare(train, features)
    x = VectorAssembler(inputCols=[f"__f_{n}" for n in prep.names], outputCol="x").transform(prep.apply(train)).withColumn("y", F.col("target").cast("double"))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / train.count(), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-12).fit(x)
    return prep.names, list(fitted.coefficients), fitted.intercept


def test_all_fits_equal_those_of_mllib(spark):
    df = data(spark)
    own = {"one": ["a"], "two": ["a", "b"], "all": ["a", "b", "c"]}
    rows = df.withColumn("member", F.expr("filter(array(case when fight_id < 300 then 3 end, case when fight_id < 700 then 8 end), k -> k is not null)"))
    fits = models.fit_all(rows, {3: own, 8: own})
    for (s, name), fit in fits.items():
        names, weights, intercept = by_mllib(df.filter(f"fight_id < {300 if s == 3 else 700}"), own[name])
        assert fit.preparation.names == names
        assert fit.coefficients == pytest.approx(weights, abs=1e-6) and fit.intercept == pytest.approx(intercept, abs=1e-6)


def jobs(spark, run):
    group = f"fits-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return found


def test_jobs_dont_grow_with_folds_or_models(spark):
    df = data(spark).persist()
    own = {"one": ["a"], "two": ["a", "b"], "all": ["a", "b", "c"]}
    few = jobs(spark, lambda: models.temporal_experiment(df, date(2001, 1, 1), 1, {"all": own["all"]}))
    many = jobs(spark, lambda: models.temporal_experiment(df, date(2000, 3, 1), 1, own, folds=spark.createDataFrame([(f"f{k}", date(2000, 3 + k, 1), date(2000, 4 + k, 1)) for k in range(8)], "fold string, start date, end date")))
    assert many <= few + 12  # rounds of medians and Newton steps differ with the data


def test_predictions_equal_those_of_single_fits(spark):
    df = data(spark)
    told, weights = models.temporal_experiment(df, date(2001, 1, 1), 1, {"base": [], "two": ["a", "b"]})
    got = {(r.model, r.fight_id): r.p for r in told.collect()}
    for start, end in ((date(2001, 1, 1), date(2002, 1, 1)), (date(2002, 1, 1), date(2003, 1, 1))):
        fit = models.fit_logit(df.filter(F.col("date") < start), ["a", "b"])
        for r in fit.predict(df.filter((F.col("date") >= start) & (F.col("date") < end))).collect():
            assert got["two", r.fight_id] == pytest.approx(r.p, abs=1e-9)
            assert got["base", r.fight_id] == r.elo_probability
    assert {r.fold for r in weights.collect()} == {"2001-01-01", "2002-01-01"}


def test_missing_without_scaling_is_an_error(spark):
    with pytest.raises(ValueError, match="missing"):
        models.fit_logit(data(spark), ["a", "b"], scale=False)


def test_separable_classes_settle(spark):
    df = spark.createDataFrame([(float(k), int(k > 50)) for k in range(100)], "a double, target int")
    fit = models.fit_logit(df, ["a"])
    assert fit.coefficients == pytest.approx(by_mllib(df, ["a"])[1], abs=1e-6)


def test_named_folds_are_checked(spark):
    rows = spark.createDataFrame([(k, date(2000, 1, 1) + timedelta(days=40 * k)) for k in range(60)], "id int, date date")
    frame = lambda *f: spark.createDataFrame(f, "fold string, start date, end date")
    folds = frame(("early", date(2000, 2, 10), date(2001, 5, 1)), ("late", date(2003, 1, 1), date(2005, 1, 1)), ("middle", date(2001, 5, 1), date(2001, 5, 2)))
    got = {r.id: r.fold for r in evaluate.in_folds(rows, folds).collect()}
    want = {k: next((n for n, a, b in (("early", date(2000, 2, 10), date(2001, 5, 1)), ("late", date(2003, 1, 1), date(2005, 1, 1)), ("middle", date(2001, 5, 1), date(2001, 5, 2))) if a <= date(2000, 1, 1) + timedelta(days=40 * k) < b), None) for k in range(60)}
    assert got == want
    for wrong in (frame(("a", date(2000, 1, 1), date(2000, 1, 1))), frame(("a", date(2000, 1, 1), date(2001, 1, 1)), ("b", date(2000, 6, 1), date(2002, 1, 1))), frame(("a", date(2000, 1, 1), date(2001, 1, 1)), ("a", date(2001, 6, 1), date(2002, 1, 1))), frame(("a", None, date(2001, 1, 1)))):
        with pytest.raises(ValueError):
            evaluate.in_folds(rows, wrong)
