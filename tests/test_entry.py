"""The driver's contract."""

import importlib


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len([q for q in found if not q.startswith("op")]) > 50


def test_sequential_and_model_queries_run(spark, small):
    from ringside import queries

    for name in ("glicko2", "glicko2_metrics", "schedule_model"):
        assert queries.queries()[name](spark, small).count() > 0
    assert queries.queries()["ratings_dq"](spark, small).filter("violations > 0").count() == 7  # each check meets its planted rows
