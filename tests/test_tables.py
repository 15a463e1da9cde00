"""CSV with awkward rows, and writes that happen wholly or not at all."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.operators import quality
from ringside.sources import tables

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("missing", T.DoubleType())])


def test_quoted_breaks_bad_rows_and_gapless_numbers(spark, tmp_path):
    one = 'a,n,more\nplain,1,x\n"two\nlines, ""quoted""",2,y\nshort,3\nlong,4,z,w\nwrong,five,v\n"",,\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text(one)
    (tmp_path / "in" / "2.csv").write_text("n,a,more\n7,other order,q\n".replace("n,a,more", "a,n,more").replace("7,other order", "second file,7"))
    rows = sorted(tables.read_csv(spark, str(tmp_path / "in"), SCHEMA, corrupt="bad").collect(), key=lambda r: r._ord)
    assert [r._ord for r in rows] == list(range(7))
    assert [(r.a, r.n, r.missing) for r in rows] == [("plain", 1, None), ('two\nlines, "quoted"', 2, None), ("short", 3, None), ("long", 4, None), ("wrong", None, None), (None, None, None), ("second file", 7, None)]
    assert [r.bad is not None for r in rows] == [False, False, True, True, True, False, False]
    assert "long,4,z,w" in rows[3].bad and rows[4].bad.startswith("wrong,five")
    assert tables.read_csv(spark, str(tmp_path / "in"), SCHEMA).columns == ["a", "n", "missing", "_ord"]


def test_numbers_run_on_over_many_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    k = 0
    for f in range(5):
        n = 900 + 100 * f
        (tmp_path / "in" / f"{f}.csv").write_text("a,n\n" + "".join(f'"row\n{k + i}",{k + i}\n' for i in range(n)))
        k += n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = tables.read_csv(spark, str(tmp_path / "in"), SCHEMA)
        assert df.rdd.getNumPartitions() >= 2
        got = df.select("n", "_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.n, r._ord) for r in got) == [(i, i) for i in range(k)]


def three(spark, say, fail=None):
    frame = lambda name: spark.range(5).select("id", F.lit(f"{say} {name}").alias("text"))
    out = {k: frame(k) for k in ("one", "two", "three")}
    if fail:
        out[fail] = out[fail].withColumn("text", F.when(F.col("id") == 3, F.raise_error(F.lit("planted"))).otherwise(F.col("text")))
    return out


NONE = "select 'fine' as check, 0 as violations"


def says(spark, folder):
    return {k: {r.text for r in spark.read.parquet(f"{folder}/{k}.parquet").collect()} for k in ("one", "two", "three")}


def whole(say):
    return {k: {f"{say} {k}"} for k in ("one", "two", "three")}


def test_a_failing_third_write_leaves_the_old_tables(spark, tmp_path):
    folder = str(tmp_path / "out")
    none = lambda t: spark.sql(NONE)
    tables.write_if_valid(spark, three(spark, "old"), folder, none)
    assert says(spark, folder) == whole("old")
    with pytest.raises(Exception, match="planted"):
        tables.write_if_valid(spark, three(spark, "new", fail="three"), folder, none)
    assert says(spark, folder) == whole("old")
    with pytest.raises(ValueError, match="bad: 2"):
        tables.write_if_valid(spark, three(spark, "new"), folder, lambda t: spark.sql("select 'bad' as check, 2 as violations"))
    assert says(spark, folder) == whole("old") and [p.name for p in tmp_path.iterdir()] == ["out"]
    tables.write_if_valid(spark, three(spark, "new"), folder, none)
    assert says(spark, folder) == whole("new") and [p.name for p in tmp_path.iterdir()] == ["out"]


@pytest.mark.parametrize("stop", range(1, 6))
def test_a_commit_that_stops_anywhere_is_ended(spark, tmp_path, monkeypatch, stop):
    folder, move, moves = str(tmp_path / "out"), tables._move, []
    none = lambda t: spark.sql(NONE)
    tables.write_if_valid(spark, three(spark, "old"), folder, none)

    def stops(*a):
        moves.append(a)
        if len(moves) > stop:  # the first move is the commit
            raise KeyboardInterrupt
        move(*a)

    monkeypatch.setattr(tables, "_move", stops)
    with pytest.raises(KeyboardInterrupt):
        tables.write_if_valid(spark, three(spark, "new"), folder, none)
    monkeypatch.setattr(tables, "_move", move)
    tables.settle(spark, folder)
    assert says(spark, folder) == whole("new") and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_the_integrity_report_scans_each_table_once(spark, tmp_path):
    rng = random.Random(1)
    some = lambda n, k: [rng.choice([*map(str, range(k)), None]) for _ in range(n)]
    shapes = {"events": (["event_id"], 30), "fighters": (["fighter_id"], 40), "fights": (["fight_id", "event_id", "fighter_1_id", "fighter_2_id", "fighter_1_result", "fighter_2_result"], 80), "rounds": (["fight_id", "fighter_id", "round"], 150)}
    rows = {}
    for name, (cols, n) in shapes.items():
        own = [[rng.choice(["W", "L", "D", "NC", None]) for _ in range(n)] if "result" in c else some(n, 60) for c in cols]
        rows[name] = list(zip(*own))
        spark.createDataFrame(rows[name], ", ".join(f"{c} string" for c in cols)).write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / name)) for name in shapes]
    report = quality.etl_integrity(*frames)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4
    got = {r["check"]: r.violations for r in report.collect()}
    events, fighters, fights, rounds = rows.values()
    known = lambda table: {r[0] for r in table if r[0] is not None}
    extra = lambda keys: len(keys) - len(set(keys))
    lost = lambda values, among: sum(v is not None and v not in among for v in values)
    want = {f"fights without {c}": sum(r[k] is None for r in fights) for k, c in enumerate(shapes["fights"][0][:4])}
    want |= {f"rounds without {c}": sum(r[k] is None for r in rounds) for k, c in enumerate(shapes["rounds"][0])}
    want |= {"impossible results": sum((r[4], r[5]) not in {("W", "L"), ("L", "W"), ("D", "D"), ("NC", "NC")} for r in fights)}
    want |= {"duplicate event_id": extra(events), "duplicate fighter_id": extra(fighters), "duplicate fight_id": extra([r[0] for r in fights]), "duplicate fight_id, fighter_id, round": extra(rounds)}
    want |= {"fights of unknown events": lost([r[1] for r in fights], known(events)), "fights of unknown fighters (1)": lost([r[2] for r in fights], known(fighters)), "fights of unknown fighters (2)": lost([r[3] for r in fights], known(fighters))}
    want |= {"rounds of unknown fights": lost([r[0] for r in rounds], known(fights)), "rounds of unknown fighters": lost([r[1] for r in rounds], known(fighters))}
    assert got == want
