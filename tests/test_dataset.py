"""The raw tables end to end, with awkward rows, and the key operators."""

import csv

import pytest
from pyspark.sql import functions as F

from ringside.operators import keys, quality
from ringside.plans import dataset
from ringside.schemas import RAW
from ringside.sources import tables

U = "http://site/x/"
ID = lambda k: f"{k:016x}"
PAIR = ["5 of 10", "7 of 9", "1 of 2", "1 of 1", "0 of 0", "2 of 3", "1 of 4", "0 of 0", "2 of 2"]


def stats(event, bout, fighter, n, head="1 of 2", ctrl="1:35"):
    return dict(zip(RAW["fight_stats"].names, [event, bout, f"Round {n}", fighter, "1", "5 of 10", "50%", "7 of 9", "1 of 2", "---", "0", "0", ctrl, head, *["0 of 0"] * 5]))


def raw():
    return {
        "event_details": [["Night 1", U + ID(1), "August 22, 2020", "Here"], ["Night 1", U + ID(2), "August 23, 2020", "There"], ["Night 2", U + ID(3), "January 2, 2021", "Here"], ["Lost", "none", "January 2, 2021", "Here"]],
        "fighter_details": [["Ann", "Bee", "", U + ID(11)], ["Cy", "Dee", "", U + ID(12)], ["Ann", "Bee", "", U + ID(13)], ["Kai", "Kamaka III", "", U + ID(14)], ["", "Solo", "", U + ID(15)]],
        "fight_details": [["Night 1", "Ann Bee vs. Cy Dee", U + ID(21)], ["Night 1", "Ann Bee vs. Cy Dee", U + ID(22)], ["Night 2 ", "Dee Cy vs Kai Kamaka", U + ID(23)], ["UFC - Road to UFC 4.6", "Solo vs. Ann Bee", U + ID(24)], ["Night 2", "Ann Bee vs. Solo", U + ID(21)]],
        "fight_results": [[e, "", o, "Lightweight Bout", "Decision", "3", "5:00", "3 Rnd", "Ref", "", U + ID(k)] for e, o, k in (("Night 1", "W/L", 21), ("Night 1", "D/D", 22), ("Night 2", "NC/NC", 23), ("UFC - Road to UFC 4.6", "L/W", 24))],
        "fight_stats": [stats("Night 1", "Ann Bee vs. Cy Dee", f, n) for _ in range(2) for f in ("Ann Bee", "Cy Dee") for n in (1, 2)] + [stats("Night 2", "Dee Cy vs Kai Kamaka", "Kai Kamaka", 1)] * 2 + [dict.fromkeys(RAW["fight_stats"].names, "") | {"EVENT": "Night 2"}],
    }


def put(folder, rows):
    for name, own in rows.items():
        with open(f"{folder}/{name}.csv", "w", newline="") as f:
            out = csv.DictWriter(f, RAW[name].names)
            out.writeheader()
            for r in own:
                out.writerow(r if isinstance(r, dict) else dict(zip(RAW[name].names, r)))
    return str(folder)


def test_build_and_write(spark, tmp_path):
    folder = put(tmp_path, raw())
    dataset.run(spark, folder, f"{folder}/out")
    got = {k: tables.table(spark, f"{folder}/out", k).collect() for k in ("fighters", "events", "fights", "round_stats")}
    assert {r.fighter_id for r in got["fighters"]} == {ID(k) for k in (11, 12, 13, 14, 15)}
    events = {r.event_name: r for r in got["events"]}
    assert set(events) == {"Night 1", "Night 2", "UFC - Road to UFC 4.6"} and events["Night 1"].event_id == ID(1)
    assert events["UFC - Road to UFC 4.6"].event_id.startswith("synthetic_") and str(events["UFC - Road to UFC 4.6"].date) == "2025-08-22"
    fights = {r.fight_id: r for r in got["fights"]}
    assert len(fights) == 4 and fights[ID(21)].event_id == ID(1)
    assert (fights[ID(23)].fighter_1_id, fights[ID(23)].fighter_2_id) == (ID(12), ID(14))
    assert fights[ID(24)].fighter_1_id == ID(15) and fights[ID(24)].fighter_1_result == "L"
    rounds = sorted((r.fight_id, r.fighter_id, r["round"]) for r in got["round_stats"])
    assert rounds == sorted([(ID(k), ID(f), n) for k in (21, 22) for f in (11, 12) for n in (1, 2)] + [(ID(23), ID(14), 1)])


def test_nothing_is_written_if_a_check_fails(spark, tmp_path):
    rows = raw()
    rows["fight_results"][0][2] = "W/W"
    folder = put(tmp_path, rows)
    with pytest.raises(ValueError, match="impossible results"):
        dataset.run(spark, folder, f"{folder}/out")
    assert not (tmp_path / "out").exists()


def test_conflicting_rounds_and_uneven_blocks_fail(spark, tmp_path):
    rows = raw()
    rows["fight_stats"].append(stats("Night 2", "Dee Cy vs Kai Kamaka", "Kai Kamaka", 1, head="2 of 2"))
    with pytest.raises(ValueError, match="conflicting"):
        dataset.build(spark, put(tmp_path, rows))
    rows = raw()
    rows["fight_stats"].insert(0, stats("Night 1", "Ann Bee vs. Cy Dee", "Ann Bee", 3))
    with pytest.raises(Exception, match="evenly"):
        dataset.build(spark, put(tmp_path, rows))


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        dataset.build(spark, str(tmp_path))


def test_blocks(spark):
    rows = spark.createDataFrame([("k", n) for n in range(4)], "key string, _ord int")
    owners = spark.createDataFrame([("k", "a", 0), ("k", "b", 1)], "key string, owner string, _ord int")
    assert {r._ord: r.owner for r in keys.assign_blocks(rows, owners, ["key"], "owner").collect()} == {0: "a", 1: "a", 2: "b", 3: "b"}


def test_name_map_first_wins(spark):
    people = spark.createDataFrame([("1", "A", "B", 0), ("2", "B", "A", 1), (None, "C", "D", 2), ("4", "C", "D", 3)], "fighter_id string, first_name string, last_name string, _ord int")
    assert {r.name_key: r.id for r in keys.name_map(people).collect()} == {"a b": "1", "b a": "1", "c d": None, "d c": None}


def test_keys(spark):
    df = spark.createDataFrame([(1, "x", 0), (1, None, 1), (2, "y", 2), (None, "z", 3)], "k int, v string, _ord int")
    assert {(r.k, r.v) for r in keys.first_wins(df, ["k"]).collect()} == {(1, "x"), (2, "y"), (None, "z")}
    assert keys.conflicting_duplicates(df, ["k"], ["v"]).collect()[0].conflicts == 1
    assert keys.duplicates(df, ["k"]).count() == 2
    with pytest.raises(ValueError):
        keys.lookup(df, df, ["k"])
    assert not keys.same_keys(df, df.filter("k = 1"), ["k"]) and keys.same_keys(df.dropna(), df.dropna(), ["k"])


def test_contract_and_dates(spark):
    df = spark.createDataFrame([(1, "W"), (1, "X")], "fight_id int, result string")
    with pytest.raises(ValueError, match="missing"):
        quality.require(df, ["nothing"])
    with pytest.raises(ValueError, match="duplicate.*unknown"):
        quality.require(df, ["fight_id"], ["fight_id"], {"result": ["W", "L"]})
    fights = df.withColumn("event_id", F.lit("e"))
    none = spark.createDataFrame([], "event_id string, date date")
    with pytest.warns(UserWarning):
        assert tables.attach_dates(fights, none).count() == 2
    with pytest.raises(ValueError):
        tables.attach_dates(fights, none, missing="raise")


def test_an_event_with_two_dates_keeps_one_row_a_fight(spark):
    fights = spark.createDataFrame([(1, "e"), (2, "f"), (3, None)], "fight_id int, event_id string")
    events = spark.createDataFrame([("e", "2001-01-02", 0), ("e", "2001-01-01", 1), ("f", None, 2), ("f", "2002-02-02", 3)], "event_id string, date string, _ord int").withColumn("date", F.to_date("date"))
    with pytest.warns(UserWarning):
        got = {r.fight_id: str(r.date) for r in tables.attach_dates(fights, events).collect()}
    assert got == {1: "2001-01-02", 2: "None", 3: "None"}
    with pytest.warns(UserWarning):
        rows = tables.attach_dates(fights, events.drop("_ord")).collect()
    assert {r.fight_id: str(r.date) for r in rows} == {1: "2001-01-01", 2: "2002-02-02", 3: "None"} and len(rows) == 3


def test_a_key_that_occurs_twice_fails_the_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert {(r.k, r.v) for r in keys.unique(df.filter("v <> 'c'"), ["k"], "rows").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="occurs twice"):
        keys.unique(df, ["k"], "rows").collect()


def test_conflicts_multiply_no_rows(spark):
    """Distinct counts of several columns would write each row once for every column."""
    df = spark.createDataFrame([(1, "x", 1.0, None), (1, "x", float("nan"), 1), (2, "y", float("nan"), 1), (2, "y", float("nan"), 1), (None, "a", 0.0, 1), (None, "b", -0.0, 1), (3, None, None, 1)], "k int, v string, w double, x int")
    found = keys.conflicting_duplicates(df, ["k"], ["v", "w", "x"])
    assert {r.k: r.conflicts for r in found.collect()} == {1: 2, None: 1}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeats_shuffle_no_whole_rows(spark, monkeypatch):
    df = tables.cut(spark.createDataFrame([(k % 7 or None, f"v{k}", k // 2) for k in range(40)] + [(99, "once", 0)], "k int, v string, _ord int").repartition(4))
    want = {(r.k, r._ord) for r in keys.first_wins(df, ["k"]).collect()}
    for most in (keys.MOST_BROADCAST, 3):
        monkeypatch.setattr(keys, "MOST_BROADCAST", most)
        numbered, again = keys.repeats(df, ["k"])
        assert again.count() == 40
        got = numbered.join(again.filter("__place > 1"), "__at", "left_anti")
        assert {(r.k, r._ord) for r in got.collect()} == want and got.count() == 8
        plan = got._jdf.queryExecution().analyzed().toString()
        assert ("ResolvedHint" in plan) == (most > 3)
