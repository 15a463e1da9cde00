"""Registered queries of the core operators, each with DuckDB SQL where SQL can express it.

Inputs that the driver's tables lack (texts with junk, nulls) are made by expressions that both
engines read alike; results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import model_sql, rating_sql
from .functions import scores, text
from .operators import evaluate, features, history, keys, models, quality, ratings
from .plans import competition, dataset, experiments, raw
from .schemas import CONTROL, COUNTS, DIFFERENCES, HISTORY, PAIRS, PERCENTAGES, SUMS
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FIRST, STEP = date(1997, 1, 1), 1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def s6(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) AS {name or c}"


# SQL of the domain views

_LINE_ORDER = "l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LABEL = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in competition.LABELS.items())
_DIVISION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Women''s Flyweight' WHEN '2-HIGH' THEN 'Light Heavyweight' WHEN '3-MEDIUM' THEN 'Lightweight' WHEN '4-NOT SPECIFIED' THEN 'Catch Weight' END"
_Q, _P = "CAST(l_quantity AS BIGINT)", "l_partkey"
_STAT = ",\n".join(
    [f"CASE WHEN {_P} % {n} <> 0 THEN CAST(l_linenumber % {m} AS DOUBLE) END AS {c}" for c, n, m in (("knockdowns", 11, 3), ("submission_attempts", 7, 2), ("reversals", 5, 4))]
    + [f"CASE WHEN ({_P} + {k}) % 17 <> 0 THEN ({_Q} + {k}) % 13 END AS {c}_landed, CASE WHEN ({_P} + {k}) % 17 <> 0 THEN ({_Q} + {k}) % 13 + ({_P} + {k}) % 9 END AS {c}_attempted" for k, c in enumerate(PAIRS)]
    + [f"CASE WHEN {_P} % {n} <> 0 THEN CAST({_P} % 101 AS DOUBLE) END AS {c}" for c, n in (("significant_strikes_pct", 10), ("takedown_pct", 6))]
    + [f"CASE WHEN {_P} % 3 = 2 THEN (l_suppkey % 10) * 60 + {_P} % 60 END AS {CONTROL}"]
)
_TYPE = {c: "DOUBLE" if c in COUNTS else "BIGINT" for c in SUMS}
BASE = f"""
WITH RECURSIVE side AS (SELECT l_orderkey AS fight_id, l_suppkey AS s, min(l_linenumber) AS line, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY line, s) AS k FROM side),
bout AS (
  SELECT a.fight_id, CAST(o_orderdate AS DATE) AS date, a.s AS f1, b.s AS f2,
    CASE WHEN a.fight_id % 97 = 0 THEN 'NC' WHEN a.qty = b.qty THEN 'D' WHEN a.qty > b.qty THEN 'W' ELSE 'L' END AS r1,
    CASE WHEN a.fight_id % 97 = 0 THEN 'NC' WHEN a.qty = b.qty THEN 'D' WHEN a.qty > b.qty THEN 'L' ELSE 'W' END AS r2,
    CASE o_orderpriority {_LABEL} END AS weight_class, {_DIVISION} AS division,
    CASE WHEN a.fight_id % 13 <> 0 THEN (a.fight_id % 5) * 60 + a.fight_id % 60 END AS seconds
  FROM placed a JOIN placed b ON a.fight_id = b.fight_id AND a.k = 1 AND b.k = 2 JOIN orders o ON o.o_orderkey = a.fight_id),
sides AS (
  SELECT fight_id, date, division, seconds, 1 AS side, f1 AS fighter_id, f2 AS opponent_id, r1 AS result, r2 AS opponent_result FROM bout
  UNION ALL SELECT fight_id, date, division, seconds, 2, f2, f1, r2, r1 FROM bout),
stat AS (
  SELECT x.fight_id, x.fighter_id, l.round, {_STAT}
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY {_LINE_ORDER}) AS round FROM lineitem) l
  JOIN sides x ON l.l_orderkey = x.fight_id AND l.l_suppkey = x.fighter_id),
zero AS (SELECT *, significant_strikes_landed / nullif(significant_strikes_attempted, 0) * 100 AS significant_strikes_pct, takedowns_landed / nullif(takedowns_attempted, 0) * 100 AS takedown_pct
  FROM (SELECT fight_id, fighter_id, {", ".join(f"CAST(coalesce(sum({c}), 0) AS {_TYPE[c]}) AS {c}" for c in SUMS)}, count(DISTINCT round) AS rounds_with_stats FROM stat GROUP BY 1, 2)),
nulls AS (SELECT *, CASE WHEN significant_strikes_attempted > 0 THEN significant_strikes_landed / significant_strikes_attempted END AS significant_strikes_pct, CASE WHEN takedowns_attempted > 0 THEN takedowns_landed / takedowns_attempted END AS takedown_pct
  FROM (SELECT fight_id, fighter_id, {", ".join(f"CAST(sum({c}) AS {_TYPE[c]}) AS {c}" for c in SUMS)}, count(DISTINCT round) AS rounds_with_stats FROM stat GROUP BY 1, 2)),
long AS (SELECT s.*, z.* EXCLUDE (fight_id, fighter_id) FROM sides s LEFT JOIN zero z USING (fight_id, fighter_id)),
hist AS (
  SELECT *, row_number() OVER w - 1 AS career,
    {", ".join(f"CAST(coalesce(sum(CAST(result = '{r}' AS INT)) OVER p, 0) AS BIGINT) AS {n}" for r, n in (("W", "wins"), ("L", "losses"), ("D", "draws"), ("NC", "nc")))}
  FROM long WINDOW w AS (PARTITION BY fighter_id ORDER BY date, fight_id, fighter_id), p AS (PARTITION BY fighter_id ORDER BY date, fight_id, fighter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pred AS (
  SELECT b.fight_id, b.date, b.f1, b.f2, CASE b.r1 WHEN 'W' THEN 1 ELSE 0 END AS y, coalesce((x.wins / nullif(x.career, 0)) / nullif(x.wins / nullif(x.career, 0) + z.wins / nullif(z.career, 0), 0), 0.5) AS p_win_rate,
    1 / (1 + pow(10, (20 * (z.wins - z.losses) - 20 * (x.wins - x.losses)) / 400)) AS p_elo
  FROM bout b JOIN hist x ON x.fight_id = b.fight_id AND x.fighter_id = b.f1 JOIN hist z ON z.fight_id = b.fight_id AND z.fighter_id = b.f2 WHERE b.r1 IN ('W', 'L')),
told AS (SELECT fight_id, date, y, 'elo' AS model, p_elo AS p FROM pred UNION ALL SELECT fight_id, date, y, 'win_rate', p_win_rate FROM pred)
"""


def _metric_sql(rows: str, by: str, least: float = 1e-6) -> str:
    """SQL of the metrics of (by, y, p) rows."""
    return f"""ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2 AS r, least(greatest(p, {least!r}::DOUBLE), 1 - {least!r}::DOUBLE) AS q FROM ({rows}))
SELECT {by}, count(*) AS n, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier_score, round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy,
  round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS roc_auc
FROM ranked GROUP BY {by}"""


_METRICS = ["log_loss", "brier_score", "accuracy", "roc_auc"]


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _check_sql(source: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER (WHERE {c}) AS violations FROM {source}" for k, c in checks.items())


_DUP = "SELECT '{0}' AS \"check\", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM {1} GROUP BY {2})"


# Text

_NAME = "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('  ', upper(p_name), '   ', p_brand, ' ') END"


@query(f"SELECT p_partkey, trim(regexp_replace(lower(coalesce({_NAME}, '')), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_text(spark, sf):
    return tables.table(spark, sf, "part").select("p_partkey", text.normalize_text(F.expr(_NAME)).alias("name"))


_URL = "CASE page_id % 4 WHEN 0 THEN concat(url, '/', upper(substr(md5(cast(page_id AS string)), 1, 16))) WHEN 1 THEN concat(url, '/', substr(md5(cast(page_id AS string)), 1, 16), '/') WHEN 2 THEN concat(url, '/', substr(md5(cast(page_id AS string)), 1, 15)) END"


@query(f"SELECT page_id, nullif(lower(regexp_extract({_URL}, '(?i)/([a-f0-9]{{16}})(?:$|/)', 1)), '') AS id FROM pages")
def url_id(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", text.url_id(F.expr(_URL)).alias("id"))


@query("SELECT c_custkey, concat('synthetic_', substr(sha256(lower(c_name)), 1, 16)) AS id FROM customer")
def synthetic_id(spark, sf):
    return tables.table(spark, sf, "customer").select("c_custkey", text.synthetic_id(F.concat(F.lit(" "), "c_name")).alias("id"))


@query("SELECT n_nationkey, CASE WHEN lower(n_name) = 'france' THEN 'French Republic' WHEN lower(n_name) = 'nation_3' THEN 'Third' ELSE n_name END AS name FROM nation")
def alias_lookup(spark, sf):
    return tables.table(spark, sf, "nation").select("n_nationkey", text.canonical_name(F.concat(F.lit(" "), "n_name", F.lit(" ")), {"france": "French Republic", "nation_3": "Third"}).alias("name"))


_BOUT = "CASE o_orderkey % 5 WHEN 0 THEN concat('A', cast(o_custkey AS string), ' vs. B') WHEN 1 THEN 'A VS  B x' WHEN 2 THEN 'A vs. B vs. C' WHEN 3 THEN 'A v B' END"


@query(f"SELECT o_orderkey, nullif(regexp_extract(b, '(?i)^(.*?)\\s+vs\\.?\\s+(.*)$', 1), '') AS one, nullif(regexp_extract(b, '(?i)^(.*?)\\s+vs\\.?\\s+(.*)$', 2), '') AS two FROM (SELECT o_orderkey, {_BOUT} AS b FROM orders)")
def bout_split(spark, sf):
    one, two = text.bout_sides(F.expr(_BOUT))
    return tables.table(spark, sf, "orders").select("o_orderkey", one.alias("one"), two.alias("two"))


_OUTCOME = "CASE o_orderkey % 3 WHEN 0 THEN 'W/L' WHEN 1 THEN 'D' END"


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'D' ELSE '' END AS one, CASE o_orderkey % 3 WHEN 0 THEN 'L' END AS two FROM orders")
def outcome_split(spark, sf):
    one, two = text.outcome_sides(F.expr(_OUTCOME))
    return tables.table(spark, sf, "orders").select("o_orderkey", one.alias("one"), two.alias("two"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, min(CASE WHEN l_linenumber % 4 <> 0 THEN l_linenumber END) AS round FROM lineitem GROUP BY 1, 2")
def round_number(spark, sf):
    told = F.expr("CASE WHEN l_linenumber % 4 <> 0 THEN concat('Round ', cast(l_linenumber AS string)) ELSE 'Total' END")
    return tables.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min(text.round_number(told)).alias("round"))


_JUNK = "CASE o_orderkey % 5 WHEN 0 THEN concat(cast(o_custkey % 9 AS string), ' OF ', cast(o_custkey % 90 AS string)) WHEN 1 THEN '---' WHEN 2 THEN '-1.5 of 2' WHEN 3 THEN 'x' END"
_CLOCK = "CASE o_orderkey % 5 WHEN 0 THEN concat(cast(o_custkey % 9 AS string), ':', cast(o_custkey % 90 AS string)) WHEN 1 THEN '--' WHEN 2 THEN '1:2:3' WHEN 3 THEN '1.5:30' END"
_PCT = "CASE o_orderkey % 5 WHEN 0 THEN concat(cast(o_custkey % 100 AS string), '%') WHEN 1 THEN '---' WHEN 2 THEN '46' WHEN 3 THEN '0.5' END"


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey % 9 AS DOUBLE) WHEN 2 THEN CAST(-1.5 AS DOUBLE) END AS landed, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey % 90 AS DOUBLE) WHEN 2 THEN CAST(2 AS DOUBLE) END AS attempted,
CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey % 9 * 60 + o_custkey % 90 AS DOUBLE) WHEN 3 THEN CAST(120 AS DOUBLE) END AS clock, CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 9 * 60 + o_custkey % 90 END AS ending,
round(CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 WHEN 2 THEN CAST(0.46 AS DOUBLE) WHEN 3 THEN CAST(0.5 AS DOUBLE) END, 6) AS pct FROM orders""")
def lenient_parsers(spark, sf):
    landed, attempted = text.landed_attempted_lenient(F.expr(_JUNK))
    return tables.table(spark, sf, "orders").select("o_orderkey", landed.alias("landed"), attempted.alias("attempted"), text.clock_seconds_lenient(F.expr(_CLOCK)).alias("clock"), text.ending_seconds(F.expr(_CLOCK)).alias("ending"), r6(text.percentage_lenient(F.expr(_PCT)), "pct"))


@query(BASE + f"SELECT fight_id, fighter_id, CAST(round AS INT) AS round, {', '.join([f'{p}_{k}' for p in PAIRS for k in ('landed', 'attempted')] + [*PERCENTAGES, *COUNTS, CONTROL])} FROM stat")
def numeric_rounds(spark, sf):
    return features.numeric_rounds(competition.rounds(spark, sf)).drop("fighter_name")


@query(BASE + f"SELECT fight_id, fighter_id, CAST(round AS INT) AS round, CASE WHEN fight_id % 5 <> 0 THEN knockdowns END AS knockdowns, CASE WHEN fight_id % 7 <> 0 THEN CAST(takedowns_landed AS DOUBLE) END AS takedowns_landed, CASE WHEN fight_id % 7 <> 0 THEN CAST(takedowns_attempted AS DOUBLE) END AS takedowns_attempted, CAST({CONTROL} AS DOUBLE) AS {CONTROL} FROM stat")
def numeric_rounds_lenient(spark, sf):
    """Junk, which would fail the strict parsers, becomes null."""
    junk = {"knockdowns": F.expr("CASE WHEN fight_id % 5 = 0 THEN 'junk' ELSE cast(knockdowns AS string) END"), "takedowns": F.expr("CASE WHEN fight_id % 7 = 0 THEN 'x of y' ELSE takedowns END")}
    rows = features.numeric_rounds(competition.rounds(spark, sf).withColumns(junk), strict=False)
    return rows.select("fight_id", "fighter_id", "round", "knockdowns", "takedowns_landed", "takedowns_attempted", F.col(CONTROL).cast("double").alias(CONTROL))


@query(BASE + "SELECT fight_id, weight_class, division FROM bout")
def division(spark, sf):
    return competition.bouts(spark, sf).select("fight_id", "weight_class", "division")


# Keys, lookups and set operations


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_wins_dedup(spark, sf):
    return keys.first_wins(tables.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_rows(spark, sf):
    return keys.duplicates(tables.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, CAST(count(DISTINCT l_returnflag) > 1 AS INT) + CAST(count(DISTINCT l_linestatus) > 1 AS INT) + CAST(count(DISTINCT nullif(l_returnflag, 'R')) + max(CAST(l_returnflag = 'R' AS INT)) > 1 AS INT) AS conflicts FROM lineitem GROUP BY 1, 2) WHERE conflicts > 0""")
def conflict_dups(spark, sf):
    rows = tables.table(spark, sf, "lineitem").withColumn("flag", F.expr("nullif(l_returnflag, 'R')"))
    return keys.conflicting_duplicates(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "flag"])


@query("""WITH p AS (SELECT c_custkey AS id, lower(concat('C', c_nationkey)) AS a, lower(concat('S', c_custkey % 40)) AS b FROM customer),
n AS (SELECT id, concat(a, ' ', b) AS name_key, 0 AS pos FROM p UNION ALL SELECT id, concat(b, ' ', a), 1 FROM p),
m AS (SELECT name_key, id FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY id, pos) AS k FROM n) WHERE k = 1)
SELECT name_key, id FROM m WHERE name_key NOT IN (SELECT 'c1 s1' FROM m WHERE name_key = 'c2 s2') UNION ALL SELECT 'c1 s1', id FROM m WHERE name_key = 'c2 s2' UNION ALL SELECT 'other', id FROM m WHERE name_key = 's3 c3'""")
def name_map(spark, sf):
    people = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("fighter_id"), F.concat(F.lit(" C"), F.col("c_nationkey").cast("string")).alias("first_name"), F.concat(F.lit("S"), (F.col("c_custkey") % 40).cast("string")).alias("last_name"), F.col("c_custkey").alias("_ord"))
    return keys.name_map(people, {"C1 S1": "C2 S2", "Other": "S3 C3"})


@query("""SELECT k AS row_id, s_nationkey, owner FROM (SELECT s.s_nationkey, s_suppkey * 10 + i AS k, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY s_suppkey * 10 + i) AS r FROM supplier s, range(3) t(i)) x
JOIN (SELECT s_nationkey AS nk, s_suppkey AS owner, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS o FROM supplier) y ON nk = s_nationkey AND o = (r - 1) // 3 + 1""")
def block_assign(spark, sf):
    owners = tables.table(spark, sf, "supplier").select("s_nationkey", "s_suppkey")
    rows = owners.select("s_nationkey", F.explode(F.array(*[F.col("s_suppkey") * 10 + k for k in range(3)])).alias("row_id"))
    return keys.assign_blocks(rows, owners, ["s_nationkey"], "s_suppkey", "row_id", "s_suppkey").select("row_id", "s_nationkey", F.col("s_suppkey").alias("owner"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fact_dim_left(spark, sf):
    customers = tables.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nations = keys.lookup(customers, tables.table(spark, sf, "nation"), ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    return keys.lookup(nations, tables.table(spark, sf, "region"), ["r_regionkey"]).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 7 <> 0)")
def anti_fk(spark, sf):
    orders = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).filter("c_custkey % 7 <> 0")
    return keys.missing_from(tables.table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT DISTINCT l_suppkey, CAST(NULL AS VARCHAR) FROM lineitem WHERE l_suppkey % 3 = 0")
def append_missing_dim(spark, sf):
    own = tables.table(spark, sf, "supplier").select("s_suppkey", "s_name").filter("s_suppkey % 3 <> 0")
    return keys.append_missing(own, tables.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct(), ["s_suppkey"])


@query("SELECT 'keys lost' AS \"check\", count(*) AS violations FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'keys added', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT 'row count differs', abs((SELECT count(*) FROM customer) - (SELECT count(*) FROM orders))")
def set_diff(spark, sf):
    return quality.same_rows(tables.table(spark, sf, "customer"), tables.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT o_orderkey, CAST(min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY strftime(o_orderdate, '%Y%m')) AS VARCHAR) AS date FROM orders")
def attach_dates(spark, sf):
    """Events of a month have many dates; each takes the first."""
    orders = tables.table(spark, sf, "orders").withColumn("event_id", F.date_format("o_orderdate", "yyyyMM"))
    return tables.attach_dates(orders, orders.select("event_id", F.to_date("o_orderdate").alias("date")), missing="raise").select("o_orderkey", F.col("date").cast("string"))


@query(BASE + "SELECT 'fight_id' AS \"column\", count(*) AS rows, count(*) - count(fight_id) AS nulls FROM bout UNION ALL SELECT 'division', count(*), count(*) - count(division) FROM bout UNION ALL SELECT 'seconds', count(*), count(*) - count(seconds) FROM bout")
def null_report(spark, sf):
    return tables.null_report(competition.bouts(spark, sf).select("fight_id", "division", text.ending_seconds(F.col("ending_time")).alias("seconds")))


# The dataset job, on raw tables that are views over the order tables

_HEX = "substr(md5(concat('{0}', CAST({1} AS VARCHAR))), 1, 16)"
_HERE = "fight_id % 11 <> 0 AND fight_id % 500 <> 0"
_SYNTHETIC = "concat('synthetic_', substr(sha256(lower({0})), 1, 16))"
_NIGHT = "CASE WHEN fight_id % 500 = 0 THEN 'UFC - Road to UFC 4.6' ELSE concat('Night ', CAST(fight_id AS VARCHAR)) END"
_EVENT_ID = f"CASE WHEN {_HERE} THEN {_HEX.format('e', 'fight_id')} ELSE {_SYNTHETIC.format(_NIGHT)} END"


@query(BASE + f"""SELECT DISTINCT {_EVENT_ID} AS event_id, {_NIGHT} AS event_name, CAST(CASE WHEN {_HERE} THEN date WHEN fight_id % 500 = 0 THEN DATE '2025-08-22' END AS VARCHAR) AS date, CASE WHEN {_HERE} THEN 'Here' WHEN fight_id % 500 = 0 THEN 'Shanghai, Hebei, China' END AS location FROM bout""")
def dataset_events(spark, sf):
    """Nights with two ids keep the first; those that only the details name get one made up, and known dates."""
    bouts = tables.cut(competition.bouts(spark, sf))
    return _days(dataset.build_events(raw.events(bouts), raw.details(bouts)))


def _built_fights(spark, sf, bouts):
    names = keys.few(keys.name_map(dataset.all_names(raw.fighters(spark, sf)), dataset.FIGHTER_ALIASES))
    events = dataset.build_events(raw.events(bouts), raw.details(bouts))
    return dataset.build_fights(raw.details(bouts), raw.results(bouts), events, names), names


@query(BASE + f"""SELECT {_HEX.format('b', 'fight_id')} AS fight_id, {_EVENT_ID} AS event_id, {_HEX.format('f', 'f1')} AS fighter_1_id, {_HEX.format('f', 'f2')} AS fighter_2_id, concat('Fighter ', CAST(f1 AS VARCHAR)) AS fighter_1_name, CASE WHEN fight_id % 17 <> 0 THEN r1 ELSE '' END AS fighter_1_result, CASE WHEN fight_id % 17 <> 0 THEN r2 END AS fighter_2_result, CASE WHEN fight_id % 17 <> 0 THEN weight_class END AS weight_class, CASE WHEN fight_id % 17 <> 0 THEN CAST(fight_id % 5 + 1 AS INT) END AS ending_round FROM bout""")
def dataset_fights(spark, sf):
    """Details meet results, nights and names; of repeated rows the first counts."""
    fights, _ = _built_fights(spark, sf, tables.cut(competition.bouts(spark, sf)))
    return fights.select("fight_id", "event_id", "fighter_1_id", "fighter_2_id", "fighter_1_name", "fighter_1_result", "fighter_2_result", "weight_class", "ending_round")


@query(BASE + f"SELECT {_HEX.format('b', 'fight_id')} AS fight_id, {_HEX.format('f', 'fighter_id')} AS fighter_id, CAST(round AS INT) AS round, CAST(CAST(knockdowns AS BIGINT) AS VARCHAR) AS knockdowns, CASE WHEN takedowns_landed IS NOT NULL THEN concat(CAST(takedowns_landed AS VARCHAR), ' of ', CAST(takedowns_attempted AS VARCHAR)) END AS takedowns FROM stat")
def dataset_rounds(spark, sf):
    """Rounds find their fight by night and bout, and their fighter by name; placeholders and repeats go."""
    bouts = tables.cut(competition.bouts(spark, sf))  # all raw tables are views of it
    fights, names = _built_fights(spark, sf, bouts)
    rounds = dataset.build_round_stats(raw.stats(bouts, competition.rounds(spark, sf, bouts)), fights, names)
    return rounds.select("fight_id", "fighter_id", "round", "knockdowns", "takedowns")


@query("SELECT (SELECT count(*) = 0 FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AND (SELECT count(*) = 0 FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS customers, (SELECT count(*) = 0 FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AND (SELECT count(*) = 0 FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS orders")
def key_sets(spark, sf):
    """Whether two tables have the same keys."""
    orders, lines = tables.table(spark, sf, "orders"), tables.table(spark, sf, "lineitem")
    customers = keys.same_keys(tables.table(spark, sf, "customer").select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    same = keys.same_keys(orders.select("o_orderkey"), lines.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    return spark.range(1).select(F.lit(customers).alias("customers"), F.lit(same).alias("orders"))


_LINES = "concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN concat(chr(10), '\"second\" line, ') ELSE '' END)"


@query(f"SELECT c_custkey, {_LINES} AS text, CASE WHEN c_custkey % 5 <> 2 THEN CAST(c_nationkey AS INT) END AS number, c_custkey % 5 = 2 AS is_corrupt, row_number() OVER (ORDER BY c_custkey) - 1 AS _ord FROM customer")
def csv_scan(spark, sf):
    """Written as CSV files with quoted line breaks and words where numbers belong, and read again with gapless numbers."""
    rows = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.expr(_LINES).alias("text"), F.expr("CASE WHEN c_custkey % 5 = 2 THEN 'many' ELSE cast(c_nationkey AS string) END").alias("number"))
    folder = tables.new_folder(spark, "csv")
    rows.repartitionByRange(4, "key").sortWithinPartitions("key").write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    read = tables.read_csv(spark, folder, T.StructType([T.StructField("number", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("text", T.StringType())]), corrupt="line")
    return read.select(F.col("key").alias("c_custkey"), "text", "number", F.col("line").isNotNull().alias("is_corrupt"), "_ord")


@query(BASE + "SELECT 'bouts' AS name, count(*) AS n, sum(fight_id) AS keys FROM bout UNION ALL SELECT 'sides', count(*), sum(fight_id) FROM sides")
def gated_write(spark, sf):
    """Two tables are written through the gate; a second write, which a check refuses, leaves them as they are."""
    fights, folder = competition.bouts(spark, sf), tables.new_folder(spark, "gate")
    built = {"bouts": fights.select("fight_id", "fighter_1_id", "fighter_2_id"), "sides": features.sides(fights, ["fight_id", "date"])}
    checks = lambda t: quality.long_table(t["sides"]).unionByName(quality.duplicate_keys(t["bouts"], ["fight_id"]))
    tables.write_if_valid(spark, built, folder, checks)
    try:
        tables.write_if_valid(spark, {"bouts": built["bouts"].union(built["bouts"]), "sides": built["sides"].limit(0)}, folder, checks)
        raise AssertionError("repeated keys were written")
    except ValueError:
        pass
    each = [tables.table(spark, folder, k).agg(F.lit(k).alias("name"), F.count("*").alias("n"), F.sum("fight_id").alias("keys")) for k in built]
    return each[0].unionByName(each[1])


# Features and history

_OUT_STATS = [*SUMS, "rounds_with_stats"]


@query(BASE + f"SELECT fight_id, fighter_id, {', '.join(_OUT_STATS)}, {s6('significant_strikes_pct')}, {s6('takedown_pct')} FROM zero")
def fighter_totals_zero(spark, sf):
    return _rounded(competition.totals(spark, sf).drop("fighter_name"), list(PERCENTAGES))


@query(BASE + f"SELECT fight_id, fighter_id, {', '.join(_OUT_STATS)}, {s6('significant_strikes_pct')}, {s6('takedown_pct')} FROM nulls")
def fighter_totals_null(spark, sf):
    return _rounded(competition.totals(spark, sf, null_as_zero=False).drop("fighter_name"), list(PERCENTAGES))


@query(BASE + f"SELECT b.fight_id, f1 AS fighter_1_id, f2 AS fighter_2_id, {', '.join(f'round(a.{c} - z.{c}, 6) AS {c}_diff' for c in DIFFERENCES)}, a.rounds_with_stats AS rounds_with_stats_fighter_1, z.rounds_with_stats AS rounds_with_stats_fighter_2 FROM bout b LEFT JOIN zero a ON a.fight_id = b.fight_id AND a.fighter_id = f1 LEFT JOIN zero z ON z.fight_id = b.fight_id AND z.fighter_id = f2")
def bout_wide(spark, sf):
    wide = features.bout_wide(competition.bouts(spark, sf), competition.totals(spark, sf))
    return wide.select("fight_id", "fighter_1_id", "fighter_2_id", *[r6(f"{c}_diff") for c in DIFFERENCES], "rounds_with_stats_fighter_1", "rounds_with_stats_fighter_2")


@query(BASE + f"SELECT fight_id, CAST(date AS VARCHAR) AS date, fighter_id, opponent_id, result, opponent_result, seconds AS fight_duration_seconds, {', '.join(_OUT_STATS)} FROM long")
def bout_long(spark, sf):
    return competition.long(spark, sf).select("fight_id", F.col("date").cast("string"), "fighter_id", "opponent_id", "result", "opponent_result", "fight_duration_seconds", *_OUT_STATS)


@query(BASE + "SELECT r1 AS fighter_1_result, r2 AS fighter_2_result, count(*) AS fights FROM bout GROUP BY 1, 2")
def contingency(spark, sf):
    return features.contingency(competition.bouts(spark, sf))


@query(BASE + "SELECT fight_id, least(f1, f2) AS fighter_1_id, greatest(f1, f2) AS fighter_2_id, CASE WHEN f1 < f2 THEN r1 ELSE r2 END AS fighter_1_result, CASE WHEN f1 < f2 THEN r2 ELSE r1 END AS fighter_2_result FROM bout")
def canonical_pairs(spark, sf):
    return features.canonical(competition.bouts(spark, sf)).select("fight_id", "fighter_1_id", "fighter_2_id", "fighter_1_result", "fighter_2_result")


_ANY = ["knockdowns", "significant_strikes_landed", CONTROL]


@query(BASE + f"SELECT fight_id, {', '.join(f'coalesce(bool_or({c} IS NOT NULL), false) AS has_{c}' for c in _ANY)}, count(DISTINCT fighter_id) AS sides FROM stat GROUP BY fight_id")
def availability(spark, sf):
    """Which statistics any round of a bout has."""
    numbers = features.numeric_rounds(competition.rounds(spark, sf))
    return features.any_present(numbers, ["fight_id"], _ANY, F.countDistinct("fighter_id").alias("sides"))


def _history(spark, sf):
    return history.fight_history(competition.long(spark, sf))


def _counts(spark, sf):
    """What needs no statistics: counts and win rates before."""
    return history.fight_history(features.sides(competition.bouts(spark, sf), ["fight_id", "date"]), sums=[], means=[])


@query(BASE + f"SELECT fight_id, fighter_id, CAST(career AS INT) AS career_fights_before, wins AS wins_before, losses AS losses_before, draws AS draws_before, nc AS nc_before, {s6('wins / nullif(career, 0)', 'win_rate_before')} FROM hist")
def history_counts(spark, sf):
    return _counts(spark, sf).select("fight_id", "fighter_id", "career_fights_before", "wins_before", "losses_before", "draws_before", "nc_before", r6("win_rate_before"))


_PRIOR = "OVER (PARTITION BY fighter_id ORDER BY date, fight_id, fighter_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(BASE + f"SELECT fight_id, fighter_id, {', '.join(f'CAST(sum({c}) {_PRIOR} AS {_TYPE[c]}) AS sum_{c}_before' for c in HISTORY)} FROM long")
def history_sums(spark, sf):
    return _history(spark, sf).select("fight_id", "fighter_id", *[f"sum_{c}_before" for c in HISTORY])


@query(BASE + f"SELECT fight_id, fighter_id, {', '.join(f'round(avg({c}) {_PRIOR}, 6) AS avg_{c}_before' for c in [*HISTORY, *PERCENTAGES])} FROM long")
def history_avgs(spark, sf):
    return _history(spark, sf).select("fight_id", "fighter_id", *[r6(f"avg_{c}_before") for c in [*HISTORY, *PERCENTAGES]])


@query(BASE + f"SELECT fight_id, fighter_id, CAST(career AS INT) AS career_fights_before, wins AS wins_before, nc AS nc_before, {', '.join(f'CAST(sum({c}) {_PRIOR} AS {_TYPE[c]}) AS sum_{c}_before, round(avg({c}) {_PRIOR}, 6) AS avg_{c}_before' for c in HISTORY[:4])} FROM hist")
def history_by_stretch(spark, sf):
    """As history_sums and history_avgs, with fighters of many fights dealt over tasks by month."""
    rows = history.fight_history(competition.long(spark, sf), HISTORY[:4], [], block="month")
    return rows.select("fight_id", "fighter_id", "career_fights_before", "wins_before", "nc_before", *[x for c in HISTORY[:4] for x in (F.col(f"sum_{c}_before"), r6(f"avg_{c}_before"))])


_RUN = [*history.STRIKING, *history.GRAPPLING, *history.DOMINANCE]
#: The twelve features by hand, so that a wrong list above shows.
_TWELVE = """significant_strikes_landed significant_strikes_attempted significant_strikes_pct total_strikes_landed total_strikes_attempted
takedowns_landed takedowns_attempted takedown_pct submission_attempts reversals knockdowns control_time_seconds""".split()


@query(BASE + f"SELECT fight_id, fighter_id, {', '.join(f'round(avg({c}) {_PRIOR}, 6) AS avg_{c}' for c in _TWELVE)} FROM sides LEFT JOIN nulls USING (fight_id, fighter_id)")
def performance_running(spark, sf):
    return history.performance_running(competition.long(spark, sf, null_as_zero=False)).select("fight_id", "fighter_id", *[r6(f"avg_{c}") for c in _RUN])


@query("SELECT user_id, event_id, round(lag(value) OVER w, 6) AS previous_rating_after, lag(ts) OVER w AS previous_date, lag(event_id) OVER w AS previous_career_fights FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def continuity_lag(spark, sf):
    rows = tables.table(spark, sf, "events").select(F.col("user_id").alias("fighter_id"), F.col("event_id").alias("fight_id"), F.col("ts").alias("date"), F.col("value").alias("rating_after"), F.col("event_id").alias("career_fights_before"))
    return history.continuity(rows).select(F.col("fighter_id").alias("user_id"), F.col("fight_id").alias("event_id"), r6("previous_rating_after"), "previous_date", "previous_career_fights")


@query(BASE + """SELECT fight_id, fighter_id, round(1500 + (1600 - 1500) * pow(2, -d / (4 * 365.25)), 6) AS decayed, d AS days, round(pow(2, -d / (4 * 365.25)), 6) AS factor,
round(1 / (1 + exp(-(ln(10) / 400) / sqrt(1 + 3 * pow(ln(10) / 400, 2) * pow(30 + d % 300, 2) / pow(pi(), 2)) * (fighter_id - opponent_id))), 6) AS glicko, round(1 / (1 + pow(10, (opponent_id - fighter_id) / 400)), 6) AS elo
FROM (SELECT *, CAST(date_diff('day', DATE '1994-01-01', date) AS INT) AS d FROM sides)""")
def rating_expressions(spark, sf):
    rows = features.sides(competition.bouts(spark, sf), ["fight_id", "date"])
    decayed, days, factor = scores.apply_recency(F.lit(1600.0), F.lit(date(1994, 1, 1)), F.col("date"), 1500.0, 4.0)
    return rows.select("fight_id", "fighter_id", r6(decayed, "decayed"), days.alias("days"), r6(factor, "factor"), r6(scores.glicko_expected(F.col("fighter_id"), F.col("opponent_id"), 30 + days % 300), "glicko"), r6(scores.expected_score(F.col("fighter_id"), F.col("opponent_id")), "elo"))


# Ratings: the SQL walks all bouts, a level at a time (see rating_sql)

_ELO_OUT = ["rating_before", "rating_after", "expected_score", "recency_factor"]
_OWN, _TWO, _FOUR = ratings.EloConfig(), ratings.EloConfig(half_life_years=2.0), ratings.EloConfig(half_life_years=4.0)
_SIDED = "config, fight_id, CAST(date AS VARCHAR) AS date, division, fighter_id, opponent_id, result, career_fights_before, is_debut, is_division_change, k_factor, rating_updated, days_since_last_fight, " + ", ".join(s6(c) for c in [*_ELO_OUT, "rating_historical_before"])
_CANON = ", canon AS (SELECT fight_id, date, least(f1, f2) AS f1, greatest(f1, f2) AS f2, CASE WHEN f1 < f2 THEN r1 ELSE r2 END AS r1, CASE WHEN f1 < f2 THEN r2 ELSE r1 END AS r2, division FROM bout)"


def _elo_sql(configs: dict[str, ratings.EloConfig], dialect: ratings.Dialect = ratings.PRODUCTION, source: str = "bout") -> str:
    return ", " + rating_sql.elo(source, configs, dialect)


def _sided_sql(config: ratings.EloConfig) -> str:
    return _elo_sql({"own": config}) + ", " + rating_sql.by_fighter()


def _rated(spark, sf, half_life=None):
    fights = competition.bouts(spark, sf)
    return ratings.by_fighter(ratings.elo(fights, {"own": ratings.EloConfig(half_life_years=half_life)}, apart=True), fights)


def _days(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


@query(BASE + _sided_sql(_OWN) + f" SELECT {_SIDED} FROM sided")
def elo_v01(spark, sf):
    return _days(_rounded(_rated(spark, sf), [*_ELO_OUT, "rating_historical_before"]))


@query(BASE + _sided_sql(_TWO) + f" SELECT {_SIDED} FROM sided")
def elo_recency(spark, sf):
    return _days(_rounded(_rated(spark, sf, 2.0), [*_ELO_OUT, "rating_historical_before"]))


@query(BASE + _CANON + _elo_sql({"own": _OWN, "2y": _TWO}, ratings.WIN_LOSS, "canon") + f" SELECT config, fight_id, CAST(date AS VARCHAR) AS date, f1 AS fighter_1_id, f2 AS fighter_2_id, {s6('before_1', 'rating_1_before')}, {s6('before_2', 'rating_2_before')}, {s6('expected_1')} FROM rated")
def elo_wl_only(spark, sf):
    return _days(ratings.elo(features.canonical(competition.bouts(spark, sf)), {"own": _OWN, "2y": _TWO}, ratings.WIN_LOSS, apart=True).select("config", "fight_id", "date", "fighter_1_id", "fighter_2_id", r6("rating_1_before"), r6("rating_2_before"), r6("expected_1")))


_BY_LEAGUE = ", apart AS (SELECT * REPLACE (concat(coalesce(division, 'none'), ':', f1) AS f1, concat(coalesce(division, 'none'), ':', f2) AS f2) FROM bout)"
_LEAGUE_SQL = rating_sql.elo("apart", {"own": _OWN, "2y": _TWO}, ratings.PRODUCTION)


def by_league(spark, sf):
    """Bouts of competitors who start anew in each division, so that those of different divisions never meet."""
    own = lambda n: F.concat_ws(":", F.coalesce("division", F.lit("none")), F.col(f"fighter_{n}_id").cast("string"))
    return competition.bouts(spark, sf).withColumns({f"fighter_{n}_id": own(n) for n in (1, 2)})


@query(BASE + _BY_LEAGUE + ", " + _LEAGUE_SQL + f" SELECT config, fight_id, f1 AS fighter_1_id, f2 AS fighter_2_id, {s6('before_1', 'rating_1_before')}, {s6('before_2', 'rating_2_before')}, {s6('expected_1')} FROM rated")
def elo_leagues(spark, sf):
    """Each division is walked in a task of its own."""
    rated = ratings.elo(by_league(spark, sf), {"own": _OWN, "2y": _TWO}, apart=True)
    return rated.select("config", "fight_id", "fighter_1_id", "fighter_2_id", r6("rating_1_before"), r6("rating_2_before"), r6("expected_1"))


@query(BASE + _elo_sql({"own": _OWN}, ratings.SHARED_K) + f" SELECT fight_id, CAST(date AS VARCHAR) AS date, k_1, {s6('before_1', 'rating_1_before')}, {s6('before_2', 'rating_2_before')}, {s6('expected_1')} FROM rated")
def elo_shared_k(spark, sf):
    return _days(ratings.elo(competition.bouts(spark, sf), {"own": _OWN}, ratings.SHARED_K, apart=True).select("fight_id", "date", "k_1", r6("rating_1_before"), r6("rating_2_before"), r6("expected_1")))


@query(BASE + _elo_sql({"own": _OWN}, ratings.SHARED_K) + """, met_before AS MATERIALIZED (SELECT fight_id, side, coalesce(avg(opponent) OVER (PARTITION BY f ORDER BY date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1500) AS sos
  FROM (SELECT fight_id, date, 1 AS side, f1 AS f, before_2 AS opponent FROM rated UNION ALL SELECT fight_id, date, 2, f2, before_1 FROM rated))
SELECT r.fight_id, round(x.sos, 6) AS sos_1_before, round(y.sos, 6) AS sos_2_before, round(before_1 - before_2, 6) AS elo_difference, round(x.sos - y.sos, 6) AS sos_difference
FROM rated r JOIN met_before x ON x.fight_id = r.fight_id AND x.side = 1 JOIN met_before y ON y.fight_id = r.fight_id AND y.side = 2""")
def sos(spark, sf):
    rated = ratings.elo(competition.bouts(spark, sf), {"own": _OWN}, ratings.SHARED_K, only=["rating_1_before", "rating_2_before"], apart=True)
    return history.strength_of_schedule(rated).select("fight_id", r6("sos_1_before"), r6("sos_2_before"), r6("elo_difference"), r6("sos_difference"))


_GLICKO = BASE + ", " + rating_sql.glicko2("bout", 0.5)
_P_GLICKO = "1 / (1 + exp(-(ln(10) / 400) / sqrt(1 + 3 * pow(ln(10) / 400, 2) * pow(rd_2_before, 2) / pow(pi(), 2)) * (rating_1_before - rating_2_before)))"


@query(_GLICKO + f" SELECT fight_id, CAST(date AS VARCHAR) AS date, {', '.join(f'round({n}, 4) AS {n}' for n, _ in ratings.GLICKO_FIELDS)}, {s6(_P_GLICKO, 'p_1')} FROM played")
def glicko2(spark, sf):
    """To 4 digits: numbers in the thousands, after hundreds of root searches by different methods."""
    rated = ratings.glicko2(competition.bouts(spark, sf), apart=True)
    p = scores.glicko_expected(F.col("rating_1_before"), F.col("rating_2_before"), F.col("rd_2_before"))
    return _days(rated.select("fight_id", "date", *[F.round(n, 4).alias(n) for n, _ in ratings.GLICKO_FIELDS], r6(p, "p_1")))


_GLICKO_FOLDS = f"SELECT CAST(make_date(CAST(year(date) AS INT), 1, 1) AS VARCHAR) AS fold, CAST(r1 = 'W' AS INT) AS y, {_P_GLICKO} AS p FROM played WHERE date >= DATE '1997-01-01'"


@query(_GLICKO + ", " + _metric_sql(f"{_GLICKO_FOLDS} UNION ALL SELECT 'pooled', y, p FROM ({_GLICKO_FOLDS})", "fold", evaluate.LEAST_EXPERIMENT))
def glicko2_metrics(spark, sf):
    return _rounded(experiments.glicko_experiment(competition.bouts(spark, sf), FIRST, STEP), _METRICS)


@query(BASE + _sided_sql(_FOUR) + f" SELECT fighter_id, CAST(date AS VARCHAR) AS date, {s6('rating_after')} FROM (SELECT *, row_number() OVER (PARTITION BY fighter_id ORDER BY date DESC, fight_id DESC) AS k FROM sided) WHERE k = 1 ORDER BY rating_after DESC, fighter_id LIMIT 10")
def top10_current(spark, sf):
    return history.latest(_rated(spark, sf, 4.0), top=10).select("fighter_id", F.col("date").cast("string"), r6("rating_after"))


@query(BASE + _sided_sql(_FOUR) + " SELECT count(*) AS participations, count(DISTINCT fighter_id) AS fighters, count(*) FILTER (WHERE is_debut) AS debuts, count(*) FILTER (WHERE is_division_change) AS division_changes, count(*) FILTER (WHERE NOT rating_updated) AS not_updated, count(*) - count(division) AS unknown_division FROM sided")
def rating_summary(spark, sf):
    return experiments.rating_summary(_rated(spark, sf, 4.0))


_SWEEP, _YEARS = ratings.candidate_configs(), ratings.half_life_configs()
_SETUP = ", ".join(f"('{k}', {c.base_k!r}, {c.boosted_k!r}, {c.scale!r}, {c.provisional_fights}, {'NULL' if c.half_life_years is None else c.half_life_years}, '{c.label}')" for k, c in _SWEEP.items())


def _sweep_sql(configs: dict[str, ratings.EloConfig], cutoff: str | None = None) -> str:
    """CTE `swept`: metrics of each config by fold, pooled and, from the cutoff on, as test."""
    rows = "SELECT config, date, CASE WHEN r1 = 'W' AND r2 = 'L' THEN 1 WHEN r1 = 'L' AND r2 = 'W' THEN 0 END AS y, expected_1 AS p FROM rated"
    dealt = f"SELECT config, CAST(make_date(CAST(year(date) AS INT), 1, 1) AS VARCHAR) AS fold, y, p FROM ({rows}) WHERE y IS NOT NULL AND date >= DATE '1997-01-01' UNION ALL SELECT config, 'pooled', y, p FROM ({rows}) WHERE y IS NOT NULL AND date >= DATE '1997-01-01'"
    if cutoff:
        dealt += f" UNION ALL SELECT config, 'test', y, p FROM ({rows}) WHERE y IS NOT NULL AND date >= DATE '{cutoff}'"
    return _elo_sql(configs) + ", swept AS (WITH " + _metric_sql(dealt, "config, fold") + ")"


@query(BASE + _sweep_sql(_SWEEP, "2000-01-01") + f" SELECT s.*, CAST(base_k AS DOUBLE) AS base_k, CAST(boosted_k AS DOUBLE) AS boosted_k, CAST(scale AS DOUBLE) AS scale, CAST(provisional_fights AS INT) AS provisional_fights, CAST(half_life_years AS DOUBLE) AS half_life_years, label FROM swept s JOIN (VALUES {_SETUP}) t(config, base_k, boosted_k, scale, provisional_fights, half_life_years, label) ON t.config = s.config")
def param_sweep(spark, sf):
    swept = experiments.sweep(competition.bouts(spark, sf), _SWEEP, FIRST, STEP, cutoff=date(2000, 1, 1))
    return _rounded(experiments.with_config(swept, _SWEEP), _METRICS)


def _recency(spark, sf):
    return experiments.sweep(competition.bouts(spark, sf), _YEARS, FIRST, STEP)


@query(BASE + _sweep_sql(_YEARS) + " SELECT * FROM swept")
def recency_sweep(spark, sf):
    return _rounded(_recency(spark, sf), _METRICS)


_THREE = {k: _SWEEP[k] for k in ("baseline_v0.1", "scale_200", "provisional_5")}


@query(BASE + _sweep_sql(_THREE) + " SELECT * FROM swept")
def sweep_resumed(spark, sf):
    """One config is written first; a second run adds the others, and a third has nothing to do."""
    fights, folder = tables.cut(ratings.with_leagues(competition.bouts(spark, sf))), tables.new_folder(spark, "sweep")
    first = dict([next(iter(_THREE.items()))])
    runs = [experiments.resume_sweep(fights, configs, folder) for configs in (first, _THREE, _THREE)]
    if runs != [list(first), [k for k in _THREE if k not in first], []]:
        raise AssertionError(f"walked {runs}")
    return _rounded(experiments.written_sweep(spark, folder, FIRST, STEP), _METRICS)


@query(BASE + _sweep_sql(_YEARS) + " SELECT * FROM swept WHERE fold = 'pooled' ORDER BY log_loss, config")
def leaderboard(spark, sf):
    return _rounded(experiments.leaderboard(_recency(spark, sf)), _METRICS)


@query(BASE + _sweep_sql(_YEARS) + " SELECT fold, config, log_loss FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY log_loss, config) AS k FROM swept WHERE fold <> 'pooled') WHERE k = 1")
def best_config_per_fold(spark, sf):
    """Compared at 6 digits, so that both engines see the same ties."""
    return evaluate.best_per_fold(_rounded(_recency(spark, sf).filter("fold <> 'pooled'"), _METRICS))


#: Violations planted into ratings: column to an expression that both engines read alike.
_PLANTED = {
    "rating_before": "CASE WHEN is_debut AND fight_id % 9 = 4 THEN rating_before + 3 WHEN fight_id % 211 = 7 THEN rating_before + 1 WHEN fight_id % 1009 = 5 THEN CAST('NaN' AS DOUBLE) ELSE rating_before END",
    "rating_after": "CASE WHEN fight_id % 194 = 0 THEN rating_after + 2 ELSE rating_after END",
    "days_since_last_fight": "CASE WHEN fight_id % 223 = 9 THEN days_since_last_fight + 1 ELSE days_since_last_fight END",
    "recency_factor": "CASE WHEN fight_id % 227 = 11 THEN recency_factor / 2 ELSE recency_factor END",
    "rating_historical_before": "CASE WHEN fight_id % 229 = 13 THEN 1500 ELSE rating_historical_before END",
}
_RATING_CHECKS = {
    "debut not at the start": "is_debut AND rating_before <> 1500",
    "no contest changed a rating": "result = 'NC' AND rating_before <> rating_after",
    "not finite": "NOT isfinite(rating_before) OR NOT isfinite(rating_after) OR NOT isfinite(expected_score)",
    "rating does not follow the last": "last IS NOT NULL AND NOT abs(rating_before - should) <= 1e-8 + 1e-8 * abs(should)",
    "days differ": "d0 IS NOT NULL AND days_since_last_fight <> days",
    "recency factor differs": "NOT abs(recency_factor - factor) <= 1e-8",
    "decay away from the start": "abs(rating_before - 1500) > abs(rating_historical_before - 1500) + 1e-8",
}


@query(
    BASE
    + _sided_sql(_TWO)
    + f""", planted AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _PLANTED.items())}) FROM sided),
lagged AS (SELECT *, lag(rating_after) OVER w AS last, lag(date) OVER w AS d0 FROM planted WINDOW w AS (PARTITION BY fighter_id ORDER BY date, fight_id)),
timed AS (SELECT *, coalesce(greatest(date_diff('day', d0, date), 0), 0) AS days FROM lagged),
decayed AS (SELECT *, CASE WHEN d0 IS NULL THEN 1.0::DOUBLE ELSE pow(2.0, -days / (2 * 365.25)) END AS factor FROM timed),
due AS (SELECT *, 1500 + (last - 1500) * factor AS should FROM decayed)
"""
    + _check_sql("due", _RATING_CHECKS)
)
def ratings_dq(spark, sf):
    return quality.ratings(_rated(spark, sf, 2.0).withColumns({c: F.expr(e) for c, e in _PLANTED.items()}), half_life_years=2.0)


# Evaluation: on predictions from the history alone, so that SQL can follow


def _predictions(spark, sf):
    past = _counts(spark, sf)
    other = past.select("fight_id", F.col("fighter_id").alias("opponent_id"), (F.col("wins_before") - F.col("losses_before")).alias("other"))
    own = 20 * (F.col("wins_before") - F.col("losses_before"))
    rated = past.join(other, ["fight_id", "opponent_id"]).select("fight_id", "fighter_id", scores.expected_score(own, 20 * F.col("other")).alias("expected_score"))
    return evaluate.evaluation_dataset(competition.bouts(spark, sf), rated, past)


def _told(spark, sf):
    return evaluate.by_model(_predictions(spark, sf), {"elo": "p_elo", "win_rate": "p_win_rate"}, ["fight_id", "date"])


@query(BASE + f"SELECT fight_id, CAST(date AS VARCHAR) AS date, f1 AS fighter_1_id, f2 AS fighter_2_id, y, {s6('p_win_rate')}, {s6('p_elo')} FROM pred")
def eval_dataset(spark, sf):
    return _rounded(_predictions(spark, sf), ["p_win_rate", "p_elo"]).withColumn("date", F.col("date").cast("string"))


@query(BASE + ", " + _metric_sql("SELECT *, 'test' AS fold FROM told WHERE date >= DATE '2000-01-01'", "model, fold"))
def metrics_split(spark, sf):
    return _rounded(evaluate.split_metrics(_told(spark, sf), date(2000, 1, 1), ["model"]), _METRICS)


_FOLDS = "SELECT *, CAST(make_date(CAST(year(date) AS INT), 1, 1) AS VARCHAR) AS fold FROM told WHERE date >= DATE '1997-01-01'"


@query(BASE + ", " + _metric_sql(f"{_FOLDS} UNION ALL SELECT *, 'pooled' FROM told WHERE date >= DATE '1997-01-01'", "model, fold"))
def metrics_walk_forward(spark, sf):
    return _rounded(evaluate.walk_forward(_told(spark, sf), FIRST, STEP, ["model"]), _METRICS)


#: Folds of unequal lengths, with a gap: name, start, and the end, which is excluded.
_NAMED = [("opening", date(1995, 3, 15), date(1996, 1, 10)), ("long", date(1996, 1, 10), date(1999, 6, 1)), ("one day", date(1999, 7, 4), date(1999, 7, 5)), ("late", date(2000, 2, 29), date(2003, 1, 1))]
_IN_NAMED = "SELECT t.*, n.fold FROM told t JOIN (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _NAMED) + ") n(fold, start, stop) ON t.date >= n.start AND t.date < n.stop"


@query(BASE + ", " + _metric_sql(f"{_IN_NAMED} UNION ALL SELECT * REPLACE ('pooled' AS fold) FROM ({_IN_NAMED})", "model, fold"))
def metrics_named_folds(spark, sf):
    folds = spark.createDataFrame(_NAMED, "fold string, start date, end date")
    return _rounded(evaluate.by_named_fold(_told(spark, sf), folds, ["model"]), _METRICS)


@query(BASE + f", m AS (WITH {_metric_sql(_FOLDS, 'model, fold').replace('round(', '(').replace(', 6)', ')')}) SELECT model, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'round(sum({c} * n) / sum(n), 6) AS {c}' for c in _METRICS)} FROM m GROUP BY model")
def metrics_pooled_weighted(spark, sf):
    return _rounded(evaluate.pooled_by_size(evaluate.walk_forward(_told(spark, sf), FIRST, STEP, ["model"]), ["model"]), _METRICS)


@query(", ".join(["WITH told AS (SELECT event_type AS model, round(value / (SELECT max(value) FROM events), 2) AS p, CAST(event_id % 3 = 0 AS INT) AS y FROM events)", _metric_sql("SELECT * FROM told", "model")]))
def auc_ties(spark, sf):
    rows = tables.table(spark, sf, "events")
    most = rows.agg(F.max("value").alias("most"))
    told = rows.join(F.broadcast(most)).select(F.col("event_type").alias("model"), F.round(F.col("value") / F.col("most"), 2).alias("p"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))
    return _rounded(evaluate.metrics(told, ["model"]), _METRICS)


_EDGES = " + ".join(f"CAST(p > {k * 0.1!r}::DOUBLE AS INT)" for k in range(1, 10))


@query(BASE + f"SELECT model, CAST(1 + {_EDGES} AS INT) AS bin, count(*) AS n, {s6('avg(p)', 'mean_predicted')}, {s6('avg(y)', 'observed_win_rate')}, {s6('avg(p) - avg(y)', 'gap')} FROM told GROUP BY 1, 2")
def calibration(spark, sf):
    return _rounded(evaluate.calibration(_told(spark, sf), ["model"]), ["mean_predicted", "observed_win_rate", "gap"]).drop("lo", "hi")


# Models


@query(BASE + f"""SELECT fight_id, fighter_id, {', '.join(f"round((coalesce(v.{c}, s.m_{c}) - s.a_{c}) / s.d_{c}, 6) AS {c}" for c in ('knockdowns', CONTROL))}, round((CAST(v.{CONTROL} IS NULL AS INT) - s.i) / s.k, 6) AS missing
FROM nulls v, (SELECT any_value(m.mk) AS m_knockdowns, any_value(m.mc) AS m_{CONTROL}, avg(coalesce(knockdowns, mk)) AS a_knockdowns, avg(coalesce({CONTROL}, mc)) AS a_{CONTROL}, stddev_pop(coalesce(knockdowns, mk)) AS d_knockdowns, stddev_pop(coalesce({CONTROL}, mc)) AS d_{CONTROL}, avg(CAST({CONTROL} IS NULL AS INT)) AS i, stddev_pop(CAST({CONTROL} IS NULL AS INT)) AS k FROM nulls, (SELECT median(knockdowns) AS mk, median({CONTROL}) AS mc FROM nulls) m) s""")
def impute_scale(spark, sf):
    rows = competition.totals(spark, sf, null_as_zero=False)
    ready = models.prepare(rows, ["knockdowns", CONTROL]).apply(rows)
    return ready.select("fight_id", "fighter_id", r6("__f_knockdowns", "knockdowns"), r6(f"__f_{CONTROL}", CONTROL), r6(f"__f_{CONTROL}__missing", "missing"))


_DIFFERENT = ["takedowns_landed", "takedown_pct", "control_time_seconds"]
_TURNED = f""", running AS (SELECT fight_id, side, fighter_id, {', '.join(f'avg({c}) OVER (PARTITION BY fighter_id ORDER BY date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}' for c in _DIFFERENT)} FROM sides LEFT JOIN nulls USING (fight_id, fighter_id)),
turned AS (SELECT x.fight_id, {', '.join(f'x.{c} - y.{c} AS {c}' for c in _DIFFERENT)} FROM running x JOIN running y ON x.fight_id = y.fight_id AND x.fighter_id < y.fighter_id)"""


@query(BASE + _TURNED + f""", mid AS (SELECT {', '.join(f'median({c}) AS {c}' for c in _DIFFERENT)} FROM turned),
filled AS (SELECT t.fight_id, {', '.join(f'coalesce(t.{c}, m.{c}) AS {c}, CAST(t.{c} IS NULL AS INT) AS lost_{c}' for c in _DIFFERENT)} FROM turned t, mid m),
figures AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}, avg(lost_{c}) AS i_{c}, stddev_pop(lost_{c}) AS k_{c}' for c in _DIFFERENT)} FROM filled)
SELECT fight_id, {', '.join(f'round(({c} - a_{c}) / d_{c}, 6) AS {c}, round((lost_{c} - i_{c}) / k_{c}, 6) AS lost_{c}' for c in _DIFFERENT)} FROM filled, figures""")
def impute_scale_differences(spark, sf):
    """Features of the models have about as many distinct values as rows, so their medians are sought by rounds."""
    fights = features.canonical(competition.bouts(spark, sf))
    totals = features.fighter_totals(features.numeric_rounds(competition.rounds(spark, sf, fights)), null_as_zero=False)
    long = history.performance_running(features.bout_long(fights, totals, ["fight_id", "date"]), _DIFFERENT)
    side = lambda n, s: [F.max(F.when(F.col("side") == n, F.col(f"avg_{c}"))).alias(f"{c}_{s}") for c in _DIFFERENT]
    turned = long.groupBy("fight_id").agg(*side(1, "a"), *side(2, "b"))
    rows = tables.cut(turned.select("fight_id", *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in _DIFFERENT]))
    ready = models.prepare(rows, _DIFFERENT).apply(rows)
    return ready.select("fight_id", *[r6(f"__f_{c}", c) for c in _DIFFERENT], *[r6(f"__f_{c}__missing", f"lost_{c}") for c in _DIFFERENT])


def _historical(spark, sf):
    fights = tables.cut(competition.bouts(spark, sf))
    return experiments.historical(fights, features.numeric_rounds(competition.rounds(spark, sf, fights)))


_TWELVE_TURNED = f""", running AS (SELECT fight_id, side, fighter_id, {', '.join(f'avg({c}) OVER (PARTITION BY fighter_id ORDER BY date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}' for c in _TWELVE)} FROM sides LEFT JOIN nulls USING (fight_id, fighter_id)),
turned AS MATERIALIZED (SELECT x.fight_id, {', '.join(f'x.{c} - y.{c} AS {c}_difference' for c in _TWELVE)} FROM running x JOIN running y ON x.fight_id = y.fight_id AND x.fighter_id < y.fighter_id)"""
_FOLD_STARTS = ["1997-01-01", "1999-01-01", "2001-01-01"]


def _past_sql(configs: dict[str, ratings.EloConfig]) -> str:
    """CTE `past_<config>`: (fight_id, date, y, elo_probability, differences) of bouts turned so that id 1 < id 2."""
    y = "CASE WHEN r.r1 = 'W' AND r.r2 = 'L' THEN 1 WHEN r.r1 = 'L' AND r.r2 = 'W' THEN 0 END"
    views = ", ".join(f"past_{k} AS MATERIALIZED (SELECT r.fight_id, r.date, {y} AS y, r.expected_1 AS elo_probability, r.before_1 - r.before_2 AS elo_difference, t.* EXCLUDE (fight_id) FROM rated r JOIN turned t ON t.fight_id = r.fight_id WHERE r.config = '{k}')" for k in configs)
    return BASE + _CANON + _TWELVE_TURNED + _elo_sql(configs, ratings.WIN_LOSS, "canon") + ", " + views + ", " + model_sql.folds(_FOLD_STARTS)


def _plain_sql(rows: str, model: str) -> str:
    return f"SELECT '{model}' AS model, f.fold, r.y, r.elo_probability AS p FROM {rows} r JOIN fold f ON r.date >= f.start AND r.date < f.stop WHERE r.y IS NOT NULL"


def _models_sql(sets: dict[str, tuple[str, list[str]]]) -> tuple[str, str]:
    """CTEs of the fitted models (name: rows and features), and the rows (model, fold, y, p) of all."""
    parts, told = [], []
    for k, (name, (rows, own)) in enumerate(sets.items()):
        if own:
            parts.append(model_sql.logit(f"m{k}", rows, own))
        told.append(f"SELECT '{name}' AS model, fold, y, p FROM m{k}_told" if own else _plain_sql(rows, name))
    return "".join(f", {p}" for p in parts), " UNION ALL ".join(told)


def _pooled(rows: str) -> str:
    return f"{rows} UNION ALL SELECT model, 'pooled', y, p FROM ({rows})"


_FITTED, _FITTED_ROWS = _models_sql({k: ("past_own", own) for k, own in models.FEATURE_SETS.items()})


@query(_past_sql({"own": _OWN}) + _FITTED + ", " + _metric_sql(_pooled(_FITTED_ROWS), "model, fold", evaluate.LEAST_MODEL))
def logit_models(spark, sf):
    told, _ = models.temporal_experiment(_historical(spark, sf), FIRST, 2)
    return _rounded(evaluate.with_pooled(tables.cut(told), ["model"], evaluate.LEAST_MODEL), _METRICS)


_WEIGHED = ["M3_elo_dominance", "M4_elo_all"]


@query(
    _past_sql({"own": _OWN})
    + "".join(", " + model_sql.logit(k, "past_own", models.FEATURE_SETS[k]) for k in _WEIGHED)
    + " "
    + " UNION ALL ".join(f"SELECT '{k}' AS model, fold, feature, {s6('coefficient')}, {s6('abs(coefficient)', 'abs_coefficient')} FROM {k}_weight" for k in _WEIGHED)
)
def logit_coefficients(spark, sf):
    _, weights = models.temporal_experiment(_historical(spark, sf), FIRST, 2, {k: models.FEATURE_SETS[k] for k in _WEIGHED})
    return _rounded(weights, ["coefficient", "abs_coefficient"])


_ALL = models.FEATURE_SETS["M4_elo_all"]
_COMBINED, _COMBINED_ROWS = _models_sql({"M0": ("past_own", []), "M4": ("past_own", _ALL), "M0_recency_2y": ("past_2y", []), "M4_recency_2y": ("past_2y", _ALL)})


@query(
    _past_sql({"own": _OWN, "2y": _TWO})
    + _COMBINED
    + f", f AS (WITH {_metric_sql(_COMBINED_ROWS, 'model, fold', evaluate.LEAST_MODEL).replace('round(', '(').replace(', 6)', ')')}) SELECT model, fold, n, {', '.join(s6(c) for c in _METRICS)} FROM f UNION ALL SELECT model, 'pooled', CAST(sum(n) AS BIGINT), {', '.join(f'round(sum({c} * n) / sum(n), 6)' for c in _METRICS)} FROM f GROUP BY model"
)
def combined_recency(spark, sf):
    fights = tables.cut(competition.bouts(spark, sf))
    return _rounded(experiments.combined(fights, features.numeric_rounds(competition.rounds(spark, sf, fights)), FIRST, 2, (2.0,)), _METRICS)


_SCHEDULED = BASE + _elo_sql({"own": _OWN}, ratings.SHARED_K) + f""", faced AS (SELECT fight_id, side, coalesce(avg(opponent) OVER (PARTITION BY f ORDER BY date, fight_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1500) AS sos
  FROM (SELECT fight_id, date, 1 AS side, f1 AS f, before_2 AS opponent FROM rated UNION ALL SELECT fight_id, date, 2, f2, before_1 FROM rated)),
past_own AS MATERIALIZED (SELECT r.fight_id, r.date, CAST(r.r1 = 'W' AS INT) AS y, r.expected_1 AS elo_probability, r.before_1 - r.before_2 AS elo_difference, x.sos - z.sos AS sos_difference FROM rated r JOIN faced x ON x.fight_id = r.fight_id AND x.side = 1 JOIN faced z ON z.fight_id = r.fight_id AND z.side = 2),
{model_sql.folds(_FOLD_STARTS)}, {model_sql.logit("m1", "past_own", ["elo_difference", "sos_difference"], scale=False)}"""


@query(_SCHEDULED + ", " + _metric_sql(_pooled(_plain_sql("past_own", "elo") + " UNION ALL SELECT 'elo_sos' AS model, fold, y, p FROM m1_told"), "model, fold", evaluate.LEAST_EXPERIMENT))
def schedule_model(spark, sf):
    told, _ = experiments.schedule_experiment(competition.bouts(spark, sf), FIRST, 2)
    return _rounded(evaluate.with_pooled(tables.cut(told), ["model"], evaluate.LEAST_EXPERIMENT), _METRICS)


# Data quality


_PAIR_CHECKS = reduce(dict.__or__, [{f"{p}: landed over attempted": f"{p}_landed > {p}_attempted", f"{p}: negative": f"least({p}_landed, {p}_attempted) < 0"} for p in PAIRS])


@query(BASE + _check_sql("stat", _PAIR_CHECKS | {f"{p}: out of range": f"NOT {p} BETWEEN 0 AND 100" for p in PERCENTAGES} | {f"{c}: negative": f"{c} < 0" for c in (*COUNTS, CONTROL)} | {"round below 1": "coalesce(round < 1, true)"}) + " UNION ALL " + _DUP.format("duplicate fight_id, fighter_id, round", "stat", "fight_id, fighter_id, round"))
def dq_rounds(spark, sf):
    return quality.numeric_rounds(features.numeric_rounds(competition.rounds(spark, sf)))


@query(BASE + _check_sql("zero", {k: v for k, v in _PAIR_CHECKS.items() if "over" in k} | {f"{p}: out of range": f"NOT {p} BETWEEN 0 AND 100" for p in PERCENTAGES} | {"no rounds": "rounds_with_stats < 1"}) + " UNION ALL " + _DUP.format("duplicate fight_id, fighter_id", "zero", "fight_id, fighter_id"))
def dq_totals(spark, sf):
    return quality.fighter_totals(competition.totals(spark, sf))


@query(BASE + _check_sql("long", {"fighter meets themselves": "fighter_id = opponent_id", "unknown result": "result NOT IN ('W', 'L', 'D', 'NC')", "results don''t match": "concat_ws('/', result, opponent_result) IN ('W/W', 'L/L', 'W/D', 'D/W')", "negative duration": "seconds < 0"}) + " UNION ALL SELECT 'fights without two rows', count(*) FROM (SELECT fight_id FROM long GROUP BY 1 HAVING count(*) <> 2 OR count(DISTINCT fighter_id) <> 2)")
def dq_long(spark, sf):
    return quality.long_table(competition.long(spark, sf))


#: Violations planted into the history: column to an expression that both engines read alike.
_PLANTED_HISTORY = {
    "career_fights_before": "CASE WHEN fight_id % 307 = 7 THEN career_fights_before + 1 ELSE career_fights_before END",
    "wins_before": "CASE WHEN fight_id % 311 = 9 THEN wins_before + 2 ELSE wins_before END",
    "win_rate_before": "CASE WHEN fight_id % 313 = 11 THEN 1.5 WHEN fight_id % 3 = 1 AND career_fights_before = 0 THEN 0.5 ELSE win_rate_before END",
}
_PAST = f""", past AS (SELECT fight_id, fighter_id, date, career AS career_fights_before, wins AS wins_before, losses AS losses_before, draws AS draws_before, nc AS nc_before, wins / nullif(career, 0) AS win_rate_before FROM hist),
planted AS (SELECT fight_id, fighter_id, date, losses_before, draws_before, nc_before, {', '.join(f'{e} AS {c}' for c, e in _PLANTED_HISTORY.items())} FROM past),
again AS (SELECT *, row_number() OVER w - 1 AS n, lag(career_fights_before) OVER w AS l FROM planted WINDOW w AS (PARTITION BY fighter_id ORDER BY date, fight_id, fighter_id)) """
_FOUR_COUNTS = "wins_before + losses_before + draws_before + nc_before <> career_fights_before"


def _planted_history(spark, sf):
    rows = _counts(spark, sf)
    return rows.withColumns({c: F.expr(e) for c, e in _PLANTED_HISTORY.items()})


@query(BASE + _PAST + _check_sql("again", {"counters don''t add up": _FOUR_COUNTS, "win rate out of range": "NOT win_rate_before BETWEEN 0 AND 1", "win rate of a debut": "career_fights_before = 0 AND win_rate_before IS NOT NULL", "career differs when recounted": "n <> career_fights_before", "career has a gap": "career_fights_before <> coalesce(l + 1, 0)"}))
def dq_history(spark, sf):
    return quality.history(_planted_history(spark, sf))


@query(BASE + _PAST + f"SELECT fighter_id, fight_id, CAST(career_fights_before AS INT) AS career_fights_before FROM planted WHERE {_FOUR_COUNTS} ORDER BY fighter_id, fight_id LIMIT 20")
def dq_samples(spark, sf):
    return quality.offending(_planted_history(spark, sf), F.expr(_FOUR_COUNTS), ["fighter_id", "fight_id"], ["career_fights_before"])


@query(BASE + """, lost AS (SELECT fight_id FROM bout WHERE fight_id % 41 <> 0), kept AS (SELECT fight_id FROM bout WHERE fight_id % 40 <> 0)
SELECT 'keys lost' AS "check", count(*) AS violations FROM lost WHERE fight_id % 40 = 0 UNION ALL SELECT 'keys added', count(*) FROM kept WHERE fight_id % 41 = 0 UNION ALL SELECT 'row count differs', abs((SELECT count(*) FROM lost) - (SELECT count(*) FROM kept))
UNION ALL SELECT 'statistics of one side only', count(*) FROM (SELECT fight_id FROM long WHERE fight_id % 40 <> 0 GROUP BY 1 HAVING count(*) FILTER (WHERE rounds_with_stats IS NOT NULL AND NOT (side = 2 AND fight_id % 43 = 0)) = 1)""")
def dq_bouts(spark, sf):
    """Fights that are lost and added, and sides that lack their statistics, are planted."""
    fights = competition.bouts(spark, sf)
    wide = features.bout_wide(fights, competition.totals(spark, sf)).withColumn("rounds_with_stats_fighter_2", F.expr("CASE WHEN fight_id % 43 <> 0 THEN rounds_with_stats_fighter_2 END"))
    return quality.bout_features(fights.filter("fight_id % 41 <> 0"), wide.filter("fight_id % 40 <> 0"))


#: Violations planted into fights and rounds: column to an expression that both engines read alike.
_PLANTED_FIGHTS = {
    "event_id": "CASE WHEN fight_id % 100 <> 1 THEN event_id END",
    "fighter_1_id": "CASE WHEN fight_id % 101 <> 2 THEN fighter_1_id END",
    "fighter_2_id": "CASE WHEN fight_id % 102 <> 3 THEN fighter_2_id END",
    "fighter_1_result": "CASE WHEN fight_id % 105 = 4 THEN 'W' WHEN fight_id % 106 = 5 THEN NULL ELSE fighter_1_result END",
    "fighter_2_result": "CASE WHEN fight_id % 105 = 4 THEN 'W' ELSE fighter_2_result END",
    "fight_id": "CASE WHEN fight_id % 109 <> 6 THEN fight_id END",
}
_PLANTED_ROUNDS = {
    "fighter_id": "CASE WHEN fight_id % 104 = 9 AND round = 1 THEN NULL ELSE fighter_id END",
    "round": "CASE WHEN fight_id % 108 = 7 THEN NULL ELSE round END",
    "fight_id": "CASE WHEN fight_id % 110 = 8 AND round = 1 THEN NULL ELSE fight_id END",
}
_named = lambda planted: ", ".join(f"{e} AS {c}" for c, e in planted.items())
_INTEGRITY = {
    "fights": {f"fights without {c}": f"{c} IS NULL" for c in ("fight_id", "event_id", "fighter_1_id", "fighter_2_id")} | {"impossible results": "concat(coalesce(fighter_1_result, '?'), '/', coalesce(fighter_2_result, '?')) NOT IN ('W/L', 'L/W', 'D/D', 'NC/NC')"},
    "rounds": {f"rounds without {c}": f"{c} IS NULL" for c in ("fight_id", "fighter_id", "round")},
}
_UNKNOWN = "SELECT '{0}' AS \"check\", count(*) AS violations FROM {1} WHERE {2} IS NOT NULL AND {2} NOT IN (SELECT {4} FROM {3} WHERE {4} IS NOT NULL)"


@query(
    BASE
    + f""", raw AS (SELECT fight_id, strftime(date, '%Y%m%d') AS event_id, f1 AS fighter_1_id, f2 AS fighter_2_id, r1 AS fighter_1_result, r2 AS fighter_2_result FROM bout),
fights AS (SELECT {_named(_PLANTED_FIGHTS)} FROM (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE fight_id % 103 = 3)),
rounds AS (SELECT {_named(_PLANTED_ROUNDS)} FROM (SELECT fight_id, fighter_id, round FROM stat UNION ALL SELECT fight_id, fighter_id, round FROM stat WHERE fight_id % 107 = 5)),
days AS (SELECT DISTINCT event_id FROM raw WHERE event_id[5:6] <> '02'), events AS (SELECT * FROM days UNION ALL SELECT * FROM days WHERE event_id[7:8] = '01'),
people AS (SELECT s_suppkey AS fighter_id FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 = 1)
"""
    + " UNION ALL ".join(
        [_check_sql(k, v) for k, v in _INTEGRITY.items()]
        + [_DUP.format(f"duplicate {k}", t, k) for t, k in (("events", "event_id"), ("people", "fighter_id"), ("fights", "fight_id"), ("rounds", "fight_id, fighter_id, round"))]
        + [_UNKNOWN.format(*x) for x in (("fights of unknown events", "fights", "event_id", "events", "event_id"), ("fights of unknown fighters (1)", "fights", "fighter_1_id", "people", "fighter_id"), ("fights of unknown fighters (2)", "fights", "fighter_2_id", "people", "fighter_id"), ("rounds of unknown fights", "rounds", "fight_id", "fights", "fight_id"), ("rounds of unknown fighters", "rounds", "fighter_id", "people", "fighter_id"))]
    )
)
def dq_report(spark, sf):
    """Every check of the integrity report meets planted violations."""
    fights = competition.bouts(spark, sf)
    planted = fights.union(fights.filter("fight_id % 103 = 3")).select(*[F.expr(e).alias(c) for c, e in _PLANTED_FIGHTS.items()])
    rounds = competition.rounds(spark, sf, fights)
    rounds = rounds.union(rounds.filter("fight_id % 107 = 5")).select(*[F.expr(e).alias(c) for c, e in _PLANTED_ROUNDS.items()])
    days = fights.select("event_id").distinct().filter("substr(event_id, 5, 2) <> '02'")
    people = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fighter_id"))
    known = people.filter("fighter_id % 10 <> 0").union(people.filter("fighter_id % 50 = 1"))
    return quality.etl_integrity(days.union(days.filter("substr(event_id, 7, 2) = '01'")), known, planted, rounds)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
