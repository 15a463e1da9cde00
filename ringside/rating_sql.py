"""DuckDB SQL of the sequential ratings, for the oracles of the rating queries.

Bouts are dealt into levels: a bout's level is one more than the later of the levels of its two
sides' bouts before. Bouts of a level share no competitor, so a recursive query takes a
level at a time: it joins the level's bouts with the state of each competitor, and hands on the
new states. All bouts are walked; nothing is cut short.
"""

from __future__ import annotations

from .functions.text import NON_STANDARD_DIVISIONS
from .operators.ratings import Dialect, EloConfig

_DECIDED = "(r1 = 'W' AND r2 = 'L') OR (r1 = 'L' AND r2 = 'W')"


def levels(bouts: str, decided_only: bool) -> str:
    """CTE `b`: the bouts (fight_id, date, f1, f2, r1, r2, division) with their level."""
    return f"""
own AS MATERIALIZED (SELECT fight_id, date, f1, f2, r1, r2, division FROM {bouts}{f" WHERE {_DECIDED}" if decided_only else ""}),
line AS (SELECT fight_id, f, row_number() OVER (PARTITION BY f ORDER BY date, fight_id) AS n FROM (SELECT fight_id, date, f1 AS f FROM own UNION ALL SELECT fight_id, date, f2 FROM own)),
turn AS MATERIALIZED (SELECT o.*, x.n AS n1, y.n AS n2 FROM own o JOIN line x ON x.fight_id = o.fight_id AND x.f = o.f1 JOIN line y ON y.fight_id = o.fight_id AND y.f = o.f2),
met AS (
  SELECT 0 AS level, f AS id, CAST(0 AS BIGINT) AS done, CAST(NULL AS BIGINT) AS fight_id FROM (SELECT DISTINCT f FROM line)
  UNION ALL
  SELECT * FROM (
    WITH st AS (SELECT * FROM met WHERE fight_id IS NULL),
    ready AS (SELECT t.fight_id, t.f1, t.f2, x.level + 1 AS level FROM turn t JOIN st x ON x.id = t.f1 AND x.done = t.n1 - 1 JOIN st y ON y.id = t.f2 AND y.done = t.n2 - 1)
    SELECT s.level + 1, s.id, s.done + CAST(r.fight_id IS NOT NULL AS BIGINT), CAST(NULL AS BIGINT) FROM st s LEFT JOIN (SELECT f1 AS f, fight_id FROM ready UNION ALL SELECT f2, fight_id FROM ready) r ON r.f = s.id WHERE EXISTS (SELECT 1 FROM ready)
    UNION ALL SELECT level, NULL, NULL, fight_id FROM ready)),
b AS MATERIALIZED (SELECT o.*, m.level FROM own o JOIN met m ON m.fight_id = o.fight_id)"""


def elo(bouts: str, configs: dict[str, EloConfig], dialect: Dialect) -> str:
    """CTE `rated`: (config, fight_id, date, ...) as operators.ratings.elo gives it."""
    number = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x!r} AS DOUBLE)"
    values = " UNION ALL ".join(f"SELECT '{k}' AS config, {number(c.initial_rating)} AS start, {number(c.base_k)} AS base_k, {number(c.boosted_k)} AS boosted_k, {number(c.scale)} AS scale, {c.provisional_fights} AS least_fights, {number(c.half_life_years)} AS half_life" for k, c in configs.items())
    odd = ", ".join(f"'{d}'" for d in NON_STANDARD_DIVISIONS)
    moved = (lambda s: f"coalesce(division <> {s}.division AND division NOT IN ({odd}) AND {s}.division NOT IN ({odd}), false)") if dialect.switches else (lambda s: "false")
    days = lambda s: f"CASE WHEN half_life IS NULL OR {s}.day IS NULL THEN 0 ELSE greatest(0, date_diff('day', {s}.day, date)) END"
    score = "CASE WHEN 'NC' IN (r1, r2) THEN NULL WHEN r1 = 'W' THEN 1.0::DOUBLE WHEN r1 = 'L' THEN 0.0 WHEN r1 = 'D' THEN 0.5 END" if dialect.draws else "CASE WHEN r1 = 'W' AND r2 = 'L' THEN 1.0::DOUBLE WHEN r1 = 'L' AND r2 = 'W' THEN 0.0 END"
    new = lambda n: f"least_fights > {n}.fights" + (f" OR least_fights > since_{n}" if dialect.switches else "")
    boost = lambda n: f"({new('p')} OR {new('q')})" if dialect.shared_k else f"({new(n)})"
    counts = "true" if dialect.no_contests else "score IS NOT NULL"
    state = lambda n, after: f"{{'rating': CASE WHEN {counts} THEN {after} ELSE {n}.rating END, 'fights': {n}.fights + CAST({counts} AS BIGINT), 'since': since_{n} + CAST({counts} AS BIGINT), 'division': coalesce(division, {n}.division), 'day': date}}"
    return f"""{levels(bouts, dialect.decided_only)},
setup AS MATERIALIZED ({values}),
walk AS (
  SELECT 0 AS level, c.config, f.id, {{'rating': c.start, 'fights': CAST(0 AS BIGINT), 'since': CAST(0 AS BIGINT), 'division': CAST(NULL AS VARCHAR), 'day': CAST(NULL AS DATE)}} AS s,
    CAST(NULL AS STRUCT(fight_id BIGINT, r DOUBLE[], n BIGINT[], f BOOLEAN[])) AS o
  FROM setup c, (SELECT DISTINCT f AS id FROM line) f
  UNION ALL
  SELECT * FROM (
    WITH st AS (SELECT * FROM walk WHERE o IS NULL),
    m AS (SELECT b.*, c.*, x.s AS p, y.s AS q FROM b JOIN st x ON x.id = b.f1 AND x.level + 1 = b.level JOIN st y ON y.id = b.f2 AND y.config = x.config JOIN setup c ON c.config = x.config),
    m1 AS (SELECT *, {moved('p')} AS moved_p, {moved('q')} AS moved_q, {days('p')} AS days_p, {days('q')} AS days_q, {score} AS score FROM m),
    m2 AS (SELECT *, CASE WHEN half_life IS NULL OR p.day IS NULL THEN 1.0::DOUBLE ELSE pow(2.0, -days_p / (half_life * 365.25)) END AS factor_p, CASE WHEN half_life IS NULL OR q.day IS NULL THEN 1.0::DOUBLE ELSE pow(2.0, -days_q / (half_life * 365.25)) END AS factor_q,
      CASE WHEN moved_p THEN 0 ELSE p.since END AS since_p, CASE WHEN moved_q THEN 0 ELSE q.since END AS since_q FROM m1),
    m3 AS (SELECT *, CASE WHEN half_life IS NULL OR p.day IS NULL THEN p.rating ELSE start + (p.rating - start) * factor_p END AS ra, CASE WHEN half_life IS NULL OR q.day IS NULL THEN q.rating ELSE start + (q.rating - start) * factor_q END AS rb,
      CASE WHEN {boost('p')} THEN boosted_k ELSE base_k END AS k_1, CASE WHEN {boost('q')} THEN boosted_k ELSE base_k END AS k_2 FROM m2),
    m4 AS (SELECT *, greatest({dialect.least!r}::DOUBLE, least(1.0 - {dialect.least!r}::DOUBLE, 1.0 / (1.0 + pow(10.0, (rb - ra) / scale)))) AS expected FROM m3),
    m5 AS (SELECT *, CASE WHEN score IS NULL THEN ra ELSE ra + k_1 * (score - expected) END AS after_1, CASE WHEN score IS NULL THEN rb ELSE rb + k_2 * ((1.0 - score) - (1.0 - expected)) END AS after_2 FROM m4),
    u AS (SELECT config, f1 AS id, {state('p', 'after_1')} AS s FROM m5 UNION ALL SELECT config, f2, {state('q', 'after_2')} FROM m5)
    SELECT st.level + 1, st.config, st.id, coalesce(u.s, st.s), st.o FROM st LEFT JOIN u ON u.id = st.id AND u.config = st.config WHERE st.level < (SELECT max(level) FROM b)
    UNION ALL SELECT level, config, NULL, NULL, {{'fight_id': fight_id, 'r': [p.rating, q.rating, ra, rb, after_1, after_2, expected, k_1, k_2, factor_p, factor_q], 'n': [days_p, days_q, p.fights, q.fights], 'f': [moved_p, moved_q, score IS NOT NULL]}} FROM m5)),
rated AS MATERIALIZED (SELECT w.config, b.*, o.r[1] AS historical_1, o.r[2] AS historical_2, o.r[3] AS before_1, o.r[4] AS before_2, o.r[5] AS after_1, o.r[6] AS after_2, o.r[7] AS expected_1, 1.0 - o.r[7] AS expected_2, o.r[8] AS k_1, o.r[9] AS k_2, o.r[10] AS factor_1, o.r[11] AS factor_2,
  o.n[1] AS days_1, o.n[2] AS days_2, o.n[3] AS career_1, o.n[4] AS career_2, o.f[1] AS switch_1, o.f[2] AS switch_2, o.f[3] AS updated FROM walk w JOIN b ON b.fight_id = w.o.fight_id WHERE w.o IS NOT NULL)"""


def by_fighter(cte: str = "rated") -> str:
    """CTE `sided`: two rows a bout, as operators.ratings.by_fighter gives them."""
    view = lambda a, b: f"SELECT config, fight_id, date, division, f{a} AS fighter_id, f{b} AS opponent_id, r{a} AS result, career_{a} AS career_fights_before, career_{a} = 0 AS is_debut, switch_{a} AS is_division_change, k_{a} AS k_factor, updated AS rating_updated, days_{a} AS days_since_last_fight, factor_{a} AS recency_factor, expected_{a} AS expected_score, historical_{a} AS rating_historical_before, before_{a} AS rating_before, after_{a} AS rating_after FROM {cte}"
    return f"sided AS MATERIALIZED ({view(1, 2)} UNION ALL {view(2, 1)})"


def glicko2(bouts: str, tau: float, steps: int = 8, unit: float = 173.7178) -> str:
    """CTE `played`: bouts with a winner, with ratings, deviations and volatilities of both sides before and after.

    The root that an update seeks lies so near its start that a fixed number of Newton steps reaches it to
    the last digits.
    """
    e, free, over = "exp(x)", "(delta * delta - w - exp(x))", "(w + exp(x))"
    value = f"({e} * {free} / (2 * {over} * {over}) - (x - a) / {tau * tau!r})"
    slope = f"(({e} * ({free} - {e}) * {over} - 2 * {e} * {e} * {free}) / (2 * {over} * {over} * {over}) - 1 / {tau * tau!r})"
    fields = ", ".join(f"max(CASE WHEN o.side = {n} THEN o.w[{k}] END) AS {what}_{n}_{when}" for when, at in (("before", 1), ("after", 4)) for n in (1, 2) for k, what in enumerate(("rating", "rd", "vol"), at))
    return f"""{levels(bouts, True)},
walk AS (
  SELECT 0 AS level, f AS id, {{'r': 1500.0::DOUBLE, 'd': 350.0::DOUBLE, 'v': 0.06::DOUBLE}} AS s, CAST(NULL AS STRUCT(fight_id BIGINT, side BIGINT, w DOUBLE[])) AS o FROM (SELECT DISTINCT f FROM line)
  UNION ALL
  SELECT * FROM (
    WITH st AS (SELECT * FROM walk WHERE o IS NULL),
    m AS (SELECT b.level, b.fight_id, b.f1, b.f2, b.r1, x.s AS p, y.s AS q FROM b JOIN st x ON x.id = b.f1 AND x.level + 1 = b.level JOIN st y ON y.id = b.f2),
    two AS (SELECT level, fight_id, 1 AS side, f1 AS id, p, q, CASE WHEN r1 = 'W' THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM m UNION ALL SELECT level, fight_id, 2, f2, q, p, CASE WHEN r1 = 'W' THEN 0.0::DOUBLE ELSE 1.0 END FROM m),
    t1 AS (SELECT *, (p.r - 1500) / {unit} AS mu, p.d / {unit} AS phi, (q.r - 1500) / {unit} AS other, 1 / sqrt(1 + 3 * pow(q.d / {unit}, 2) / pow(pi(), 2)) AS g FROM two),
    t2 AS (SELECT *, 1 / (1 + exp(-g * (mu - other))) AS hope FROM t1),
    t3 AS (SELECT *, g * g * hope * (1 - hope) AS inverse, g * (score - hope) AS gain, ln(p.v * p.v) AS a FROM t2),
    t4 AS (SELECT *, gain / inverse AS delta, phi * phi + 1 / inverse AS w FROM t3),
    t5 AS (SELECT *, exp(list_reduce([a{", 0.0" * steps}]::DOUBLE[], lambda x, _: x - {value} / {slope}) / 2) AS vol FROM t4),
    t6 AS (SELECT *, 1 / sqrt(1 / (phi * phi + vol * vol) + inverse) AS spread FROM t5),
    t7 AS (SELECT level, fight_id, side, id, p, {{'r': (mu + spread * spread * gain) * {unit} + 1500, 'd': spread * {unit}, 'v': vol}} AS s FROM t6)
    SELECT st.level + 1, st.id, coalesce(u.s, st.s), st.o FROM st LEFT JOIN t7 u ON u.id = st.id WHERE st.level < (SELECT max(level) FROM b)
    UNION ALL SELECT level, NULL, NULL, {{'fight_id': fight_id, 'side': side, 'w': [p.r, p.d, p.v, s.r, s.d, s.v]}} FROM t7)),
played AS MATERIALIZED (SELECT b.fight_id, b.date, b.r1, {fields} FROM walk w JOIN b ON b.fight_id = w.o.fight_id WHERE w.o IS NOT NULL GROUP BY b.fight_id, b.date, b.r1)"""
