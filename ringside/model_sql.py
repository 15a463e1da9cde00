"""DuckDB SQL of the logistic models, for the oracles of the model queries.

The penalised likelihood is climbed by steps with a fixed matrix, first a quarter of the Gram matrix
plus the ridge: that bounds the curvature from above, so every step gains. The curvature at the
point so reached then serves for the last steps, each of which leaves a small part of the way
only. Both matrices are inverted once, by elimination over lists.
"""

from __future__ import annotations


def folds(starts: list[str]) -> str:
    """CTE `fold`: (k, fold, start, stop)."""
    ends = [*starts[1:], "9999-01-01"]
    return "fold AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', DATE '{a}', DATE '{b}')" for k, (a, b) in enumerate(zip(starts, ends))) + ") v(k, fold, start, stop))"


def logit(m: str, rows: str, features: list[str], scale: bool = True, steps: int = 20) -> str:
    """CTEs of one model: {m}_told (fold, fight_id, date, y, p) and {m}_weight (fold, feature, coefficient).

    rows: (fight_id, date, y, features...), of which rows without y are left out.
    """
    n = len(features)
    names = [*features, *([f"{c}__missing" for c in features] if scale else [])]
    p = len(names) + 1
    each = lambda f: ", ".join(f(i, c) for i, c in enumerate(features, 1))
    if scale:
        fill = each(lambda i, c: f"coalesce(r.{c}, m.m{i}) AS x{i}") + ", " + each(lambda i, c: f"CAST(r.{c} IS NULL AS INT) AS x{n + i}")
        figures = ", ".join(f"avg(x{i}) AS a{i}, coalesce(nullif(stddev_pop(x{i}), 0), 1) AS d{i}" for i in range(1, p))
    else:
        fill = each(lambda i, c: f"r.{c} AS x{i}")
        figures = ", ".join(f"0.0::DOUBLE AS a{i}, 1.0::DOUBLE AS d{i}" for i in range(1, p))
    line = "[" + ", ".join(f"(x{i} - a{i}) / d{i}" for i in range(1, p)) + ", 1.0]::DOUBLE[]"
    gram = lambda w: "[" + ", ".join("[" + ", ".join([f"sum({w} * x[{min(i, j)}] * x[{max(i, j)}]){' + 1' if i == j < p else ''}" for j in range(1, p + 1)] + [f"{float(i == j)}" for j in range(1, p + 1)]) + "]::DOUBLE[]" for i in range(1, p + 1)) + "]"
    nothing = f"{{'k': 0, 'm': []::DOUBLE[][]}}"
    solved = f"list_reduce([{{'k': 1, 'm': g}}{(', ' + nothing) * p}], lambda t, u: {{'k': t.k + 1, 'm': list_transform(t.m, lambda row, i: CASE WHEN i = t.k THEN list_transform(row, lambda v: v / t.m[t.k][t.k]) ELSE list_transform(row, lambda v, j: v - row[t.k] * t.m[t.k][j] / t.m[t.k][t.k]) END)}}).m"
    slope = "[" + ", ".join(f"sum(e * x[{i}])" + (f" + any_value(b[{i}])" if i < p else "") for i in range(1, p + 1)) + "]"
    climb = lambda r, matrix, start: f"""{m}_gram{r} AS ({matrix}),
{m}_back{r} AS MATERIALIZED (SELECT k, list_transform({solved}, lambda row: row[{p + 1}:{2 * p}]) AS h FROM {m}_gram{r}),
{m}_fit{r} AS (
  SELECT 0 AS step, k, b FROM ({start})
  UNION ALL
  SELECT step + 1, k, b FROM (
    WITH now AS (SELECT f.step, f.k, f.b, o.x, 1 / (1 + exp(-list_dot_product(o.x, f.b))) - o.y AS e FROM {m}_fit{r} f JOIN {m}_obs o ON o.k = f.k WHERE f.step < {steps}),
    up AS (SELECT step, k, any_value(b) AS b, {slope} AS g FROM now GROUP BY step, k)
    SELECT u.step, u.k, list_transform(i.h, lambda row, j: u.b[j] - list_dot_product(row, u.g)) AS b FROM up u JOIN {m}_back{r} i ON i.k = u.k)),
{m}_done{r} AS MATERIALIZED (SELECT k, b FROM {m}_fit{r} WHERE step = {steps})"""  # noqa: E731
    return f"""{m}_raw AS (SELECT f.k, h.y, {each(lambda i, c: f"h.{c}")} FROM {rows} h JOIN fold f ON h.date < f.start WHERE h.y IS NOT NULL),
{m}_mid AS (SELECT k, {each(lambda i, c: f"median({c}) AS m{i}")} FROM {m}_raw GROUP BY k HAVING count(DISTINCT y) = 2),
{m}_full AS (SELECT r.k, r.y, {fill} FROM {m}_raw r JOIN {m}_mid m ON m.k = r.k),
{m}_figure AS MATERIALIZED (SELECT k, {figures} FROM {m}_full GROUP BY k),
{m}_obs AS MATERIALIZED (SELECT r.k, r.y, {line} AS x FROM {m}_full r JOIN {m}_figure f ON f.k = r.k),
{climb(1, f"SELECT k, {gram('0.25')} AS g FROM {m}_obs GROUP BY k", f"SELECT k, [{', '.join(['0.0'] * p)}]::DOUBLE[] AS b FROM {m}_mid")},
{climb(2, f"SELECT k, {gram('w')} AS g FROM (SELECT o.k, o.x, q * (1 - q) AS w FROM (SELECT o.k, o.x, 1 / (1 + exp(-list_dot_product(o.x, f.b))) AS q FROM {m}_done1 f JOIN {m}_obs o ON o.k = f.k) o) GROUP BY k", f"SELECT k, b FROM {m}_done1")},
{m}_end AS MATERIALIZED (SELECT t.fold, t.start, t.stop, f.* FROM {m}_done2 f JOIN fold t ON t.k = f.k),
{m}_told AS (SELECT r.fold, r.fight_id, r.date, r.y, 1 / (1 + exp(-list_dot_product({line}, b))) AS p FROM (SELECT e.fold, e.k, e.b, r.fight_id, r.date, r.y, {fill} FROM {rows} r JOIN {m}_end e ON r.date >= e.start AND r.date < e.stop JOIN {m}_mid m ON m.k = e.k WHERE r.y IS NOT NULL) r JOIN {m}_figure f ON f.k = r.k),
{m}_weight AS ({' UNION ALL '.join(f"SELECT e.fold, '{c}' AS feature, e.b[{i}] AS coefficient FROM {m}_end e" + (f" JOIN {m}_figure f ON f.k = e.k WHERE f.a{i} > 0" if i > n else "") for i, c in enumerate(names, 1))})"""
