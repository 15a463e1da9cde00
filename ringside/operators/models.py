"""Logistic outcome models on pre-bout features, with imputing and scaling fitted on train only.

All models of all train sets are fitted at once. A train set is what lies before a fold, so a row belongs to
the sets of all later folds. Medians take some rounds of histograms (operators.select), means and
deviations one aggregation, and a Newton step is one aggregation too: each task sums the gradients
and the small Gram matrices of its rows for every set and model, and hands on one row for each. The
number of jobs depends neither on the folds nor on the models. What the driver holds is a
vector and a matrix of some tens of features for each fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .evaluate import fold_start, in_folds
from .history import DOMINANCE, GRAPPLING, STRIKING
from .select import medians

difference = lambda names: [f"{c}_difference" for c in names]
#: Features of each model; the first is the plain Elo probability, which is not fitted.
FEATURE_SETS: dict[str, list[str]] = {
    "M0_elo": [],
    "M1_elo_striking": ["elo_difference", *difference(STRIKING)],
    "M2_elo_grappling": ["elo_difference", *difference(GRAPPLING)],
    "M3_elo_dominance": ["elo_difference", *difference(DOMINANCE)],
    "M4_elo_all": ["elo_difference", *difference([*STRIKING, *GRAPPLING, *DOMINANCE])],
    "M5_performance_only": difference([*STRIKING, *GRAPPLING, *DOMINANCE]),
}


@dataclass
class Preparation:
    """Medians, and means and deviations after imputing; one figure a feature."""

    features: list[str]
    flagged: list[str]  # features that were missing in train
    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]

    @property
    def names(self) -> list[str]:
        return [*self.features, *[f"{c}__missing" for c in self.flagged]]

    def of(self, features: list[str]) -> Preparation:
        """The part of some features."""
        own = Preparation(features, [c for c in features if c in self.flagged], self.median, {}, {})
        own.mean, own.std = {n: self.mean[n] for n in own.names}, {n: self.std[n] for n in own.names}
        return own

    def imputed(self, df: DataFrame) -> DataFrame:
        full = {f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.median[c])) for c in self.features}
        return df.withColumns(full | {f"__f_{c}__missing": F.col(c).isNull().cast("double") for c in self.flagged})

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` with a column __f_<name> for every name, imputed and scaled."""
        return self.imputed(df).withColumns({f"__f_{n}": (F.col(f"__f_{n}") - self.mean[n]) / self.std[n] for n in self.names})


@dataclass
class Fit:
    """Coefficients by the names of the preparation, on scaled features, and the intercept."""

    preparation: Preparation
    coefficients: list[float]
    intercept: float

    def line(self, features: list[str]) -> tuple[float, list[float], list[float], list[float]]:
        """(base, slope, jump, fill) for raw features: log-odds = base + sum of slope * (value, or fill) + jump * missing."""
        p, weight = self.preparation, dict(zip(self.preparation.names, self.coefficients))
        scaled = {n: w / p.std[n] for n, w in weight.items()}
        base = self.intercept - sum(v * p.mean[n] for n, v in scaled.items())
        return base, [scaled.get(c, 0.0) for c in features], [scaled.get(f"{c}__missing", 0.0) for c in features], [p.median.get(c, 0.0) for c in features]

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """`df` with the probability of target 1."""
        own = self.preparation.features
        base, slope, jump, fill = self.line(own)
        z = F.lit(base)
        for c, w, j, v in zip(own, slope, jump, fill):
            z = z + w * F.coalesce(F.col(c).cast("double"), F.lit(v)) + j * F.col(c).isNull().cast("double")
        return df.withColumn(out, 1 / (1 + F.exp(-z)))


def prepare_all(rows: DataFrame, features: list[str], sets: list[int], scale: bool = True) -> dict[int, Preparation]:
    """The preparation of each train set: exact medians, indicators of what is missing, means and population deviations.

    rows: with a column `member`, the array of the sets that a row belongs to. A feature that is never there
    has median 0; a constant one is only centred. scale: else features are taken as they are,
    and a missing one is an error.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).cast("double").alias("value")) for k, c in enumerate(features)]))
    long = rows.select("member", each.alias("f")).select(F.explode("member").alias("set"), "f.feature", "f.value")
    # a count of each set comes with the first pass over it, so that a feature without any value has a row too
    there = {(r["set"], r["feature"]): (r["n"], r["missing"]) for r in long.groupBy("set", "feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing")).collect()}
    if not scale:
        if any(missing for _, missing in there.values()):
            raise ValueError("a feature is missing")
        plain = Preparation(features, [], dict.fromkeys(features, 0.0), dict.fromkeys(features, 0.0), dict.fromkeys(features, 1.0))
        return dict.fromkeys(sets, plain)
    median = {(r["set"], r["feature"]): r["median"] for r in medians(long, ["set", "feature"], "value").collect()}
    fill = F.broadcast(rows.sparkSession.createDataFrame([(*key, float(median.get(key, 0.0))) for key in there] or [(-1, -1, 0.0)], "set int, feature int, fill double"))
    full = F.coalesce("value", "fill")
    told = long.join(fill, ["set", "feature"]).groupBy("set", "feature").agg(F.avg(full).alias("mean"), F.stddev_pop(full).alias("std")).collect()  # sets x features
    out = {}
    for s in sets:
        own = Preparation(features, [c for k, c in enumerate(features) if there.get((s, k), (0, 0))[1]], {c: float(median.get((s, k), 0.0)) for k, c in enumerate(features)}, {}, {})
        for r in told:
            if r["set"] == s:
                own.mean[features[r["feature"]]], own.std[features[r["feature"]]] = float(r["mean"]), float(r["std"]) or 1.0
        for k, c in enumerate(features):
            if c in own.flagged:
                n, missing = there[s, k]
                q = missing / n
                own.mean[f"{c}__missing"], own.std[f"{c}__missing"] = q, (q * (1 - q)) ** 0.5 or 1.0
        out[s] = own
    return out


def prepare(train: DataFrame, features: list[str]) -> Preparation:
    """The preparation of one train set."""
    return prepare_all(train.withColumn("member", F.array(F.lit(0))), features, [0])[0]


@dataclass
class _Work:
    """One fit under way: where it is, and the loss and step that led there."""

    preparation: Preparation
    at: np.ndarray
    best: np.ndarray = field(default=None)
    loss: float = float("inf")
    done: bool = False


def _sums(features: list[str], open_: dict[tuple[int, str], _Work]):
    """A function for mapInArrow: (set, model, sums) of the rows of a task; sums: loss, gradient, and Gram matrix."""
    column = {c: k for k, c in enumerate(features)}
    told = []
    for (s, name), w in open_.items():
        p = w.preparation
        told.append((s, name, [column[c] for c in p.features], [column[c] for c in p.flagged], np.array([p.median[c] for c in p.features]), np.array([p.mean[n] for n in p.names]), np.array([p.std[n] for n in p.names]), w.at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]) if features else np.zeros((batch.num_rows, 0))
            member, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            of = {s: np.array([s in m for m in member]) for s in {t[0] for t in told}}
            for s, name, own, flagged, fill, mean, std, at in told:
                x, own_y = raw[of[s]], y[of[s]]
                if not len(own_y):
                    continue
                values, lost = x[:, own], np.isnan(x[:, flagged])
                full = (np.hstack([np.where(np.isnan(values), fill, values), lost]) - mean) / std
                full = np.hstack([full, np.ones((len(own_y), 1))])
                z = full @ at
                p = 0.5 * (1 + np.tanh(z / 2))
                loss = (np.logaddexp(0, z) - own_y * z).sum()
                gram = full.T @ (full * (p * (1 - p))[:, None])
                sums = np.concatenate([[loss], full.T @ (p - own_y), gram.ravel()])
                total[s, name] = total.get((s, name), 0) + sums
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], ["set", "model", "sums"])

    return run


def fit_all(rows: DataFrame, wanted: dict[int, dict[str, list[str]]], target: str = "target", scale: bool = True, steps: int = 50, tolerance: float = 1e-9) -> dict[tuple[int, str], Fit]:
    """Logistic regressions with a ridge of C = 1 and a free intercept: a Fit for each (set, model).

    rows: with `member`, the array of the sets that a row belongs to; wanted: the features of the
    models of each set. A Newton step that raises the loss is halved; a fit that hasn't settled
    after `steps` is an error.
    """
    features = sorted({c for models in wanted.values() for own in models.values() for c in own})
    ready = prepare_all(rows, features, list(wanted), scale)
    work = {}
    for s, models in wanted.items():
        for name, own in models.items():
            p = ready[s].of(own)
            work[s, name] = _Work(p, np.zeros(len(p.names) + 1))
    narrow = rows.select("member", F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    for _ in range(steps):
        open_ = {k: w for k, w in work.items() if not w.done}
        if not open_:
            break
        got = narrow.mapInArrow(_sums(features, open_), "set int, model string, sums array<double>")
        got = got.select("set", "model", F.posexplode("sums").alias("at", "value")).groupBy("set", "model", "at").agg(F.sum("value").alias("value"))
        sums: dict[tuple[int, str], dict[int, float]] = {}
        for r in got.collect():  # a vector and a matrix for each fit
            sums.setdefault((r["set"], r["model"]), {})[r["at"]] = r["value"]
        for key, w in open_.items():
            n = len(w.at)
            if key not in sums:
                raise ValueError("training needs rows of both classes")
            flat = np.array([sums[key][k] for k in range(1 + n + n * n)])
            ridge = np.append(np.ones(n - 1), 0.0)
            loss = flat[0] + 0.5 * (ridge * w.at**2).sum()
            if loss > w.loss * (1 + 1e-12):
                w.at = (w.at + w.best) / 2
                continue
            step = np.linalg.solve(flat[1 + n :].reshape(n, n) + np.diag(ridge), flat[1 : 1 + n] + ridge * w.at)
            w.best, w.loss, w.at = w.at, loss, w.at - step
            w.done = bool(np.abs(step).max() <= tolerance * (1 + np.abs(w.at).max()))
    if any(not w.done for w in work.values()):
        raise ArithmeticError(f"a fit hasn't settled after {steps} steps")
    return {key: Fit(w.preparation, [float(v) for v in w.at[:-1]], float(w.at[-1])) for key, w in work.items()}


def fit_logit(train: DataFrame, features: list[str], target: str = "target", scale: bool = True) -> Fit:
    """One logistic regression. Raises on an empty train set and on one with a single class."""
    row = train.agg(F.count(target).alias("n"), F.countDistinct(target).alias("k")).first()
    if row["n"] == 0 or row["k"] < 2:
        raise ValueError("training needs rows of both classes")
    return fit_all(train.withColumn("member", F.array(F.lit(0))), {0: {"own": features}}, target, scale)[0, "own"]


def coefficients(fitted: Fit, model: str, fold: str) -> list[tuple[str, str, str, float, float]]:
    return [(model, fold, n, c, abs(c)) for n, c in zip(fitted.preparation.names, fitted.coefficients)]


def temporal_experiment(historical: DataFrame, first: date, step_years: int, models: dict[str, list[str] | str] | None = None, scale: bool = True, folds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, coefficients): each fold is predicted by models fitted on what was before it.

    historical: date, target, elo_probability and the features; rows without a target are left
    out. models: features, or the column of a probability that is there; no features stand for
    elo_probability. folds: named ones (evaluate.in_folds), else steps of years. A fold without both classes
    before it has no fitted models.
    """
    models = FEATURE_SETS if models is None else models
    spark = historical.sparkSession
    ready = {name: own or "elo_probability" for name, own in models.items() if not own or isinstance(own, str)}
    models = {name: own for name, own in models.items() if name not in ready}
    features = sorted({c for own in models.values() for c in own})
    needed = sorted({*features, *ready.values()})
    rows = historical.filter("target is not null and date is not null").select("fight_id", "date", "target", *needed)
    if folds is None:
        rows = rows.withColumn("start", fold_start(F.col("date"), first, step_years)).withColumn("fold", F.col("start").cast("string"))
    else:
        rows = in_folds(rows, folds)
    rows = cut(rows)  # every pass reads it
    told = rows.filter("fold is not null").groupBy("fold").agg(F.min("start").alias("start")).orderBy("start").collect()  # a row for each fold
    starts = [r["start"] for r in told]
    # a row is in the train set of each fold that starts after it
    member = F.filter(F.array(*[F.when(F.col("date") < F.lit(s), F.lit(k)) for k, s in enumerate(starts)]), lambda k: k.isNotNull()) if starts else F.array().cast("array<int>")
    rows = rows.withColumn("member", member)
    classes = {(r["set"], r["target"]) for r in rows.select(F.explode("member").alias("set"), "target").distinct().collect()}
    wanted = {k: models for k in range(len(starts)) if models and {(k, 0), (k, 1)} <= classes}
    fits = fit_all(rows, wanted, scale=scale) if wanted else {}
    weights = [w for (k, name), fit in fits.items() for w in coefficients(fit, name, told[k]["fold"])]
    # a row for each fold and model; a fold's rows meet those of their own fold
    lines = [(told[k]["fold"], name, *fit.line(features)) for (k, name), fit in fits.items()]
    lines += [(r["fold"], name, None, None, None, None) for r in told for name in ready]
    table = spark.createDataFrame(lines, "fold string, model string, base double, slope array<double>, jump array<double>, fill array<double>")
    z = F.col("base")
    for j, c in enumerate(features):
        x = F.col(c).cast("double")
        z = z + F.col("slope")[j] * F.coalesce(x, F.col("fill")[j]) + F.col("jump")[j] * x.isNull().cast("double")
    p = 1 / (1 + F.exp(-z))
    for name, c in ready.items():
        p = F.when(F.col("model") == name, F.col(c).cast("double")).otherwise(p)
    predicted = rows.join(F.broadcast(table), "fold")
    return predicted.select("model", "fold", "fight_id", "date", F.col("target").alias("y"), p.alias("p")), spark.createDataFrame(weights, "model string, fold string, feature string, coefficient double, abs_coefficient double")
