"""Toxicity by a classifier chain.

The categories are predicted in a fixed order, each by a linear (logistic) model over the
words of the text and their beginnings, and over the probabilities of the categories before
it. In training, those are out-of-fold probabilities, so a later model learns how far an
earlier one can be trusted on texts that it has not seen.

Features are present or absent (hashed words and word beginnings), so one insult counts in a
long text as in a short one. Each model keeps the features whose counts in the two classes
differ by more than chance (a likelihood-ratio test).
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns_of_row, cut, drawn, text_of, whole_row
from .letters import words

BITS = 20
STRETCH = 1 << 17  # entries that a sum works on at once


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its first 4 and 5 letters."""
    forms = [f"w{word}"]
    forms += [f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for f in forms]


def features(text: str) -> np.ndarray:
    """The sorted features of a whole text."""
    return np.unique(np.fromiter((f for w in set(words(text)) for f in word_features(w)), np.int32))


@dataclass
class Linear:
    """A logistic model over features of the text and earlier probabilities."""

    weights: dict[int, float]
    extra: np.ndarray
    bias: float

    def margin(self, own: set[int], before: list[float]) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in sorted(own)) + float(np.dot(self.extra, before))

    def margins(self, x: Present, before: np.ndarray) -> np.ndarray:
        """margin() of every row."""
        return self.bias + x.dot(np.array([self.weights.get(int(f), 0.0) for f in x.feats])) + before @ self.extra


@dataclass
class Present:
    """Which features rows have: the places `col[ptr[k]:ptr[k + 1]]` in `feats` for row k.

    Sums run over stretches of about STRETCH entries, so nothing of the size of all entries is
    made beside `col` itself.
    """

    feats: np.ndarray
    ptr: np.ndarray
    col: np.ndarray

    @staticmethod
    def of(rows: Iterable[np.ndarray]) -> Present:
        rows = list(rows)
        feats = np.unique(np.concatenate([np.unique(np.concatenate(rows[k : k + 512])) for k in range(0, len(rows), 512)])) if rows else np.zeros(0, np.int32)
        col = np.empty(sum(map(len, rows)), np.int32)
        ptr = np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)].astype(np.int64)
        for k, r in enumerate(rows):
            col[ptr[k] : ptr[k + 1]] = np.searchsorted(feats, r)
        return Present(feats, ptr, col)

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, at: np.ndarray) -> Present:
        """Some of the rows."""
        size = np.diff(self.ptr)[at]
        ptr = np.r_[0, np.cumsum(size)].astype(np.int64)
        col = np.empty(int(ptr[-1]), np.int32)
        for k, r in enumerate(at):
            col[ptr[k] : ptr[k + 1]] = self.col[self.ptr[r] : self.ptr[r + 1]]
        return Present(self.feats, ptr, col)

    def only(self, on: np.ndarray) -> Present:
        """The rows with some of the features, given by their places."""
        to = np.full(len(self.feats), -1, np.int32)
        to[on] = np.arange(len(on))
        size, parts = np.zeros(len(self), np.int64), []
        for a, b in self._stretches():
            own = to[self.col[self.ptr[a] : self.ptr[b]]]
            size[a:b] = np.bincount(np.repeat(np.arange(b - a), np.diff(self.ptr[a : b + 1]))[own >= 0], minlength=b - a)
            parts.append(own[own >= 0])
        return Present(self.feats[on], np.r_[0, np.cumsum(size)], np.concatenate([*parts, np.zeros(0, np.int32)]))

    def _stretches(self) -> Iterator[tuple[int, int]]:
        cuts = np.searchsorted(self.ptr, np.arange(0, int(self.ptr[-1]) + STRETCH, STRETCH))
        cuts = np.unique(np.r_[0, np.minimum(cuts, len(self)), len(self)]).tolist()
        return zip(cuts, cuts[1:])

    def dot(self, w: np.ndarray) -> np.ndarray:
        """For each row, the sum of w over its features."""
        out = np.zeros(len(self))
        for a, b in self._stretches():
            lo, size = self.ptr[a], np.diff(self.ptr[a : b + 1])
            some = np.flatnonzero(size)
            if len(some):
                out[a + some] = np.add.reduceat(w[self.col[lo : self.ptr[b]]], self.ptr[a:b][some] - lo)
        return out

    def sums(self, r: np.ndarray) -> np.ndarray:
        """For each feature, the sum of r over the rows that have it."""
        out = np.zeros(len(self.feats))
        for a, b in self._stretches():
            out += np.bincount(self.col[self.ptr[a] : self.ptr[b]], weights=np.repeat(r[a:b], np.diff(self.ptr[a : b + 1])), minlength=len(out))
        return out


def _select(x: Present, y: np.ndarray, least_z: float, most: int) -> np.ndarray:
    """Places of the features whose likelihood-ratio statistic G between the classes has a root of `least_z`."""
    a, b = x.sums(y), x.sums(1 - y)
    n1, n0 = y.sum(), len(y) - y.sum()
    f = lambda v: v * np.log(np.maximum(v, 1.0))
    z = np.sqrt(np.maximum(0.0, 2 * (f(a) + f(b) + f(n1 - a) + f(n0 - b) - f(a + b) - f(n1 + n0 - a - b) - f(n1) - f(n0) + f(n1 + n0))))
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= least_z])


def _fit(x: Present, before: np.ndarray, y: np.ndarray, least_z: float = 3.0, most: int = 8192, ridge: float = 1.0, rounds: int = 150) -> Linear:
    """Logistic regression with a ridge, by gradient steps scaled per weight."""
    if not len(y) or y.min() == y.max():
        return Linear({}, np.zeros(before.shape[1]), (6.0 if len(y) and y.max() > 0 else -6.0))
    x = x.only(_select(x, y, least_z, most))
    m, d = len(x.feats), len(x.feats) + before.shape[1]
    w, bias = np.zeros(d), 0.0
    grad2, gb2 = np.full(d, 1e-3), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + x.dot(w[:m]) + before @ w[m:], -30, 30)))
        r = p - y
        g = np.r_[x.sums(r), before.T @ r] + ridge * w
        gb = r.sum()
        grad2 += g * g
        gb2 += gb * gb
        w -= 0.5 * g / np.sqrt(grad2)
        bias -= 0.5 * gb / np.sqrt(gb2)
    return Linear({int(f): float(v) for f, v in zip(x.feats, w[:m])}, w[m:], float(bias))


@dataclass
class Chain:
    """The fitted chain; its size is bounded by the features that each model may keep."""

    categories: list[str]
    models: list[Linear]
    thresholds: list[float]
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def probabilities(self, text: str) -> list[float]:
        """The probability of each category, in order, from the whole text."""
        used, known, own = self._used(), self.known, set()
        for w in set(words(text)):
            got = known.get(w)
            if got is None:
                if len(known) > 500_000:
                    known.clear()
                got = known[w] = tuple(f for f in word_features(w) if f in used)
            own.update(got)
        out: list[float] = []
        for m in self.models:
            out.append(float(1 / (1 + np.exp(-np.clip(m.margin(own, out), -30, 30)))))
        return out

    def _used(self) -> set[int]:
        if not hasattr(self, "_all"):
            self._all = {f for m in self.models for f in m.weights}
        return self._all


def fit_chain(rows: Iterable[np.ndarray], labels: np.ndarray, categories: list[str], fold: np.ndarray, least_z: float = 3.0, most: int = 8192) -> Chain:
    """Fit the models in order; rows: the features of each; fold has the fold of each row."""
    x = Present.of(rows)
    before = np.zeros((len(x), 0))
    models, thresholds = [], []
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        out = np.zeros(len(x))
        for f in np.unique(fold):
            test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            m = _fit(x.take(train), before[train], y[train], least_z, most)
            out[test] = m.margins(x.take(test), before[test])
        p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        models.append(_fit(x, before, y, least_z, most))
        thresholds.append(_threshold(p, y))
        before = np.c_[before, p]
    return Chain(categories, models, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut between two out-of-fold probabilities with the best F1; the widest gap wins ties."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    q = np.r_[p[order], 0.0]
    gap = q[:-1] - q[1:]
    best = max(range(len(y)), key=lambda k: (round(float(f1[k]), 9), gap[k]))
    return float((q[best] + q[best + 1]) / 2)


def _telling(each: DataFrame, names: list[str], folds: int, least_z: float, most: int) -> DataFrame:
    """(feature): at most `most` of a category, with the largest z, from `least_z`, in some training.

    A training has all rows, or all but one fold. each: (fold, 0/1 of each category, features). Counts of a training are those of all rows
    less those of its fold, so one aggregation serves all of them.
    """
    sizes = each.groupBy("fold").agg(F.count("*").alias("rows"), *[F.sum(k).alias(f"y_{k}") for k in names]).collect()  # a row for each fold
    has = each.select("fold", *names, F.explode("features").alias("feature")).groupBy("feature", "fold").agg(F.count("*").alias("rows"), *[F.sum(k).alias(f"y_{k}") for k in names])
    wide = has.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}_{f}") for f in range(folds) for c in ("rows", *(f"y_{k}" for k in names))])
    total = lambda c, f: reduce(Column.__add__, [F.col(f"{c}_{g}") for g in range(folds) if g != f])
    whole = lambda c, f: sum(r[c] for r in sizes if r["fold"] != f)
    g = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    chosen = []
    wide = cut(wide)
    for k in names:
        found = []
        for f in range(-1, folds):
            a, n1 = total(f"y_{k}", f).cast("double"), float(whole(f"y_{k}", f))
            n, b = float(whole("rows", f)), total("rows", f) - a
            cells = g(a) + g(b) + g(n1 - a) + g(n - n1 - b) - g(a + b) - g(n - a - b) - g(F.lit(n1)) - g(F.lit(n - n1)) + g(F.lit(n))
            found.append(F.sqrt(F.greatest(F.lit(0.0), 2 * cells)))
        told = wide.select("feature", F.greatest(*found, F.lit(0.0)).alias("z")).filter(F.col("z") >= least_z - 1e-6)
        chosen.append(told.orderBy(F.desc("z"), "feature").limit(most).select("feature"))
    return reduce(DataFrame.union, chosen).distinct()


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000, folds: int = 5, least_z: float = 3.0, most: int = 8192) -> Chain:
    """Fit a chain on a bounded sample of labelled documents.

    categories: name to a 0/1 column of `labels`, in chain order (null counts as 0). The
    sample has at most `per_class` labels for each category, and twice as many of rows without
    any, the first in the order of a hash of the id. Labels of unknown documents are ignored; of
    several labels of a document the largest count. Which features tell anything is found by
    Spark, at most `most` of each category; the chain is fitted on those of the sampled texts
    in one task, and the driver gets its weights only. Texts are read whole, however long; a null
    text has no features; rows without an id teach nothing; without labels every probability is
    near 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = list(categories)
    flags = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(k) for k, c in categories.items()])
    parts = [flags.filter(F.col(k) == 1) for k in names] + [flags.filter(" and ".join(f"`{k}` = 0" for k in names))]
    sample = reduce(DataFrame.union, [drawn(p, "__id", per_class * (1 + (p is parts[-1])), "toxicity") for p in parts])
    sample = cut(sample.groupBy("__id").agg(*[F.max(k).alias(k) for k in names]))
    kind = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(features=[features(t) for t in pdf["text"]])

    # the sample has a fixed number of ids at most
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "__id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(folds)).cast("int"))
    each = rows.select("__id", "fold", *names, "text").mapInPandas(extract, f"`__id` {kind}, fold int, " + ", ".join(f"`{k}` int" for k in names) + ", features array<int>")
    each = cut(each.groupBy("__id").agg(*[F.max(c).alias(c) for c in ("fold", *names, "features")]))
    if each.isEmpty():
        return Chain(names, [_fit(Present.of([]), np.zeros((0, j)), np.zeros(0)) for j in range(len(names))], [0.5] * len(names))
    telling = cut(_telling(each, names, folds, least_z, most))
    met = each.select("__id", F.explode("features").alias("feature")).join(F.broadcast(telling), "feature").groupBy("__id").agg(F.array_sort(F.collect_list("feature")).alias("features"))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches), ignore_index=True).sort_values("__id", kind="stable")
        none = np.zeros(0, np.int32)
        rows = (none if f is None else np.asarray(f, np.int32) for f in got["features"])
        yield pd.DataFrame({"chain": [pickle.dumps(fit_chain(rows, got[names].to_numpy(), names, got["fold"].to_numpy(), least_z, most))]})

    # one task: the sample has a fixed size, and a task's worker has more room than the driver
    sample = each.drop("features").join(met, "__id", "left").repartition(1)
    return pickle.loads(sample.mapInPandas(train, "chain binary").first()["chain"])


def scorer(spark, chain: Chain):
    """A column function: the probabilities of the categories, in order, of a text column."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.probabilities(t) for t in texts])

    return lambda col: score.asNondeterministic()(text_of(col))


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., <category>...) of every row: probabilities and decisions.

    A null, empty or wordless text gets the probabilities of a text without features; texts are
    read whole, however long; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    found = docs.select(F.col(id_col).alias("id"), scorer(docs.sparkSession, chain)(text_col).alias("p"))
    out = [F.round(F.col("p")[j], 6).alias(f"p_{k}") for j, k in enumerate(chain.categories)]
    told = [(F.col("p")[j] >= F.lit(t)).alias(k) for j, (k, t) in enumerate(zip(chain.categories, chain.thresholds))]
    return found.select("id", *out, *told)


def without(docs: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the chain finds in a category.

    A null, empty or wordless text is judged as a text without features; texts are read whole,
    however long; repeated rows go or stay together; an empty table gives an empty result; all columns
    stay, whatever their names.
    """
    j = chain.categories.index(category)
    scored = docs.select(whole_row(docs), scorer(docs.sparkSession, chain)(text_col).alias("p"))
    return scored.filter(F.col("p")[j] < chain.thresholds[j]).select(*columns_of_row(docs))
