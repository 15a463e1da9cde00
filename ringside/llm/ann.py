"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own centroids (k-means
on a bounded sample); a pair of centroids is a cell. Every row is in the cell of its two
nearest centroids. A query ranks the centroids of each half by inner product and walks
centroid pairs by their summed score with a heap, best first, until the cells that it has met
hold a share of all entries. The entries of those cells are reranked by the exact inner
product in double precision. The share is measured when the index is fitted: it is what the
walk needs on the sample, against brute force, for the recall that is asked for. How many
centroids there are follows from the number of rows: more of them make the share smaller and
the walk longer, and the fit takes the number at which both together cost least.

The walk needs only the centroids and the number of entries of each cell: both are bounded by
the number of centroids. As cells are met in the order of their score, the score of the
last one says which cells a query has met. The lists of the left centroids are packed into
blocks of entries (a long list takes several), and a query goes, with that score, to the
blocks that it can reach. Queries are dealt in blocks too, so no list has to fit into a task;
within a pair of blocks, entries lie in the order of their cells, and only stretches with a
cell that a query has met are scored for it. Every (query, block) hands on its `k` best only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drawn
from .simhash import whole_groups

#: Rows of the training sample that the driver may hold, and floats, whichever is less.
SAMPLE_ROWS, SAMPLE_FLOATS = 16_384, 4_000_000
#: Floats of a block of entries, queries of a block, entries that are scored at once, queries at once.
BLOCK_FLOATS, ASKS, STRETCH, TURN = 1 << 19, 2048, 64, 256
STEP_COST = 2.0  # what a step of the walk counts as, in scored entries (low: a small share is worth a long walk)
#: Most lengths of vectors in a table.
MOST_LENGTHS = 16


@dataclass
class Index:
    """Centroids of both halves, and the share of the entries to walk; of a bounded size."""

    left: np.ndarray
    right: np.ndarray
    share: float = 1.0

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of every row of a matrix."""
        h = self.left.shape[1]
        return _nearest(x[:, :h], self.left), _nearest(x[:, h:], self.right)

    def walk(self, q: np.ndarray, entries: np.ndarray, effort: int) -> tuple[float, list[int]]:
        """The summed score down to which cells are met, and the left centroids that reach it.

        entries: the number of each cell's entries; the walk ends when the cells met hold
        `effort` of them.
        """
        h = self.left.shape[1]
        a, b = self.left @ q[:h], self.right @ q[h:]
        i, j = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        sa, sb, i, j = a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist()
        heap, reached, got, last = [(-(sa[0] + sb[0]), 0, 0)], [0] * len(sa), 0, 0.0
        while heap and got < effort:
            score, x, y = heapq.heappop(heap)
            last = -score
            got += int(entries[i[x], j[y]])
            reached[x] = y + 1
            # a pair is pushed once its two neighbours with better scores have been met
            if x + 1 < len(sa) and reached[x + 1] == y:
                heapq.heappush(heap, (-(sa[x + 1] + sb[y]), x + 1, y))
            if y + 1 < len(sb) and (x == 0 or reached[x - 1] > y + 1):
                heapq.heappush(heap, (-(sa[x] + sb[y + 1]), x, y + 1))
        floor = last - 1e-9
        return floor, np.flatnonzero(a + b.max() >= floor).tolist()


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    own = (c * c).sum(axis=1)[None, :]
    parts = [(own - 2 * (x[at : at + 4096] @ c.T)).argmin(axis=1) for at in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(own, weights=x[:, d], minlength=len(c))
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return np.unique(c, axis=0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): the rows that take part.

    Left out: null ids, null and zero vectors, and vectors with null or non-finite components.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _share(index: Index, x: np.ndarray, k: int, recall: float) -> float:
    """The share of the entries x that walks have to meet to find `recall` of the k nearest; all for a recall of 1."""
    if recall >= 1:
        return 1.0
    h = index.left.shape[1]
    left, right = index.places(x)
    needs = []
    for n, q in enumerate(x[:200]):
        exact, met = x @ q, (index.left @ q[:h])[left] + (index.right @ q[h:])[right]
        exact[n] = -np.inf
        nearest = np.argpartition(-exact, k)[:k]
        needs.extend((met[:, None] >= met[nearest][None, :]).sum(axis=0))
    return float(min(1.0, np.quantile(needs, recall) / len(x)))


def fit(rows: DataFrame, dims: int, n: int, centroids: int | None = None, k: int = 20, recall: float = 0.94) -> Index:
    """Centroids, and the share of the entries that finds `recall` of the k nearest of n rows.

    The sample is the first rows in the order of a hash of the id, up to SAMPLE_ROWS rows and
    SAMPLE_FLOATS floats; 200 of them are the queries of the measurement. Without a number of
    centroids, it is doubled from 16 for as long as that lowers the estimated cost of a query,
    share * (n + STEP_COST * centroids^2), with 16 rows of the sample a centroid at least.
    """
    size = max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // max(1, dims)))
    sample = drawn(rows, "id", size, "ann").select("v").toPandas()
    x = np.array(sample["v"].tolist(), float).reshape(len(sample), dims)
    h = dims // 2
    best, least = None, np.inf
    each = centroids or 16
    while True:
        index = Index(_kmeans(x[:, :h], each), _kmeans(x[:, h:], each))
        if len(x) > k + 1:
            index.share = _share(index, x, k, recall)
        cost = index.share * (n + STEP_COST * each * each)
        if cost >= least:
            return best
        best, least, each = index, cost, 2 * each
        if centroids or len(x) < 16 * each:
            return best


def _best(index, k: int):
    """mapInPandas over rows sorted by pair of blocks: each query's k best entries of its block."""
    keys = ["block", "turn"]

    def score(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ask, told = rows[rows["ask"]], rows[~rows["ask"]]
        if not len(ask) or not len(told):
            return
        own = index.value
        h = own.left.shape[1]
        told = told.sort_values(["left", "right", "id"], kind="stable")
        ids, x = told["id"].to_numpy(np.int64), np.stack(told["v"].to_numpy())
        cell = told[["left", "right"]].to_numpy(np.int64)
        opens = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        of = np.repeat(np.arange(len(opens)), np.diff(np.r_[opens, len(cell)]))
        for at in range(0, len(ask), TURN):
            part = ask.iloc[at : at + TURN]
            who, q, floor = part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()), part["floor"].to_numpy()
            met = (q[:, :h] @ own.left.T)[:, cell[opens, 0]] + (q[:, h:] @ own.right.T)[:, cell[opens, 1]] >= floor[:, None]
            s = np.full((len(part), len(ids)), -np.inf)
            for a in range(0, len(ids), STRETCH):
                b = min(a + STRETCH, len(ids))
                some = np.flatnonzero(met[:, of[a] : of[b - 1] + 1].any(axis=1))
                if len(some):
                    # einsum adds each pair in the same order, so equal vectors get equal scores
                    here = np.einsum("qd,vd->qv", q[some], x[a:b])
                    s[some, a:b] = np.where(met[some][:, of[a:b]] & (who[some][:, None] != ids[None, a:b]), here, -np.inf)
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            order = np.lexsort((ids[col], -s[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, row)
            top = np.arange(len(row)) - first < k
            row, col = row[top], col[top]
            yield pd.DataFrame({"query_id": who[row], "vec_id": ids[col], "score": s[row, col]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, keys, 4096):
            for _, group in rows.groupby(keys, sort=False):
                yield from score(group)

    return run


def _blocks(lists: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """(first block, number of blocks) of each left list, from their numbers of entries.

    Lists of up to `size` entries share blocks of up to that size; longer ones have their own.
    """
    first, many, block, held = [], [], -1, size + 1
    for n in lists.tolist():
        parts = max(1, math.ceil(n / size))
        if parts > 1 or held + n > size:
            block += 1
            held = 0
        first.append(block)
        many.append(parts)
        held += n
        if parts > 1:
            block += parts - 1
            held = size + 1
    return first, many


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int | None = None, recall: float = 0.94, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first.

    queries: (id_col, vector_col), with ids of their own or of `vectors`; a candidate is every
    row of `vectors` with another id. Ties go to the smaller id. recall is the share of true
    neighbours that the index is fitted for (see fit), 1 being exact; all entries of the cells that a
    walk meets are scored. Rows without a usable vector (see usable) take no part. Vectors are
    compared with those of their own length; a table has MOST_LENGTHS of them at most, or the job
    fails. A repeated query is answered once; repeated entries are candidates each; an empty
    table gives an empty result; other columns are ignored. Ids are integers.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=4096)
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).limit(MOST_LENGTHS + 1).collect()}
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_found(rows.filter(F.size("v") == d), asked.filter(F.size("v") == d), d, n, k, centroids, recall) for d, n in sorted(lengths.items())]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, asked: DataFrame, dims: int, n: int, k: int, centroids: int | None, recall: float) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query and block; all vectors have one length."""
    spark = rows.sparkSession
    index = spark.sparkContext.broadcast(fit(rows, dims, n, centroids, k, recall))

    @F.pandas_udf("left int, right int")
    def place(v: pd.Series) -> pd.DataFrame:
        left, right = index.value.places(np.stack(v.to_numpy())) if len(v) else ([], [])
        return pd.DataFrame({"left": left, "right": right})

    placed = cut(rows.select("id", "v", place.asNondeterministic()("v").alias("p")).select("id", "v", "p.left", "p.right"))
    table = np.zeros((len(index.value.left), len(index.value.right)), np.int64)
    for r in placed.groupBy("left", "right").agg(F.count("*").alias("n")).collect():  # at most centroids^2
        table[r["left"], r["right"]] = r["n"]
    entries, effort = spark.sparkContext.broadcast(table), math.ceil(index.value.share * n)
    first, many = _blocks(table.sum(axis=1), max(256, BLOCK_FLOATS // max(1, dims)))

    @F.pandas_udf("floor double, lists array<int>")
    def walk(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.value.walk(np.asarray(q), entries.value, effort) for q in v], columns=["floor", "lists"])

    at = lambda values, k: F.element_at(F.lit(values), F.col(k) + 1)
    # a fixed number of partitions: the planner would put the few bytes of all queries into one task
    dealt = asked.dropDuplicates(["id", "v"]).repartition(2 * spark.sparkContext.defaultParallelism, "id")
    reached = dealt.select("id", "v", walk.asNondeterministic()("v").alias("w")).select("id", "v", "w.floor", "w.lists")
    blocks = F.array_distinct(F.flatten(F.transform("lists", lambda x: F.sequence(F.element_at(F.lit(first), x + 1), F.element_at(F.lit(first), x + 1) + F.element_at(F.lit(many), x + 1) - 1))))
    goes = cut(reached.select("id", "v", "floor", F.explode(blocks).alias("block")))
    turns = goes.groupBy("block").agg(F.ceil(F.count("*") / ASKS).alias("turns"))
    told = placed.withColumn("block", (at(first, "left") + F.pmod(F.xxhash64("id"), at(many, "left"))).cast("int")).join(turns, "block")
    told = told.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("ask"), "id", "v", "left", "right", F.lit(None).cast("double").alias("floor"))
    asking = goes.join(turns, "block").select("block", F.pmod(F.xxhash64("id"), "turns").alias("turn"), F.lit(True).alias("ask"), "id", "v", F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"), "floor")
    met = told.union(asking).repartition("block", "turn").sortWithinPartitions("block", "turn")
    return met.mapInPandas(_best(index, k), "query_id long, vec_id long, score double")
