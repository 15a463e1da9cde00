"""Connected components of a graph, by large and small stars in turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut


MOST_IDS = 500_000  # ids that a task holds at once


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the edges of a task, those that connect something new; every id is in one of them."""
    up: dict = {}

    def find(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    for pdf in batches:
        if len(up) > MOST_IDS:  # begins anew, which keeps some edges more
            up.clear()
        out = []
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            new = u not in up or v not in up
            p, q = find(up.setdefault(u, u)), find(up.setdefault(v, v))
            if p != q:
                up[p] = q
            if new or p != q:
                out.append((u, v))
        yield pd.DataFrame(out, columns=["u", "v"])


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every id of an edge; component: the least id that is connected with it.

    Each round links all larger neighbours of an id to its least neighbour, then all
    smaller ones, until nothing changes; the number of rounds grows as the logarithm of the number of
    ids. Rows with a null end are left out; an edge from an id to itself connects nothing. Each round is
    written to the checkpoint folder. First, as many tasks as there are cores keep a spanning forest of
    their edges each, so rounds go over ids rather than edges.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    kind = T.StructType([T.StructField(c, ends.schema[c].dataType) for c in ("u", "v")])
    ends = cut(ends.coalesce(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(_forest, kind).distinct())
    links, settled = ends.filter("u > v"), False
    while not settled:
        # large star: of all neighbours, the larger ones move to the least
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours, and the id itself, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = cut(moved.filter("u > v").distinct())
        settled = new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty()
        links = new
    ids = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(links.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
