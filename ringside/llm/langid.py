"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector holds its letter n-grams (1 to 3, hashed to `dims` places) with sublinear
term frequency times inverse document frequency, scaled to length 1. Each language has
several centroids, clustered by spherical k-means on a bounded sample of labelled texts; the
document frequencies are those of all labelled texts. The nearest by cosine gives the language. A text farther from it than the cluster's own
texts reach is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_of
from .letters import folded

UNKNOWN = "und"
#: Most languages that a model may have; what is broadcast is bounded by it.
MOST_LANGUAGES = 500


def ngram_counts(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the hashed n-grams of the whole text; empty without letters."""
    letters = folded(text)
    total = np.zeros(dims, np.int64)
    for at in range(0, len(letters), 1 << 18):  # bounded memory for very long texts
        a = letters[at : at + (1 << 18) + 2]
        own = min(len(a), 1 << 18)
        for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
            if len(a) < n:
                continue
            h = np.full(len(a) - n + 1, salt, np.uint32)
            for k in range(n):
                h = (h ^ a[k : len(a) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            total += np.bincount(h[:own] & np.uint32(dims - 1), minlength=dims)
    places = np.flatnonzero(total)
    return places.astype(np.int32), total[places].astype(np.float64)


@dataclass
class Centroids:
    """A fitted model: its size depends on the number of languages and parameters only."""

    dims: int
    idf: np.ndarray
    centroids: np.ndarray  # dims x centroids
    languages: list[str]  # of each centroid
    reach: np.ndarray  # largest distance that each accepts

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[places]
        return v / (np.sqrt((v * v).sum()) or 1.0)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, cosine between 0 and 1, rejected); UNKNOWN if there is no letter."""
        places, counts = ngram_counts(text, self.dims)
        if not len(places) or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.vector(places, counts) @ self.centroids[places]
        best = int(near.argmax())
        cosine = min(1.0, max(0.0, float(near[best])))
        return self.languages[best], round(cosine, 6), 1 - cosine > self.reach[best]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centroids, cosine of each row to its own); starts far apart."""
    first = x.mean(axis=0)
    seeds = [int((x @ first).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c, x @ c.T


def document_counts(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """(texts with a letter, how many of them have each place) over all rows of (text).

    A task adds up its texts, and the driver gets dims + 1 rows.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims + 1, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                places = ngram_counts(t, dims)[0]
                total[places] += 1
                total[dims] += len(places) > 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": at, "n": total[at]})

    out = np.zeros(dims + 1)
    for r in rows.select("text").mapInPandas(counts, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return int(out[dims]), out[:dims]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = 400, clusters: int = 4, dims: int = 1 << 13) -> Centroids:
    """Fit on a sample of `per_language` labelled texts of each language.

    The sample is the first rows in the order of a hash of key_col and the text, so reruns
    agree, whatever keys are null or repeated. Each language is clustered in a task of its own; the driver
    gets the centroids, and counts of the places of all labelled texts. There are at most
    MOST_LANGUAGES languages. Rows without a language, a text or a letter teach nothing;
    repeated rows count each; without any row left, every text is UNKNOWN.
    """
    bounded_batches(labelled.sparkSession)
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    rows = labelled.select(F.xxhash64(key, F.col(text_col), F.lit("langid")).alias("hash"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    bucket = F.shiftrightunsigned("hash", 50)  # 2^14 of them
    line = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0)))
    # the buckets of each language that hold its first rows
    last = {r["lang"]: r["bucket"] for r in sizes.filter(F.col("before") < per_language).groupBy("lang").agg(F.max("bucket").alias("bucket")).limit(MOST_LANGUAGES + 1).collect()}
    if len(last) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not last:
        return Centroids(dims, np.ones(dims), np.zeros((dims, 0)), [], np.zeros(0))
    first = bucket <= F.element_at(F.create_map(*[F.lit(x) for pair in last.items() for x in pair]), F.col("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(bucket, "hash"))
    # each task sorts its own share of those buckets, and hands on no more than the sample
    sample = cut(rows.filter(first).withColumn("place", place).filter(F.col("place") <= per_language).drop("place"))
    n, df = document_counts(rows, dims)
    model = Centroids(dims, np.log((1 + n) / (1 + df)) + 1, np.zeros((dims, 0)), [], np.zeros(0))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["hash", "text"], kind="stable")["text"]
        vectors = [v for v in (ngram_counts(t, dims) for t in texts) if len(v[0])]
        x = np.zeros((len(vectors), dims))
        for row, (p, c) in zip(x, vectors):
            row[p] = model.vector(p, c)
        if not len(x):
            return pd.DataFrame({"lang": [], "number": [], "reach": [], "centre": []})
        centres, near = _cluster(x, clusters)
        best = near.argmax(axis=1)
        own = [j for j in range(len(centres)) if (best == j).any()]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "number": own, "reach": [float((1 - near[best == j, j]).max()) + 0.1 for j in own], "centre": [centres[j] for j in own]})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, number int, reach double, centre array<double>").toPandas().sort_values(["lang", "number"])
    model.languages, model.reach = [str(x) for x in found["lang"]], found["reach"].to_numpy(float)
    model.centroids = np.array(found["centre"].tolist(), float).reshape(-1, dims).T.copy()
    return model


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row, from its whole text alone.

    lang_pred is the nearest learned language, or UNKNOWN if the text is null or has no
    letter; score is the cosine (0 for UNKNOWN); rejected says that the text is too far from
    all centroids, or UNKNOWN. Texts are read whole, however long. Ties go to the first language in order. Repeated rows give
    repeated rows, an empty table an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    found = docs.select(F.col(id_col).alias("id"), predict.asNondeterministic()(text_of(text_col)).alias("p"))
    return found.select("id", "p.lang_pred", "p.score", "p.rejected")
