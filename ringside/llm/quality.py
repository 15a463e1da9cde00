"""Quality rules, and a log-likelihood ratio of hashed n-grams.

Every text gets plain figures (words, symbols, repeated lines and windows). The verdict on
texts that pass the base rules is the log-likelihood ratio of their hashed 1- and 2-grams
between two multinomials, divided by their number: one of trusted texts (all labels), one of the raw corpus (all documents). A text is kept if it reaches the
threshold, which is set once on labelled texts; the same text always gets the same verdict.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_of

SYMBOLS = b"#*$%&|<>"
#: Most labels that are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 5_000_000
#: The width of a range of scores.
SCORE_STEP = 1e-3


class _Words(dict):
    """Numbers the words it meets, and keeps their hash and length."""

    def __init__(self):
        super().__init__()
        self.hashes, self.chars = [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(zlib.crc32(word))
        self.chars.append(len(word.decode("utf-8", "surrogatepass")))
        return n


class Reader:
    """Turns whole texts into figures and n-grams; words are remembered up to a bound."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.words = keep, _Words()
        self.hash, self.char = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def ids(self, raw: bytes) -> np.ndarray:
        """The words of a text as numbers; the same number for the same word in this text."""
        if len(self.words) > self.keep:
            self.words, self.hash, self.char = _Words(), self.hash[:0], self.char[:0]
        found = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
        out = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        if len(self.words) > len(self.hash):
            n = len(self.hash)
            self.hash = np.r_[self.hash, np.array(self.words.hashes[n:], np.uint32)]
            self.char = np.r_[self.char, np.array(self.words.chars[n:], np.int64)]
        return out

    def ngrams(self, ids: np.ndarray, bits: int) -> np.ndarray:
        """Buckets of the 1- and 2-grams."""
        h = self.hash[ids]
        two = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
        h = np.concatenate((h * np.uint32(0xC2B2AE3D), two))
        return (h ^ (h >> np.uint32(15))) >> np.uint32(32 - bits)

    def figures(self, raw: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
        """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
        seen, dup = set(), 0
        for line in raw.split(b"\n"):
            if line and not line.isspace():
                dup += line in seen
                seen.add(line)
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        return len(ids), int(self.char[ids].sum()), symbols, dup, repeated(ids)


def repeated(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = int(ids.max()) + 1
    key = ids[:-1] * top + ids[1:]
    if top >= 1 << 21:  # three numbers don't fit into 63 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key[:-1] * top + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hot = np.zeros(n + 1, bool)
    hot[:n][order[1:]] |= same
    hot[:n][order[:-1]] |= same
    cover = np.zeros(n + 2, bool)
    for k in range(3):
        cover[k : k + n] |= hot[:n]
    return int(cover.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """Too short, or more than half of it in repeated windows."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Ratio:
    """Log ratio of each bucket, and the threshold on a text's mean; of a fixed size."""

    bits: int
    log_ratio: np.ndarray
    threshold: float

    def score(self, reader: Reader, ids: np.ndarray) -> float:
        if not len(ids):
            return 0.0
        return round(float(self.log_ratio[reader.ngrams(ids, self.bits)].mean(dtype=np.float64)), 6)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def corpus_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw, trusted) counts of every bucket, over all documents and over those in `trusted`.

    One pass: each task adds up its own 2 x 2^bits counters, Spark adds those of all tasks,
    and the driver gets 2^bits rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return _counts(_labelled(rows, trusted.select("id", F.lit(1).alias("good"))).select("text", F.col("good").isNotNull().alias("good")), bits)


def _labelled(rows: DataFrame, told: DataFrame) -> DataFrame:
    """`rows` with the columns of `told` (one row an id), null where it lacks the id; told is broadcast unless it is large."""
    return rows.join(F.broadcast(told) if told.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else told, "id", "left")


def _counts(each: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of corpus_counts() over (text, good)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total = Reader(), np.zeros((2, 1 << bits), np.int64)
        for pdf in batches:  # a batch is bounded by bytes; counters are filled once for each
            found = [reader.ngrams(reader.ids(_bytes(text)), bits) for text in pdf["text"]]
            for k, some in enumerate((found, [x for x, good in zip(found, pdf["good"]) if good])):
                if some:
                    total[k] += np.bincount(np.concatenate(some), minlength=1 << bits)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at.astype(np.int32), "raw": total[0][at], "good": total[1][at]})

    got = each.mapInPandas(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[got["bucket"]], good[got["bucket"]] = got["raw"], got["good"]
    return raw, good


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, lose: float = 0.002) -> Ratio:
    """Fit the multinomials and the threshold, on all labels.

    The trusted texts are all that are labelled 1. Four fifths of them are counted; the threshold is set on the
    other fifth and on all texts labelled 0. The raw counts cover all documents. The threshold is the best
    cut between trusted and other texts that loses at most `lose` of the trusted; without texts labelled 0
    it is that quantile itself; without trusted texts, everything that passes the base rules is kept. Null
    ids and labels of unknown documents teach nothing; documents with one id share its label; a document
    labelled both 1 and 0 counts as trusted. The driver gets 2^bits counts, and scores by ranges (_cut).
    """
    bounded_batches(docs.sparkSession)
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    fifth = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("threshold")), F.lit(5)) == 0
    chosen = cut(ids.withColumn("fifth", fifth))
    raw, good = corpus_counts(docs, chosen.filter("label = 1 and not fifth"), id_col, text_col, bits)
    if not good.sum():
        raw, good = corpus_counts(docs, chosen.filter("label = 1"), id_col, text_col, bits)  # too few to part
    if not good.sum():
        return Ratio(bits, np.zeros(1 << bits), -np.inf)
    ratio = np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    model = Ratio(bits, ratio.astype(np.float32), -np.inf)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    told = _labelled(rows, chosen.filter("label = 0 or fifth").select("id", "label")).filter("label is not null")
    scores = assess(told, model, "label", "text").filter(~F.col("base_failed"))
    model.threshold = _cut(cut(scores.groupBy("score").agg(F.count_if(F.col("id") == 1).alias("good"), F.count_if(F.col("id") == 0).alias("bad"))), lose)
    return model


def _cut(scores: DataFrame, lose: float) -> float:
    """The threshold between the scores of trusted and other texts; scores: (score, good, bad), a row for each score.

    No cut lies above the quantile of the trusted that may be lost. The driver gets counts by ranges of
    SCORE_STEP, then the scores of those ranges that can hold the best cut: a range's best gain is at most
    that of all its bad and none of its good texts. Scores have 6 digits, so both are bounded.
    """
    n_good, n_bad = (x or 0 for x in scores.agg(F.sum("good"), F.sum("bad")).first())
    if not n_good:
        return -np.inf
    own = F.floor(F.col("score") / SCORE_STEP)
    ranges = scores.groupBy(own.alias("range")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("range").toPandas()
    # the trusted text at the quantile, in the order of scores
    place = int(lose * n_good)
    at = int(np.searchsorted(ranges["good"].cumsum().to_numpy(), place, "right"))
    inner = scores.filter((own == int(ranges["range"][at])) & (F.col("good") > 0)).orderBy("score").select("score", "good").toPandas()
    top = float(inner["score"][int(np.searchsorted(inner["good"].cumsum().to_numpy() + ranges["good"][:at].sum(), place, "right"))])
    if not n_bad:
        return top
    # gain of a cut: the share of bad texts below it, less that of good ones
    below = ranges[: at + 1]
    before_bad, before_good = below["bad"].cumsum().to_numpy() - below["bad"].to_numpy(), below["good"].cumsum().to_numpy() - below["good"].to_numpy()
    most = (before_bad + below["bad"].to_numpy()) / n_bad - before_good / n_good
    least = (before_bad / n_bad - before_good / n_good).max()
    open_ = [int(r) for r, m in zip(below["range"], most) if m >= least - 1e-12]
    found = scores.filter(own.isin(open_) & (F.col("score") <= top)).orderBy("score").toPandas()
    start = {int(r): (b, g) for r, b, g in zip(below["range"], before_bad, before_good)}
    best = None
    for r, rows in found.groupby(np.floor(found["score"].to_numpy() / SCORE_STEP).astype(np.int64)):
        b, g = start[int(r)]
        gain = (b + rows["bad"].cumsum() - rows["bad"]) / n_bad - (g + rows["good"].cumsum() - rows["good"]) / n_good
        for score, x in zip(rows["score"], gain):
            if best is None or x >= best[0]:
                best = (x, float(score))
    last = scores.filter(F.col("score") < best[1]).agg(F.max("score")).first()[0]
    return best[1] if last is None else (best[1] + last) / 2


def assess(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    Of every row, from its whole text; a null text counts as empty, which fails the base rules
    (it has under 50 words); texts are read whole, however long. Repeated rows give repeated rows; an empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader, own = Reader(), shared.value
        for texts in batches:
            rows = []
            for t in texts:
                raw = _bytes(t)
                ids = reader.ids(raw)
                got = reader.figures(raw, ids)
                failed, score = base_failed(got[0], got[4]), own.score(reader, ids)
                rows.append((*got, failed, score, not failed and score >= own.threshold))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return docs.select(F.col(id_col).alias("id"), judge.asNondeterministic()(text_of(text_col)).alias("q")).select("id", "q.*")
