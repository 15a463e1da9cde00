"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints: 64 bits over the 3-word shingles of the text, a bit being 1 if it is set in
more than half of the shingles' XXH64 values. Two documents are linked if their
fingerprints differ in at most `radius` bits; a group is a connected component.

Plan: equal fingerprints are merged first, so copies never meet in a comparison. By the
pigeonhole principle, two fingerprints within `radius` agree on at least `blocks - radius`
of `blocks` bit blocks, so every distinct fingerprint is sent to one bucket for each choice
of that many blocks. Buckets with one member end there; large ones are cut into chunks, and
each pair of chunks is a comparison of its own, so no bucket has to fit into a task. A
comparison stores its fingerprints as bit planes (plane k holds bit k of 64 fingerprints in
a word), adds the planes that differ with carry-save counters, 64 distances at a time, and
abandons a word once all its distances exceed the radius; there are as many counters as the
radius has binary digits, and a fingerprint may be several words wide (see near_copies). Each
comparison returns a spanning forest of its links, never all pairs. The forests are contracted to components by repeated
minimum-neighbour hooking with pointer jumping on the distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, columns_of_row, cut, text_of, whole_row

BITS = 64
SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """The fingerprint of a text as an unsigned 64-bit integer; 0 for a text without words.

    Fewer than `width` words: the whole sequence is the one shingle. Only A-Z are lowered.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = (ends - lengths)[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        counts += bit_counts(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])], np.uint64))
    return majority(counts, n)


def bit_counts(digests: np.ndarray) -> np.ndarray:
    """How many of some 64-bit numbers have each bit set, the highest bit first."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), 1 << 15):
        part = digests[at : at + (1 << 15)].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The number whose bits are those that over half of n numbers have."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long.

    A null text counts as empty; texts are read whole, however long; null ids stay; repeated rows
    give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), _fingerprints(text_of(text_col)).alias("fp"))


def _masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius bit blocks, the mask of their bits (signed)."""
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    each = [sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [reduce(int.__or__, c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _beyond(counts: list[np.ndarray], radius: int, none: np.ndarray) -> np.ndarray:
    """The lanes whose binary counters (lowest digit first) exceed the radius."""
    more, same = none, ~none
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counts[k]
        else:
            more, same = more | (same & counts[k]), same & ~counts[k]
    return more


def bit_sliced_links(fp: np.ndarray, group: np.ndarray, asks: np.ndarray, told: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of the same group within `radius`, i among `asks`, j among `told`.

    fp: uint64, one or several words a row; group: non-decreasing; asks, told: boolean. Every
    word of a bit plane holds the same bit of up to 64 `told` rows of one group. All (row, word)
    combinations of a group are updated together; two planes enter the counters at a time by a
    full adder, and carries go up the counters' digits. What leaves the highest digit is beyond
    the radius for good.
    """
    fp = fp.reshape(len(fp), -1)
    none = np.zeros(0, np.int64)
    rows = np.flatnonzero(told)
    if not len(rows):
        return none, none
    g = group[rows]
    first = np.r_[True, g[1:] != g[:-1]]
    start = np.flatnonzero(first)
    lane = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    opens = np.flatnonzero(lane % 64 == 0)  # where a word begins
    word_group = g[opens]
    shift = (lane % 64).astype(np.uint64)
    one = np.uint64(1)
    bit_of = lambda at, k: (fp[at, k // BITS] >> np.uint64(k % BITS)) & one
    bits = BITS * fp.shape[1]
    planes = np.empty((bits, len(opens)), np.uint64)
    for k in range(bits):
        planes[k] = np.bitwise_or.reduceat(bit_of(rows, k) << shift, opens)
    fill = np.bitwise_or.reduceat(one << shift, opens)
    # every asking row meets every word of its group
    ask = np.flatnonzero(asks)
    lo, hi = np.searchsorted(word_group, group[ask], "left"), np.searchsorted(word_group, group[ask], "right")
    n = hi - lo
    who = np.repeat(ask, n)
    word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    zero = np.uint64(0)
    nil = np.zeros(len(who), np.uint64)
    counts, over = [nil.copy() for _ in range(radius.bit_length())], ~fill[word]
    for k in range(0, bits, 2):
        a = planes[k][word] ^ (zero - bit_of(who, k))
        b = planes[k + 1][word] ^ (zero - bit_of(who, k + 1))
        if not counts:
            over = over | a | b
        else:
            carry = (counts[0] & a) | (counts[0] & b) | (a & b)
            counts[0] ^= a ^ b
            for c in counts[1:]:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
        if k % 8 == 6 and k + 2 > radius:
            over |= _beyond(counts, radius, nil)
            keep = over != ~zero
            if not keep.all():  # abandoned words
                who, word, over, nil, counts = who[keep], word[keep], over[keep], nil[keep], [c[keep] for c in counts]
                if not len(who):
                    return none, none
    near = ~(over | _beyond(counts, radius, nil))
    hit = np.flatnonzero(near)
    lanes = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(lanes)
    i = who[hit][at]
    j = rows[opens[word[hit][at]] + bit]
    apart = i != j
    return i[apart], j[apart]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under the links (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        far = a != b
        if not far.any():
            return label
        i, j, a, b = i[far], j[far], a[far], b[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], room: int) -> Iterator[pd.DataFrame]:
    """Stretches of whole groups, of about `room` rows, from batches of rows sorted by `keys`."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < room:
            continue
        rows = pd.concat(held, ignore_index=True)
        key = rows[keys].to_numpy(np.int64)
        other = (key[::-1] != key[-1]).any(axis=1)
        whole = len(rows) - int(np.argmax(other)) if other.any() else 0
        if whole:
            yield rows.iloc[:whole]
        held, size = [rows.iloc[whole:]], len(rows) - whole
    if size:
        yield pd.concat(held, ignore_index=True)


def group_numbers(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0, 1, ... for the groups of rows sorted by `keys`."""
    key = pdf[keys].to_numpy(np.int64)
    return np.r_[0, np.cumsum((key[1:] != key[:-1]).any(axis=1))]


def _compare(radius: int, words: list[str]):
    """mapInPandas over rows sorted by comparison: the spanning forest of each one's links."""
    keys = ["c", "key", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, keys, 4096):
            v, side, one = pdf["v"].to_numpy(np.int64), pdf["side"].to_numpy(), (pdf["i"] == pdf["j"]).to_numpy()
            fp = np.ascontiguousarray(pdf[words].to_numpy(np.int64)).view(np.uint64)
            a, b = bit_sliced_links(fp, group_numbers(pdf, keys), one | (side == 0), one | (side == 1), radius)
            root = _roots(len(pdf), a, b)
            linked = np.flatnonzero(root != np.arange(len(pdf)))
            yield pd.DataFrame({"a": v[root[linked]], "b": v[linked]})

    return run


def compare(keyed: DataFrame, radius: int, chunk: int = 1024) -> DataFrame:
    """(a, b): links that connect all rows v that share a bucket (c, key) and are within `radius`.

    keyed: (c, key, v, and the words of v's fingerprint); also n, if the rows of each bucket are counted
    already. Buckets of one row end here; large ones are cut into chunks.
    """
    words = [c for c in keyed.columns if c not in ("c", "key", "v", "n")]
    if "n" in keyed.columns:
        several = keyed.filter("n > 1")
    else:
        several = keyed.join(keyed.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["c", "key"])
    dealt = several.withColumn("chunks", F.ceil(F.col("n") / chunk)).withColumn("own", F.pmod(F.xxhash64("v"), "chunks"))
    met = dealt.select("c", "key", "v", *words, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).select(
        F.col("c").cast("long").alias("c"),
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("long").alias("side"),
        "v",
        *words,
    )
    ordered = met.repartition("c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j", "side", "v")
    return ordered.mapInPandas(_compare(radius, words), "a long, b long").distinct()


def links(distinct: DataFrame, radius: int = 2, blocks: int = 5, chunk: int = 1024) -> DataFrame:
    """(a, b): links that connect all fingerprints within `radius`; `distinct` has fp once each.

    Complete: any two fingerprints within the radius are in one component of the result.
    """
    masks = _masks(blocks, radius)
    keyed = distinct.select(F.col("fp").alias("v"), "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    return compare(keyed, radius, chunk)


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): the same root in the same component.

    Each round hooks every vertex to its least neighbour, jumps pointers, and goes on with the
    contracted edges; the edges left go to none in about log(n) rounds. All tables are cut
    with a reliable checkpoint, so a lost executor costs one round at most.
    """
    edges = cut(edges.filter("a <> b"))
    both = edges.union(edges.select("b", "a"))
    place = cut(both.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = cut(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("up")))
        for _ in range(jumps):
            further = up.select(F.col("v").alias("up"), F.col("up").alias("top"))
            up = up.join(further, "up").select("v", F.col("top").alias("up"))
        up = cut(up)
        place = cut(place.join(up.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("up", "root").alias("root")))
        ends = edges.join(up.select(F.col("v").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("v").alias("b"), F.col("up").alias("y")), "b")
        edges = cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return place


def _groups(docs: DataFrame, id_col: str, text_col: str, radius: int, blocks: int, chunk: int) -> DataFrame:
    """(id, text_hash, fp, first): first is (id is null, id, text_hash) of the group's first row."""
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    prints = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), _fingerprints(text).alias("fp")))
    least = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("least")))
    place = components(links(least.select("fp"), radius, blocks, chunk))
    placed = least.join(place.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("least").alias("first"))
    by_print = cut(placed.join(heads, "root").select("fp", "first"))
    return prints.join(by_print, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, blocks: int = 5, chunk: int = 1024) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links, itself included. A null or empty
    text has fingerprint 0 and is linked like any other; texts are read whole, however long;
    repeated rows give repeated rows; an empty table gives an empty result; other columns are
    ignored, whatever their names. A null id takes part, but a component has a null id only if
    all its ids are null.
    """
    return _groups(docs, id_col, text_col, radius, blocks, chunk).select("id", "fp", F.col("first.id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, blocks: int = 5, chunk: int = 1024) -> DataFrame:
    """`docs` with one row of each group left: that with the smallest id.

    Of rows with that id but different texts, the one whose text has the least hash is left;
    of rows that are equal in both, one. Null texts count as empty; a null id comes after all
    others; texts are read whole, however long; an empty table stays empty; all columns stay.
    """
    return first_of_groups(docs, _groups(docs, id_col, text_col, radius, blocks, chunk), id_col, text_col)


#: Most (id, text_hash) that are broadcast.
MOST_BROADCAST = 1_000_000


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the first row of each group; groups: (id, text_hash, first) of every row.

    The ids that stay, or those that go if they are fewer, are broadcast, so no text is shuffled unless
    both are more than MOST_BROADCAST.
    """
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # rows that are equal in both stay or go together
    told = cut(groups.select("id", "text_hash", stays.alias("stays")).groupBy(F.col("id").alias("first_id"), F.col("text_hash").alias("first_hash")).agg(F.max("stays").alias("stays"), F.count("*").alias("rows")))
    first, gone = told.filter("stays"), told.filter("not stays")
    stay, go = told.agg(F.count_if("stays"), F.count_if(~F.col("stays"))).first()
    few, how = (first, "left_semi") if stay <= go or go > MOST_BROADCAST else (gone, "left_anti")
    few = F.broadcast(few) if min(stay, go) <= MOST_BROADCAST else few
    same = docs[id_col].eqNullSafe(few["first_id"]) & (F.xxhash64(text_of(docs[text_col])) == few["first_hash"])
    kept = docs.join(few, same, how)
    if first.filter("rows > 1").isEmpty():
        return kept
    marked = kept.select(whole_row(kept), F.col(id_col).alias("key"), F.xxhash64(text_of(text_col)).alias("hash"))
    return marked.dropDuplicates(["key", "hash"]).select(*columns_of_row(kept))
