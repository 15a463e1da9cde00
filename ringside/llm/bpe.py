"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices.

The vocabulary is given as ranks (bytes to rank, as in a .tiktoken file) and a split pattern.
Every distinct piece of a batch is put into a padded matrix with pieces of like length. In
each round, every row merges its leftmost pair of least rank; pair ranks come from a hash
table over (left, right); the matrix is closed up by one column, and finished rows leave.
Pieces beyond `LONG` bytes (the matrices would be quadratic) are merged with a heap, in the
same order, so every text is encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

LONG = 512
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes and decodes by one vocabulary; keeps the pieces it has met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 400_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.keep = keep
        self.known: dict[str, bytes] = {}
        top = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = [b""] * top
        for b, r in ranks.items():
            self.token[r] = b
        self.pair = {}
        for b, r in ranks.items():
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = r
        self._hash()
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.fromiter(map(len, self.token), np.int64, top)
        self.offset = np.cumsum(self.length) - self.length

    def _hash(self) -> None:
        """An open-addressed table of the pairs, filled by rounds of linear probing."""
        keys = np.fromiter(self.pair.keys(), np.int64, len(self.pair))
        vals = np.fromiter(self.pair.values(), np.int32, len(self.pair))
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            put, first = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[put], self.vals[put] = keys[at], vals[at]
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, vals, slot = keys[rest], vals[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE if the pair is no token."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.full(key.shape, NONE, np.int32)
        seen = self.keys[slot]
        hit = seen == key
        out[hit] = self.vals[slot[hit]]
        open_ = np.nonzero(~hit & (seen != -1) & (key >= 0))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            slot_o = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = slot_o
            seen_o, key_o = self.keys[slot_o], key[open_]
            got = seen_o == key_o
            out[tuple(x[got] for x in open_)] = self.vals[slot_o[got]]
            go = ~got & (seen_o != -1)
            open_ = tuple(x[go] for x in open_)
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of like length, all of 2 bytes or more."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        col = np.arange(width)
        ids[col < size[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.ranks_of(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : size[k]]
                go = ~done
                ids, rank, row, size, at, least = ids[go], rank[go], row[go], size[go], at[go], least[go]
                if not len(row):
                    return out
            n = np.arange(len(row))
            right = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            ids[n, at] = least
            ids = np.where(right, ids[:, 1:], ids[:, :-1])
            rank = np.where(right[:, :-1], rank[:, 1:], rank[:, :-1])  # the pair at `at` goes
            size = size - 1
            # only the pairs that hold the new token change
            has = at < rank.shape[1]
            rank[n[has], at[has]] = self.ranks_of(ids[n[has], at[has]], ids[n[has], at[has] + 1])
            has = at > 0
            rank[n[has], at[has] - 1] = self.ranks_of(ids[n[has], at[has] - 1], ids[n[has], at[has]])
            most = int(size.max())
            if most < ids.shape[1]:
                ids, rank = ids[:, :most], rank[:, : most - 1]

    def _heap(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: the same merges in the same order, from a heap."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pair.get
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            m = after[k]
            if ids[k] < 0 or m >= n or get(ids[k] << 32 | ids[m]) != r:
                continue
            ids[k], ids[m] = r, -1
            after[k] = q = after[m]
            if q < n:
                before[q] = k
                if (s := get(r << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (s, k))
            if (p := before[k]) >= 0 and (s := get(ids[p] << 32 | r)) is not None:
                heapq.heappush(heap, (s, p))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for s in pieces:
            b = s.encode("utf-8", "surrogatepass")
            by.setdefault(0 if len(b) > LONG else 1 if len(b) == 1 else (len(b) - 1).bit_length() + 1, []).append((s, b))
        for kind, own in by.items():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                if kind == 0:
                    found = [self._heap(b) for _, b in part]
                elif kind == 1:
                    found = [self.byte_id[b[0] : b[0] + 1] for _, b in part]
                else:
                    found = self._matrix([b for _, b in part])
                for (s, _), ids in zip(part, found):
                    self.known[s] = ids.astype("<i4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers; new pieces are learned at once."""
        split = [self.find(t) for t in texts]
        every = set().union(*split)
        if len(self.known) > self.keep:
            self.known.clear()
        self.learn(every.difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of rows of ids, laid end to end, and each row's number of bytes."""
        ids = ids.astype(np.int64)
        parts = []
        for at in range(0, len(ids), 1 << 17):  # bounded memory for the gather
            part = ids[at : at + (1 << 17)]
            each = self.length[part]
            start = np.cumsum(each) - each
            parts.append(self.blob[np.arange(int(each.sum())) + np.repeat(self.offset[part] - start, each)].tobytes())
        ends = np.r_[0, np.cumsum(self.length[ids])][np.cumsum(sizes)]
        return b"".join(parts), np.diff(np.r_[0, ends])


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """This worker's encoder; made once for each vocabulary that is sent."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row: the ids of its whole text, without special tokens.

    A null or empty text has no ids. Rows keep their ids' order; repeated rows give repeated
    rows; an empty table an empty result; other columns are ignored. `ranks` is broadcast: a
    vocabulary has a fixed size, about a MB.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, pattern)
        for batch in batches:
            got = enc.encode_batch(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
            flat = np.frombuffer(b"".join(got), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids of each row stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, pattern)
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            data, each = enc.decode(lists.flatten().to_numpy(zero_copy_only=False), sizes)
            ends = pa.array(np.r_[0, np.cumsum(each)], pa.int32())
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, ends.buffers()[1], pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, raw], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
