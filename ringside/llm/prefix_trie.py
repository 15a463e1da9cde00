"""Prefix trie of conversations, by chained digests.

Turn by turn, a conversation's digest is the SHA-256 of its digest before and of the turn, so
that equal digests mean equal prefixes. Every prefix becomes a row; those of a depth and
digest are a node, whose members are the conversations that start with it.

The smallest member of a node owns it. A conversation owns a stretch of its own path, from some depth down to its end
(a chain); above it, the path runs through nodes of smaller owners. So node and owner are plain numbers
once the rows of all prefixes have met their nodes, and a chain is exploded to all ancestors by grouping the
rows of its path by owner, which also tells at what depth it hangs below each. Sums over subtrees are sums along
a chain, from its end up, of own values and of what hangs below. A chain has no more ancestors than its
conversation has turns, so no row is added to those of the prefixes; exploding each single node
would be quadratic in the length of a conversation.

Texts are digested where they are read and never shuffled. A conversation's turns pass through one task, in
order, as chained digests must; the task holds one digest. Nodes that very many conversations
share are broadcast (common.looked_up). The ids that end at a node are joined in pieces of a range of ids
each, and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, looked_up, text_of

PIECE = 4096  # conversation ids in one piece of a node's ends at most
EMPTY = hashlib.sha256(b"")


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, said, size) of every turn: its place from 1, digest of role and text, and code points of the text.

    Turns are ordered by number, null first; ties by role, then by digest, so equal turns are interchangeable. A null role or
    text counts as empty; texts are read whole; rows without a conversation are left out; an empty
    table gives an empty result; other columns are ignored.
    """
    role, text = text_of(role_col), text_of(text_col)
    said = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), said.alias("said"), F.char_length(text).cast("long").alias("size"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "said")).cast("long")
    return cut(rows.select("conv", at.alias("at"), "said", "size"))  # narrow; texts are read once


def members(rows: DataFrame) -> DataFrame:
    """(conv) of the conversations of turns()."""
    return rows.filter("at = 1").select("conv")


def with_heads_of(rows: DataFrame, other: Column, first: Column) -> DataFrame:
    """turns() in which the first turns of each conversation are those of another.

    other, first: whose turns, and how many, as expressions of `conv`; all of them if that one has
    fewer, none if it isn't there. The conversation's own turns after so many follow.
    """
    asked = members(rows).select(F.col("conv").alias("of"), other.alias("other"), first.alias("first"))
    heads = rows.join(asked, (rows["conv"] == asked["other"]) & (rows["at"] <= asked["first"])).select(F.col("of").alias("conv"), "at", "said", "size")
    return heads.unionByName(rows.filter(F.col("at") > first))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and digest of each prefix; rows come by conversation and place, the first with place 0."""
    names, held, digest, depth = ["conv", "depth", "digest", "size", "last"], None, b"", 0
    for batch in batches:
        out = []
        for conv, at, said, size in zip(*(c.to_pylist() for c in batch.columns)):
            if held:
                out.append((*held, at == 0))
            if at == 0:
                digest, depth = EMPTY.digest(), 0
            else:
                digest, depth = hashlib.sha256(digest + said).digest(), depth + 1
            held = conv, depth, digest, size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*held, True)], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, joined by commas; rows come by node and piece."""
    key, state, names = None, None, ["conv_id", "depth", "ends_sha256"]
    for batch in batches:
        out = []
        for owner, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (owner, depth) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, state.hexdigest()))
            key, state = (owner, depth), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names)


def _ends(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations end."""
    piece = F.expr(f"conv div {PIECE} - cast(conv % {PIECE} < 0 as int)").alias("piece")
    pieces = paths.filter("last").groupBy("owner", "depth", piece).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece")
    return dealt.select("owner", "depth", "piece", "ids").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """A row for every node of the trie of turns(): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id: the smallest member, which names the node together with its depth; n_leaves and saved_tokens are sums over the subtree, the node included;
    ends_sha256: of the ids of members that end here. convs: (conv) of all conversations, those
    without turns too, which are members of the root; else those of `rows`. No conversation, no
    node.
    """
    bounded_batches(rows.sparkSession, rows=20_000)
    starts = (members(rows) if convs is None else convs).select("conv", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("size"))
    line = rows.unionByName(starts).repartition("conv").sortWithinPartitions("conv", "at")
    prefixes = cut(line.select("conv", "at", "said", "size").mapInArrow(_chain, "conv long, depth long, digest binary, size long, last boolean"))
    nodes = cut(prefixes.groupBy("depth", "digest").agg(F.count("*").alias("__n"), F.count("*").alias("n_convs"), F.min("conv").alias("owner"), F.max("size").alias("size")))
    paths = cut(looked_up(prefixes.drop("size"), nodes, ["depth", "digest"], prefixes.count()).drop("digest"))
    # the nodes, each with its owner; and how deep each conversation's path follows other owners
    owned = paths.filter("conv = owner").select("conv", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    above = paths.filter("conv <> owner").groupBy("conv", "owner").agg(F.max("depth").alias("depth"))
    chains = owned.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"))
    # only conversations with nodes of their own hang below others
    above = cut(above.join(chains, "conv"))
    parents = above.groupBy("conv").agg(F.max(F.struct("depth", "owner")).alias("up")).select("conv", "up.owner", "up.depth")
    hung = cut(parents.groupBy(F.col("owner").alias("conv"), "depth").agg(F.count("*").alias("hung")))
    # a chain ends in a leaf unless others hang below its end
    forks = hung.join(chains.select("conv", F.col("bottom").alias("depth")), ["conv", "depth"]).select("conv", F.lit(0).alias("leaf"))
    below = above.join(forks, "conv", "left").groupBy(F.col("owner").alias("conv"), "depth").agg(F.sum("saved").alias("saved_below"), F.sum(F.coalesce("leaf", F.lit(1))).alias("leaves_below"))
    met = owned.join(hung, ["conv", "depth"], "left").join(below, ["conv", "depth"], "left").fillna(0, ["hung", "saved_below", "leaves_below"])
    chain = Window.partitionBy("conv")
    up = chain.orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("depth") == F.max("depth").over(chain)
    met = met.withColumns({"n_children": F.col("hung") + F.when(end, 0).otherwise(1)})
    met = met.withColumns({"n_leaves": F.sum((F.col("n_children") == 0).cast("long") + F.col("leaves_below")).over(up), "saved_tokens": F.sum(F.col("saved") + F.col("saved_below")).over(up)})
    tops = parents.select(F.col("conv"), F.col("owner").alias("parent"), (F.col("depth") + 1).alias("depth"))
    told = met.join(tops, ["conv", "depth"], "left").withColumnRenamed("conv", "conv_id").join(_ends(paths), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") == 0, F.lit(None).cast("long")).otherwise(F.coalesce("parent", "conv_id"))
    return told.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY.hexdigest())).alias("ends_sha256"))
