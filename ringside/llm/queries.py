"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, html_extract, importance, langid, mixing, prefix_trie, quality, secret_scan, sharding, simhash, toxicity
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources of all documents takes of each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies", "rate")


def vocabulary() -> tuple[dict[bytes, int], str]:
    """The ranks and the split pattern that the byte-level BPE queries take."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to, as digests."""
    ranks, pattern = vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode(encoded, ranks, pattern).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    fifth = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    model = langid.fit(docs.filter(fifth != 0))
    found = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fifth == 0).alias("held_out"), "lang_pred", "score", "rejected")


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """The chain over the categories that the labels have: low quality, then toxic."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and decision of each category for every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity_chain(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(F.concat("assign", "access", "hex")), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("assign", "access", "hex", "random")).alias("spans"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).withColumnRenamed("id", "doc_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    weights = html_extract.fit(pages)
    found = html_extract.main_text(pages.select(F.struct("page_id", "url").alias("page"), "html"), weights, id_col="page")
    return found.select("id.page_id", "id.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def prefix_trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that start with turns of the first of their hundred."""
    rows = prefix_trie.turns(conversations)
    first = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie.prefix_trie(prefix_trie.with_heads_of(rows, F.col("conv") - F.col("conv") % 100, first), prefix_trie.members(rows))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations."""
    return prefix_trie_of(table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal documents stays, for every document."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents against the benchmark's texts, and the twentieth that is drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length({0})), lambda i: ascii({0}[i + 1])::BIGINT)), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
OP11_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS b, {_CRC.format("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
line AS (SELECT i.c, o.pos, o.r, o.t FROM ids i JOIN own o ON o.c = i.b AND o.pos <= i.h UNION ALL SELECT i.c, o.pos, o.r, o.t FROM ids i JOIN own o ON o.c = i.c AND o.pos > i.h),
placed AS (SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY pos) AS d FROM line),
path AS (SELECT c, d, sha256(string_agg(concat(length(r), ':', length(t), ':', r, t), '') OVER (PARTITION BY c ORDER BY d)) AS node, length(t) AS size FROM placed UNION ALL SELECT c, 0, 'root', 0 FROM ids),
long AS (SELECT c, max(d) AS n FROM path GROUP BY c),
nodes AS (SELECT p.node, p.d, min(p.c) AS conv_id, count(*) AS n_convs, max(p.size) AS size, sha256(coalesce(string_agg(CASE WHEN p.d = l.n THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends_sha256 FROM path p JOIN long l ON l.c = p.c GROUP BY p.node, p.d),
up AS (SELECT n.node, n.d, n.n_convs, n.size, q.node AS a, q.d AS ad FROM nodes n JOIN path q ON q.c = n.conv_id AND q.d <= n.d),
kids AS (SELECT a, count(*) AS n_children FROM up WHERE ad = d - 1 GROUP BY a),
sums AS (SELECT u.a, sum((u.n_convs - 1) * u.size) AS saved_tokens, count(*) - count(k.a) AS n_leaves FROM up u LEFT JOIN kids k ON k.a = u.node GROUP BY u.a)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.a = n.node LEFT JOIN kids k ON k.a = n.node LEFT JOIN up u ON u.node = n.node AND u.ad = n.d - 1 LEFT JOIN nodes p ON p.node = u.a
"""

#: Of repeated rows of the largest id, one is kept.
OP12_SQL = """
WITH told AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS k FROM documents),
met AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM told GROUP BY text)
SELECT t.doc_id, m.keep_id, m.group_size, t.k = 1 AS kept, sha256(t.text) AS text_sha256 FROM told t JOIN met m ON m.text = t.text
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sharding, op2_mixing, op3_language_id, op4_toxicity, op5_byte_bpe, op6_secrets, op7_quality, op8_html, op9_neighbours, op10_simhash, op11_prefix_trie, op12_exact_dedup, op13_importance]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11_SQL, "op12_exact_dedup": OP12_SQL}
