"""The pipeline against a plain version of its stages."""

import hashlib

import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ringside.llm import mixing, queries, toxicity  # noqa: E402

from .fixtures import documents  # noqa: E402
from .test_near_copies import brute_first  # noqa: E402


def staged(spark, docs, sf_dir, folder):
    out = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_every_stage(spark, small, tmp_path):
    first = spark.read.parquet(f"{small}/documents.parquet")
    docs, clean, unlike, redacted, mixed, done = staged(spark, first, small, tmp_path)
    chain = queries.toxicity_chain(spark, docs, small)
    limit = chain.thresholds[chain.categories.index("toxic")]
    want = {r.doc_id for r in docs.collect() if chain.probabilities(r.text or "")[1] < limit}
    assert {r.doc_id for r in clean.collect()} == want
    assert 0 < len(want) < len(docs.collect())

    # the rule of the stage: 5-word shingle sets, Jaccard similarity 0.8 or more
    assert {r.doc_id for r in unlike.collect()} == brute_first([(r.doc_id, r.text) for r in clean.collect()])

    before, after = ({r.doc_id: r for r in d.collect()} for d in (unlike, redacted))
    assert set(before) == set(after)
    assert all(after[i].n_chars == len(after[i].text) and (after[i].text == before[i].text or "[SECRET]" in after[i].text) for i in after)

    copies = {r.id: r.copies for r in mixing.mix(redacted).collect() if r.copies}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert docs.columns == clean.columns == unlike.columns == redacted.columns == mixed.columns

    ranks, pattern = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in mixed.collect()}
    got = done.collect()
    assert len(got) == mixed.count()
    for r in got:
        assert r.ids == own.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == sorted(r.doc_id for r in got)


def test_awkward_rows(spark, small, tmp_path):
    docs = documents(spark)
    out = staged(spark, docs, small, tmp_path / "a")
    assert out[-1].count() == out[-2].count() > 0
    empty = staged(spark, docs.limit(0), small, tmp_path / "b")
    assert [d.count() for d in empty] == [0] * 6
    assert toxicity.without(docs, queries.toxicity_chain(spark, docs, small), "toxic").count() <= docs.count()
