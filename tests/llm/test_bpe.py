import hashlib

import public_tokenizers
import tiktoken

from ringside.llm import bpe, queries

from .fixtures import documents


def library():
    ranks, pattern = queries.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_query_against_the_library(spark, small):
    own = library()
    got = {r.doc_id: r for r in queries.op5_byte_bpe(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_awkward_rows_round_trip(spark):
    ranks, pattern = queries.vocabulary()
    docs = documents(spark)
    got = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect()
    own = library()
    texts = sorted((r.text or "").encode() for r in docs.collect())
    assert sorted(bytes(r.decoded) for r in got) == texts
    for r in got:
        assert r.ids == own.encode_ordinary(bytes(r.decoded).decode())
    assert bpe.decode(bpe.encode(docs.limit(0), ranks, pattern), ranks, pattern).count() == 0


def test_pieces_of_every_length():
    import random

    ranks, pattern = queries.vocabulary()
    enc, own = bpe.Encoder(ranks, pattern, keep=50), library()
    rng = random.Random(3)
    for n in [*range(1, 70), 500, 511, 512, 513, 900, 3000]:
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "éäößñ語", " \n", "!?#-"):
            text = "".join(rng.choice(letters) for _ in range(n))
            import numpy as np

            assert np.frombuffer(enc.encode(text), "<i4").tolist() == own.encode_ordinary(text)


def test_other_vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    text = "It's 2024's best, isn't it?  <|endoftext|>\n\n\tend"
    assert np.frombuffer(enc.encode(text), "<i4").tolist() == own.encode_ordinary(text)
