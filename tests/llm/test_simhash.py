import numpy as np
import xxhash

from ringside.llm import queries, simhash

from .fixtures import documents


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[find(k)] for k in range(len(ids))]


def check(docs, found):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], brute_components([r.doc_id for r in rows], prints, 2)), key=str)
    assert sorted(map(tuple, found.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs, queries.op10_simhash(spark, small))


def test_awkward_rows(spark):
    docs = documents(spark)
    found = simhash.near_duplicates(docs, chunk=2)
    got = {(r.id, r.fp) for r in found.collect()}
    assert {(1, f) for i, f in got if i == 1} and found.count() == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    comp = {r.id: r.component_id for r in found.collect()}
    assert comp[2] == 1 and comp[3] == comp[4] == comp[5] == 3


def test_links_in_chunks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 63, (20, 2))]
    prints = sorted({*map(int, base), *near, 0, -1, -2})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    place = {r.v: r.root for r in simhash.components(simhash.links(df, chunk=8)).collect()}
    want = brute_components(prints, [x % 2**64 for x in prints], 2)
    groups = {}
    for x, w in zip(prints, want):
        groups.setdefault(w, set()).add(place.get(x, x))
    assert all(len(v) == 1 for v in groups.values())
    assert len({place.get(x, x) for x in prints}) == len(set(want))


def test_long_path_of_links(spark):
    path = [0]
    for k in range(60):
        path.append(path[-1] | 1 << k)
    df = spark.createDataFrame([(x,) for x in path], "fp long")
    place = simhash.components(simhash.links(df)).collect()
    assert len(place) == 61 and len({r.root for r in place}) == 1


def test_representatives(spark):
    docs = documents(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert {1, 3, 6, 7, 8, 9, 10} <= {r.doc_id for r in kept.collect()}
    assert {2, 4, 5}.isdisjoint({r.doc_id for r in kept.collect()})
