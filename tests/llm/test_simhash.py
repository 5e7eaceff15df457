import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from seqspark.llm import queries, simhash
from seqspark.llm.components import connected_components
from tests.conftest import rows
from tests.llm.edges import TEXTS, edge_docs, empty_docs

SPACES = " \t\n\x0b\x0c\r"


def brute_fingerprint(text) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACES else c for c in lowered).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def brute_groups(docs):
    prints = [brute_fingerprint(t) for _, t in docs]
    near = [(i, j) for i, j in combinations(range(len(docs)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = union_find(range(len(docs)), near)
    first = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            first[roots[i]] = min(doc_id, first.get(roots[i], doc_id))
    return [(doc_id, f"{prints[i]:016x}", first.get(roots[i])) for i, (doc_id, _) in enumerate(docs)]


@pytest.mark.parametrize("codes", [simhash.COARSE, simhash.FINE])
def test_anchors_cover_the_threshold(codes):
    covering = simhash.Covering(codes)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    home, _ = covering.anchors(x)
    assert max(int(a ^ b).bit_count() for a, b in zip(x.tolist(), home[:, 0].tolist())) <= sum(c.radius for c in codes)
    for flips in (0, 1, 2):
        for _ in range(20):
            bits = rng.choice(64, flips, replace=False)
            y = x ^ np.uint64(sum(1 << int(b) for b in bits))
            anchors, there = covering.anchors(y)
            assert ((anchors == home[:, :1]) & there).any(axis=1).all()
            assert all(len(set(a[t].tolist())) == t.sum() for a, t in zip(anchors[:20], there[:20]))


def test_codes_must_be_perfect():
    with pytest.raises(ValueError):
        simhash.Code((1, 2, 3, 3), 1).moves(1)


def test_links_match_all_pairs(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for x in list(prints)[:40]:
        for _ in range(30):
            prints.add(x ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(1, 4)))))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4), simhash.Covering())
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert rows(got) == sorted(want, key=repr) and len(want) > 500


def test_visits_are_not_broadcast(spark):
    """Each fingerprint has about 90 visits, which Spark's estimate of the size leaves out."""
    rng = random.Random(2)
    prints = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(2000)], "fp long").repartition(4)
    made = simhash.links(prints, simhash.Covering())
    made.collect()
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(50)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(150)] + [(7, 7), (8, 7)]
    got = dict(rows(connected_components(spark.createDataFrame(pairs, "a long, b long"))))
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == union_find(nodes, pairs)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    docs = [(d, t) for d, t in TEXTS] + [(100 + k, f"a common text of some length with number {k % 5}") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(simhash.near_duplicates(df)) == sorted(brute_groups(docs), key=repr)


def test_long_text_in_pieces():
    text = " ".join(f"w{k}" for k in range(5000))
    whole = simhash.fingerprint(text.encode())
    kept = simhash.word_chunks
    simhash.word_chunks = lambda data: kept(data, size=1000)
    try:
        assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)
    finally:
        simhash.word_chunks = kept


def test_keep_first(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_first(docs)
    groups = brute_groups(TEXTS)
    assert kept.columns == docs.columns
    with_id = sorted({c for _, _, c in groups if c is not None})
    assert sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == with_id
    assert kept.where("doc_id IS NULL").count() == len({f for _, f, c in groups if c is None})
    assert simhash.keep_first(empty_docs(spark)).count() == 0 and simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_query_over_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(queries.op7_simhash(spark, sf_dir)) == sorted(brute_groups(docs), key=repr)
