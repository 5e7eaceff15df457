import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from seqspark.llm import nearcopies
from seqspark.llm.common import stored
from seqspark.llm.components import connected_components
from tests.llm.edges import TEXTS, edge_docs, empty_docs
from tests.llm.test_simhash import union_find

SF_DIR = "/root/testdata/sf0.01"


def brute_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_kept(docs):
    """The smallest doc_id of each component; None counts once for a component without ids."""
    sets = brute_sets([t for _, t in docs])
    same = {}
    for i, s in enumerate(sets):
        same.setdefault(frozenset(s), []).append(i)
    pairs = [(m[0], i) for m in same.values() for i in m[1:]]
    for (s, a), (t, b) in combinations([(s, m[0]) for s, m in same.items()], 2):
        if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 5 * (both := len(s & t)) >= 4 * (len(s) + len(t) - both):
            pairs.append((a, b))
    roots = union_find(range(len(docs)), pairs)
    groups = {}
    for i, (doc_id, _) in enumerate(docs):
        groups.setdefault(roots[i], []).append(doc_id)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=repr)


def kept(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def test_stage_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert kept(corpus_pipeline.drop_near_duplicates(spark, df, SF_DIR)) == brute_kept(docs)


def test_edited_copies(spark):
    """Copies of a text with some words changed: chains, pairs around 0.8, and texts that share less."""
    rng = random.Random(3)
    docs = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 100, 300)))]
        for _ in range(12):
            docs.append((len(docs) * 7919 % 997, " ".join(words)))
            for at in rng.sample(range(len(words)), rng.randint(0, len(words) // 20)):
                words[at] = f"w{rng.randrange(5000)}"
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute_kept(docs)
    assert kept(nearcopies.keep_first(df)) == want and 12 < len(want) < 130


def test_edge_rows(spark):
    docs = edge_docs(spark)
    got = nearcopies.keep_first(docs)
    assert got.columns == docs.columns and kept(got) == brute_kept(TEXTS)
    assert nearcopies.keep_first(empty_docs(spark)).count() == 0


def test_sketches_agree_as_often_as_sets_are_alike(spark):
    """Pairs of similarity 0.8 pass, those of a half don't; the SQL counts what numpy counts."""
    rng, n = np.random.default_rng(5), 180
    assert 100 < nearcopies.least_agreeing((4, 5)) < 120
    rows = []
    for shared in (160, 120):  # of 180 each: similarities 0.8 and 0.5
        for _ in range(100):
            all_ = rng.integers(0, 1 << 64, 2 * n - shared, dtype=np.uint64)
            a, b = (nearcopies.minima(np.sort(s)) for s in (all_[:n], all_[n - shared :]))
            agree = int(((a & np.uint64(15)) == (b & np.uint64(15))).sum())
            rows.append((shared, agree, *(nearcopies.sketch(x).view(np.int64).tolist() for x in (a, b))))
    df = spark.createDataFrame(rows, "shared long, agree long, a array<long>, b array<long>")
    got = [(r[0], r[1], r[2]) for r in df.select("shared", "agree", nearcopies.agreeing("a", "b")).collect()]
    assert all(agree == seen for _, agree, seen in got)
    assert all((seen >= nearcopies.least_agreeing((4, 5))) == (shared == 160) for shared, _, seen in got)


def test_large_groups_of_alike_texts_make_few_pairs(spark):
    """Of 600 texts that are each about half like each other few pairs reach the exact check."""
    rng = random.Random(8)
    base, docs = [f"w{rng.randrange(5000)}" for _ in range(200)], []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(200), 7):
            words[at] = f"e{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked, near = [], nearcopies.near

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return near(pairs, *rest)

    nearcopies.near = counted
    try:
        assert kept(nearcopies.keep_first(df)) == brute_kept(docs)
    finally:
        nearcopies.near = near
    assert sum(asked) < 600 * 600 / 2 / 4


def test_edited_copies_of_one_text_make_few_pairs(spark):
    """Of 500 copies of a text about half are too far from it and from each other, at 0.65 to 0.8: few pairs of them reach
    the exact check, and the documents kept are those of brute force."""
    rng = random.Random(9)
    base, docs = [f"w{rng.randrange(5000)}" for _ in range(150)], []
    for i in range(500):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 7)):
            words[at] = f"e{rng.randrange(60)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked, near = [], nearcopies.near

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return near(pairs, *rest)

    nearcopies.near = counted
    try:
        want = brute_kept(docs)
        assert kept(nearcopies.keep_first(df)) == want and 150 < len(want) < 350
    finally:
        nearcopies.near = near
    assert asked[-1] < 500 * 8


def test_rare_shingles(spark):
    """Those of few sets, wherever the sets are: one that a task has too often is not rare for the others."""
    rng = random.Random(13)
    sets = {k: {rng.randrange(300) for _ in range(rng.randint(0, 6))} | ({-1} if k < 30 or k == 90 else set()) | ({-2} if k % 33 == 0 else set()) for k in range(100)}
    held = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "set long, held array<long>").coalesce(3)
    times = {x: sum(x in s for s in sets.values()) for s in sets.values() for x in s}
    want = sorted((k, x, times[x]) for k, s in sets.items() for x in s if times[x] <= 4)
    assert sorted(map(tuple, nearcopies.rare_shingles(held, 4).collect())) == want and any(x == -2 for _, x, _ in want)


def test_pairs_with_rare_shingles_are_found(spark):
    """In a large bucket, pairs of components that only what they share of rare shingles links are kept."""
    rng = random.Random(17)
    base, docs = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), 6):
            words[at] = f"x{i}y{at}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], f"last{i}"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    own = stored(nearcopies.sets_of(df, 5), "own")
    labels = nearcopies.components(df, own, 5, (4, 5), heads=2)
    assert kept(nearcopies.keep_first(df)) == brute_kept(docs)
    assert labels.groupBy("label").count().where("count = 2").count() == 60


def test_more_links_join_components(spark):
    """Adding links to components gives what all links together give, also without new or without old ones."""
    rng = random.Random(11)
    for old, new in ((60, 25), (60, 0), (0, 25)):
        first, more = ([(rng.randrange(-50, 50), rng.randrange(-50, 50)) for _ in range(n)] for n in (old, new))
        first, more = ([(a, b) for a, b in pairs if a != b] for pairs in (first, more))
        asked, added = (spark.createDataFrame(pairs, "a long, b long") for pairs in (first, more))
        labels = stored(connected_components(asked).select(F.col("node").alias("set"), "label"), "labels")
        got = {r["set"]: r["label"] for r in nearcopies.with_more(labels, added).collect()}
        nodes = sorted({n for pair in first + more for n in pair})
        roots = union_find(nodes, first + more)
        least = {}
        for n in nodes:
            least.setdefault(roots[n], n)
        assert got == {n: least[roots[n]] for n in nodes}


def test_unlike_edits_of_one_text_are_told_apart_without_their_texts(spark):
    """Of 600 copies of a text, each with edits of its own, almost all pairs are at 0.5 to 0.8. What is compared by its texts
    stays in proportion to the copies, and the documents kept are those of brute force."""
    rng = random.Random(21)
    base, docs = [f"w{rng.randrange(5000)}" for _ in range(150)], []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(2, 5)):
            words[at] = f"e{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked, near = [], nearcopies.near

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return near(pairs, *rest)

    nearcopies.near = counted
    try:
        want = brute_kept(docs)
        assert kept(nearcopies.keep_first(df)) == want and 300 < len(want) < 600
    finally:
        nearcopies.near = near
    assert asked[-1] < 600 * 8, asked


def test_cells_never_count_too_few(spark):
    """Sets share no more of their shingles that are not rare than their cells allow; the cells hold each of them once."""
    rng = random.Random(23)
    sets = {k: {rng.randrange(-400, 400) for _ in range(rng.randint(0, 300))} for k in range(40)}
    held = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "set long, held array<long>").repartition(3)
    rare = stored(nearcopies.rare_shingles(held, 8), "rare")
    few = {x for s in sets.values() for x in s if sum(x in t for t in sets.values()) <= 8}
    cells = stored(nearcopies.cells_of(held, rare), "cells")
    assert {r["set"]: (r["common"], sum(r["cells"])) for r in cells.collect()} == {k: (len(s - few),) * 2 for k, s in sets.items()}
    other = cells.select(F.col("set").alias("other"), F.col("cells").alias("other_cells"))
    for a, b, most in cells.crossJoin(other).select("set", "other", nearcopies.shared_at_most("cells", "other_cells")).collect():
        assert len((sets[a] & sets[b]) - few) <= most <= min(len(sets[a] - few), len(sets[b] - few))
