import random
import re

import numpy as np
from pyspark.sql import functions as F

from seqspark.llm import mixing, queries
from tests.conftest import rows
from tests.llm.edges import TEXTS, edge_docs, empty_docs


def water_fill(sizes: dict) -> dict:
    """Targets, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        sum_weights = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / sum_weights > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum_weights for s in order}
        full.update(over)


def sample(spark, n=3000, seed=5):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "zz", "tiny"]
    data = [(rng.choice(names[:5]) if k % 3 else "b", rng.randint(0, 400), k) for k in range(n)] + [("tiny", 3, n), ("tiny", 1, n + 1)]
    return spark.createDataFrame(data, "source string, size long, row long")


def test_targets_and_taken(spark):
    docs = sample(spark)
    got = mixing.copies(docs, leaf_rows=64, fan_in=3).toPandas()
    sizes = {s: int(n) for s, n in docs.groupBy("source").agg(F.sum("size")).collect()}
    want = water_fill(sizes)
    assert sizes["tiny"] * 3 == want["tiny"]
    assert len(got) == docs.count()
    for source, own in got.groupby("source", dropna=False):
        source = None if source != source else source
        assert (own.source_size == sizes[source]).all() and np.allclose(own.target, want[source])
        assert abs((own.copies * own["size"]).sum() - want[source]) <= own["size"].max()
        ratio = want[source] / sizes[source]
        assert set(own.copies[own["size"] > 0]) <= {int(ratio), int(ratio) + 1} and (own.copies <= 3).all()


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = sample(spark)
    first = rows(mixing.copies(docs, leaf_rows=64).select("row", "copies"))
    assert first == rows(mixing.copies(docs.repartition(7, "size"), leaf_rows=64).select("row", "copies"))


def test_pivot_keeps_expectations_and_mass():
    rng = np.random.default_rng(1)
    sizes, p = np.array([5.0, 3.0, 8.0, 1.0, 13.0, 2.0]), 0.3
    mean = np.zeros(6)
    for _ in range(4000):
        copies = np.full(6, p)
        held = mixing.pivot(copies, sizes, rng.random(6))
        whole = [k for k in range(6) if k != held]
        assert set(copies[whole]) <= {0.0, 1.0} and abs((copies * sizes).sum() - p * sizes.sum()) < 1e-6
        mean += copies
    assert np.abs(mean / 4000 - p).max() < 0.03


def test_repeated_rows_are_spread_over_leaves_and_tasks(spark):
    """Half of the rows are one row, with a null id."""
    data = [("a", 7, None)] * 3000 + [("a", k % 9, k) for k in range(2000)] + [("b", 3, k) for k in range(2000, 3000)]
    docs = spark.createDataFrame(data, "source string, size long, row long").repartition(5)
    got = mixing.copies(docs, leaf_rows=100, fan_in=4)
    sizes = {"a": sum(s for x, s, _ in data if x == "a"), "b": 3000}
    for source, target in water_fill(sizes).items():
        own = got.where(F.col("source") == source)
        assert own.count() == sum(x == source for x, _, _ in data)
        assert abs(own.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] - target) <= 9
    assert got.agg(F.max("copies")).first()[0] <= 3
    assert rows(got) == rows(mixing.copies(docs.repartition(2), leaf_rows=100, fan_in=4))
    mixed = mixing.mix(docs.select("source", "row", F.repeat(F.lit("w "), F.col("size").cast("int")).alias("text")), leaf_rows=100)
    for source, target in water_fill(sizes).items():
        assert abs(mixed.where(F.col("source") == source).agg(F.sum(mixing.word_count())).first()[0] - target) <= 9
    assert 1 <= mixed.where("row IS NULL").count() <= 9000


def test_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    source_of, sizes = {r["doc_id"]: r["source"] for r in docs}, {}
    for d, s in source_of.items():
        sizes[s] = sizes.get(s, 0) + words[d]
    want, taken = water_fill(sizes), dict.fromkeys(sizes, 0)
    got = queries.op3_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(words)
    for r in got:
        source = source_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], sizes[source]) and abs(r["target"] - want[source]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(words[d] for d in words if source_of[d] == s) for s in sizes)
    assert rows(queries.op3_mixing(spark, sf_dir)) == sorted(map(tuple, got), key=repr)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    counted = {r[0]: r[1] for r in docs.where("doc_id IS NOT NULL").select("doc_id", mixing.word_count()).collect()}
    for doc_id, text in TEXTS:
        if doc_id is not None:
            assert counted[doc_id] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    mixed = mixing.mix(docs)  # the only source, null, gets all its words once
    assert mixed.columns == docs.columns and mixed.count() == len(TEXTS)
    assert rows(mixed.select("doc_id", "text")) == rows(docs.select("doc_id", "text"))
    sized = docs.select("source", mixing.word_count().alias("size"), F.col("doc_id").alias("row"))
    copies = mixing.copies(sized)
    assert rows(copies.select("row", "size", "copies")) == sorted([(d, counted.get(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), 1) for d, t in TEXTS], key=repr)
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.copies(sized.limit(0)).count() == 0


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * (k % 7 + 1)), "a" if k < 20 else "b") for k in range(100)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs.repartition(3)).groupBy("source").agg(F.sum(mixing.word_count()).alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    sizes = {"a": sum(k % 7 + 1 for k in range(20)), "b": sum(k % 7 + 1 for k in range(20, 100))}
    want = water_fill(sizes)
    for r in mixed:
        assert abs(r["n"] - want[r["source"]]) <= 7
