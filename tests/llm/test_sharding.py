import random

import pytest
from pyspark.sql import functions as F

from seqspark.llm import queries, sharding
from tests.llm.edges import TEXTS, edge_docs, empty_docs


def check(placed, docs, shards, largest):
    got = placed.toPandas()
    assert len(got) == docs.count()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    total = got["size"].sum()
    for shard in range(shards):
        assert abs(got["size"][got["shard"] == shard].sum() - total / shards) <= 0.02 * total / shards + 2 * largest
    return got


@pytest.mark.parametrize("hot", [False, True])
def test_sizes_are_near_equal_even_with_a_hot_text(spark, hot):
    rng = random.Random(2)
    texts = [f"text {k} " * rng.randint(0, 20) for k in range(4000)]
    data = [(k, "same text for a third" if hot and k % 3 == 0 else texts[k]) for k in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = check(sharding.shard_by_bytes(docs, 8).withColumn("size", sharding.byte_size()), docs, 8, 240)
    if not hot:
        spread = got.groupby("text")["shard"].nunique()
        assert (spread > 1).sum() <= 7
    again = sharding.shard_by_bytes(docs.repartition(3), 8).toPandas().sort_values("doc_id")
    assert (again["shard"].to_numpy() == got.sort_values("doc_id")["shard"].to_numpy()).all()


@pytest.mark.parametrize("parts,tolerance", [(3, 0.01), (16, 0.05), (64, 0.2)])
def test_splitters_meet_the_tolerance(spark, parts, tolerance):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), (F.col("id") % 50 + 1).alias("size"))
    total = 20_000 * 51 // 2
    splitters = sharding.find_splitters(keys, parts, total, tolerance)
    assert splitters == sorted(splitters) and len(splitters) == parts - 1
    rows = [((r[0] + (1 << 63) << 64) + r[1] + (1 << 63), r[2]) for r in keys.collect()]
    for i, s in enumerate(splitters, 1):
        assert abs(sum(n for k, n in rows if k < s) - total * i // parts) <= max(tolerance * total / parts, 50)


def test_equal_keys_of_all_rows(spark):
    docs = spark.createDataFrame([(1, "same")] * 100, "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 8).toPandas()
    assert len(got) == 100 and all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_edge_rows_and_empty_table(spark):
    docs = edge_docs(spark)
    placed = sharding.shard_by_bytes(docs, 8)
    assert sorted(placed.columns) == sorted(docs.columns) and placed.count() == len(TEXTS)
    assert placed.where("shard NOT BETWEEN 0 AND 7").count() == 0
    assert sharding.shard_by_bytes(empty_docs(spark), 8).count() == 0


def test_query(spark):
    import zlib

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = queries.op6_sharding(spark, sf_dir).toPandas()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got.itertuples()} == {(k, len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}
    assert (got.law == "bytes").all() and got.grown_shard.isna().all()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()
