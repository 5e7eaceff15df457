"""A corpus pipeline of five stages, each by one operator of seqspark.llm.

A stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns of documents; the last adds
shard and slot. run() writes each stage's rows to the shared folder, reads them back for the next one, and deletes what
the stage before had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqspark.llm import decontam, mixing, nearcopies, sharding, toxicity
from seqspark.llm.common import discard, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on labelled rows of docs, scores under a half."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a Jaccard similarity of 0.8 or more over shingles of five words the document with
    the smallest doc_id; one, if rows share it. Candidates are fingerprints linked by anchors, and min-hash fingerprints."""
    return nearcopies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by an item of benchmark."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix to target weights takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard (0 to 7, near equal in bytes) and slot."""
    return sharding.shard_by_bytes(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL expresses neither the network nor the random rounding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
