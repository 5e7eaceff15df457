import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from seqspark.llm import toxicity
from seqspark.llm.common import stored
from seqspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.edges import edge_docs, empty_docs
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_mixing import water_fill
from tests.llm.test_nearcopies import brute_kept

SF_DIR = "/root/testdata/sf0.001"


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, the documents first."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
        out[name] = docs
    return {name: df.collect() for name, df in out.items()} | {"columns": {n: df.columns for n, df in out.items()}}


def test_columns(stages):
    want = stages["columns"]["documents"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages["columns"][name] == want
    assert stages["columns"]["sharding"] == [*want, "shard", "slot"]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = dict(toxicity.score(docs, net).collect())
    assert {key(r) for r in stages["toxicity"]} == {key(r) for r in stages["documents"] if scores[r["doc_id"]] < 0.5}
    assert len(stages["toxicity"]) > 0.8 * len(stages["documents"])


def test_one_document_of_each_group_stays(stages):
    """Groups by shingles of five words and a similarity of 0.8, which hold for stages; op7's own contract has others."""
    before = [(r["doc_id"], r["text"]) for r in stages["toxicity"]]
    assert sorted((r["doc_id"] for r in stages["near_duplicates"]), key=repr) == brute_kept(before) and len(brute_kept(before)) < len(before)


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before = [(r["doc_id"], r["text"]) for r in stages["near_duplicates"]]
    clean = {r[0] for r in contaminated(before, items, 13) if not r[4]}
    assert {r["doc_id"] for r in stages["decontamination"]} == clean and len(clean) < len(before)


def test_sources_are_mixed(stages):
    words = lambda r: len((r["text"] or "").split())
    sizes, taken = collections.Counter(), collections.Counter()
    for r in stages["decontamination"]:
        sizes[r["source"]] += words(r)
    times = collections.Counter(key(r) for r in stages["mixing"])
    for r in stages["mixing"]:
        taken[r["source"]] += words(r)
    assert set(times) <= {key(r) for r in stages["decontamination"]} and max(times.values()) <= 3
    largest = max(map(words, stages["decontamination"]))
    for source, target in water_fill(sizes).items():
        assert abs(taken[source] - target) <= largest


def test_all_rows_are_sharded(stages):
    assert collections.Counter(map(key, stages["sharding"])) == collections.Counter(map(key, stages["mixing"]))
    slots = collections.defaultdict(list)
    for r in stages["sharding"]:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, name, stage):
    docs = edge_docs(spark, "s").select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars", F.lit("clash").alias("row"), F.lit("clash").alias("held"))
    got = stage(spark, docs, SF_DIR)
    assert set(docs.columns) <= set(got.columns) and got.count() > 0
    assert stage(spark, empty_docs(spark), SF_DIR).count() == 0


def test_registration():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
