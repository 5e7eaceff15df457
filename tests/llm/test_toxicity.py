import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import toxicity
from seqspark.llm.queries import op2_toxicity
from tests.llm.edges import TEXTS, edge_docs, empty_docs

SMALL = dataclasses.replace(toxicity.Settings(), word_bits=8, char_bits=8, window=8, stride=4, word_dropout=0.0, least_steps=1)


def test_gradients_match_differences():
    net = toxicity.Network.fresh(SMALL)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.Words.of([b"you are a clown and a fool today my friend indeed", b"", b"nice day"], SMALL)
    ids, text = words.windows(SMALL)
    own, few = toxicity._few(words, ids)
    label, none = np.array([1.0, 0.0, 0.0])[text], np.zeros(len(own.counts), bool)
    _, d = net.gradients(few, own, none, label)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        flat, slope = value.ravel(), d[name].ravel()
        at = np.flatnonzero(np.abs(slope) > 1e-5)
        for i in rng.choice(at, min(4, len(at)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-4
            up = net.gradients(few, own, none, label)[0]
            flat[i] = kept - 1e-4
            down = net.gradients(few, own, none, label)[0]
            flat[i] = kept
            assert slope[i] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-7)


def test_windows_overlap_and_cover_all_words():
    texts = [b" ".join(b"w%d" % k for k in range(n)) for n in (0, 1, 8, 9, 12, 13, 50)]
    words = toxicity.Words.of(texts, SMALL)
    ids, text = words.windows(SMALL)
    assert (np.bincount(text) == [1, 1, 1, 2, 2, 3, 12]).all()
    for k, n in enumerate((0, 1, 8, 9, 12, 13, 50)):
        assert set(ids[text == k][ids[text == k] >= 0].tolist()) == set(range(n))


def test_blocks_do_not_change_scores():
    net = toxicity.Network.fresh(toxicity.Settings())
    texts = [(t or "").encode() for _, t in TEXTS]
    one = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(net.scores(texts), one, atol=1e-6) and np.allclose(toxicity._in_blocks(net, texts, 100), one, atol=1e-6)


def test_one_class_gives_low_scores():
    assert (toxicity.train([b"a b", b"c"], [1, 1]).scores([b"a", b""]) < 0.5).all()
    assert (toxicity.train([], []).scores([b"a", b""]) < 0.5).all()


def test_edge_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (7, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    net = toxicity.fit(edge_docs(spark), labels)
    scored = toxicity.score(edge_docs(spark), net)
    assert scored.count() == len(TEXTS) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    same_text = [r["score"] for r in scored.where("doc_id IN (1, 2)").collect()]
    assert len(same_text) == 3 and max(same_text) - min(same_text) < 1e-5
    kept = toxicity.keep_clean(edge_docs(spark), net)
    assert kept.columns == edge_docs(spark).columns and kept.count() == scored.where("score < 0.5").count()
    assert toxicity.score(empty_docs(spark), toxicity.fit(empty_docs(spark), labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = op2_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").toPandas()
    wrong = held[held.predicted != held.toxic]
    assert len(held) > 500 and held.toxic.sum() > 40
    assert len(wrong) <= 0.03 * len(held)
    toxic, clean = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert (toxic[:, None] > clean[None]).mean() > 0.94  # some toxic texts of these tables bear no sign of it
    # Words that mark toxicity: in a tenth of the toxic texts that may be learned from, in hardly a clean one.
    learned = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id").where(~toxicity.held_out() & F.col("toxic").isNotNull())
    words = learned.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))))).groupBy("col").pivot("toxic", [0, 1]).count().na.fill(0).toPandas()
    n_toxic = learned.where("toxic = 1").count()
    marks = [w for w, n0, n1 in words.itertuples(index=False) if n1 >= n_toxic / 10 and n0 <= n1 / 50]
    held = held.merge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas(), on="doc_id")
    marked = held[(held.toxic == 1) & held.text.fillna("").str.lower().str.contains("|".join(rf"\b{w}\b" for w in marks))]
    assert len(marks) >= 5 and len(marked) > 40 and marked.predicted.mean() >= 0.97
    assert held.predicted[held.toxic == 1].mean() >= 0.84 and held.predicted[held.toxic == 0].mean() <= 0.02


def test_labels_without_texts_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(k, ("you fool " if k % 2 else "nice day ") * 5) for k in range(8)] + [(8, "long " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id long, toxic int")
    few = dataclasses.replace(SMALL, sample=1, text_bytes=200)
    net = toxicity.fit(docs, labels, few)
    assert net.p["out"].any()  # both classes were there
    assert not toxicity.fit(docs, labels, dataclasses.replace(few, sample_bytes=5)).p["out"].any()


def test_held_out_rule(spark):
    import zlib

    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    got = {r[0]: r[1] for r in ids.select("doc_id", toxicity.held_out()).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(200)}
