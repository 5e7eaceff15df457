import random

import pytest

from seqspark.llm import linededup, queries
from tests.conftest import rows
from tests.llm.edges import TEXTS, edge_docs, empty_docs
from tests.oracle import connect, same

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(docs, min_chars=20, min_docs=3):
    holders = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        heavy = lambda x: len(holders.get(key(x), ())) >= min_docs
        kept = [x for x in lines if not (heavy(x) and (doc_id is None or doc_id < max(holders[key(x)])))]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def random_docs(n=120, seed=6):
    rng = random.Random(seed)
    pool = [f"A common line, number {k}, of the pool" for k in range(15)] + ["Ünïcode line of more than twenty chars", "short", "", "   padded line with twenty chars\t\r"]
    vary = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f"  {x}\t"])
    return [(k if k % 40 else None, "\n".join(vary(rng.choice(pool)) if rng.random() < 0.7 else f"a line of its own {rng.random()}" for _ in range(rng.randint(1, 12)))) for k in range(n)] + [(5, "A common line, number 3, of the pool")] * 2


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (6, 2)])
def test_matches_brute_force(spark, batches, fanout):
    docs = random_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = linededup.dedup_lines(df, batches=batches, fanout=fanout).select("doc_id", "text", "n_lines", "n_dropped")
    assert rows(got) == brute(docs)


def test_runs_are_levelled_sorted_and_compacted(spark):
    runs = linededup.LineRuns(buckets=4, fanout=2)
    for batch in ([(9, b"a"), (9, b"b")], [(8, b"a"), (7, b"c")], [(6, b"c"), (6, b"a")], [(5, b"d")]):
        runs.add(spark.createDataFrame(batch, "doc_id long, key binary"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {bytes(r["key"]): (r["n_docs"], r["top_doc"]) for r in runs.all()[0].table().collect()} == {b"a": (3, 9), b"b": (1, 9), b"c": (2, 7), b"d": (1, 5)}
    runs.add(spark.createDataFrame([(4, b"a")], "doc_id long, key binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1] and runs.levels[0][0].table().first()["top_doc"] is None
    assert runs.compact().table().where("n_docs = 4").count() == 1 and sum(map(len, runs.levels)) == 1


def test_runs_are_joined_without_an_exchange(spark):
    runs = linededup.LineRuns(buckets=4)
    for doc_id in (9, 8):
        runs.add(spark.createDataFrame([(doc_id, b"a"), (doc_id, b"b")], "doc_id long, key binary"))
    a, b = (run.table().hint("merge") for run in runs.all())
    plan = a.join(b, "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_text_of_50000_lines(spark):
    many = "\n".join(f"line number {k % 40_000} of the long text" if k % 2 else f"own {k}" for k in range(50_000))
    docs = [(1, many), (2, many), (3, "line number 1 of the long text\nanother line of its own"), (4, many.upper())]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_dropped")
    assert rows(got) == brute(docs)


def test_edge_rows_and_empty_table(spark):
    got = linededup.dedup_lines(edge_docs(spark), min_docs=2).select("doc_id", "text", "n_lines", "n_dropped")
    assert rows(got) == brute(TEXTS, min_docs=2)
    assert linededup.dedup_lines(empty_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = linededup.dedup_lines(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    same(queries.op10_lines(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op10_lines"])
