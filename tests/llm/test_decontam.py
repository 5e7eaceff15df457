import random
import re
from pathlib import Path

import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from seqspark.llm import decontam, queries
from tests.conftest import rows
from tests.llm.edges import TEXTS, edge_docs, empty_docs
from tests.oracle import connect, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    """Every window of every item tried at every place of every document."""
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for name, passage in items:
            own = split(passage)
            n = min(size, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(str(name) if name is not None else "")
        out.append((doc_id, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@given(st.text(max_size=200))
def test_words(text):
    try:
        data = text.encode()
    except UnicodeEncodeError:
        return
    assert [w.decode() for w in decontam.words_of(data)] == split(text)


def random_tables(seed=3):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("abcD") + rng.choice(["", ",", "."]) for _ in range(n))
    docs = [(k, say(rng.randint(0, 60))) for k in range(60)] + TEXTS
    items = [(k, say(rng.choice([0, 1, 3, 5, 8]))) for k in range(12)] + [(None, "some plain words"), (3, docs[0][1][:20]), (50, None), (51, "word77 straße word78 Straße")]
    return docs, items


def found(df):
    return rows(df.drop("row"))


def brute_near(words, terms, within):
    """First places of the shortest stretches that hold all terms, each stretch tried."""
    spans = [(a, b) for a in range(len(words)) for b in range(a + 1, min(len(words), a + within) + 1) if set(terms) <= set(words[a:b])]
    return {a for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)}


def test_phrases_match_brute_force(spark):
    docs, items = random_tables()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items * 3, "item_id long, text string")
    short = [(d, t if len(t or "") < 10_000 else t[:400]) for d, t in docs]
    df = df.withColumn("text", decontam.F.when(decontam.F.length("text") >= 10_000, decontam.F.substring("text", 1, 400)).otherwise(decontam.F.col("text")))
    got = decontam.contamination(df, bench, size=4)
    assert found(got) == brute(short, items, 4)
    in_blocks = decontam.contamination(df, bench, size=4, block_bytes=40)
    assert rows(in_blocks) == rows(got)
    words = {w.encode() for _, t in items for w in split(t)}
    assert rows(decontam.contamination(df, bench, size=4, vocabulary=words)) == rows(got)


def stored_tables(monkeypatch):
    """The names and paths of the tables that decontam stores from now on."""
    made, stored = [], decontam.stored

    def store(df, name, *how, **options):
        made.append((name, (out := stored(df, name, *how, **options))._stored_path))
        return out

    monkeypatch.setattr(decontam, "stored", store)
    return made


def row_groups(path):
    """The rows of each row group."""
    files = [pq.ParquetFile(f).metadata for f in Path(path.removeprefix("file:")).rglob("*.parquet")]
    return [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]


def test_one_block_stores_no_index_and_several_read_few_segments_at_once(spark, monkeypatch):
    docs, items = random_tables(5)
    monkeypatch.setattr(decontam.indexer, "__defaults__", (None, 50))
    monkeypatch.setattr(decontam.build_index, "__defaults__", (None, 50))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    made = stored_tables(monkeypatch)
    got = decontam.contamination(df, bench, size=4)
    assert found(got) == brute(docs, items, 4) and not made
    assert rows(decontam.contamination(df, bench, size=4, block_bytes=40)) == rows(got)
    [path] = [p for name, p in made if name == "index"]
    assert sum(groups := row_groups(path)) > 20 and max(groups) <= 4


def test_long_texts_are_searched_whole(spark):
    text = " ".join(f"w{k % 5003}" for k in range(60_000))
    items = [(1, "w5000 w5001 w5002 w0"), (2, "w1 w0"), (3, "w59999")]
    got = decontam.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=13).first()
    assert (got["n_words"], got["n_hit"], got["items"]) == (60_000, 4 * (60_000 // 5003), ["1"])


def test_segments_do_not_change_results(spark):
    docs, items = random_tables(9)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    queries_ = decontam.Queries.windows([(str(i), (t or "").encode()) for i, t in items], 4)
    small = decontam.mark(decontam.build_index(df, set(queries_.words), segment_words=50), queries_)
    large = decontam.mark(decontam.build_index(df), queries_)
    assert found(decontam.counted(small)) == found(decontam.counted(large)) and small.count() > large.count()


def test_proximity_matches_brute_force_in_any_segments(spark):
    docs, _ = random_tables(4)
    docs = [*docs[:60], (900, "b x a x c"), (901, "a a a a"), (902, "c b a c"), (902, "a"), (None, "a b c")]
    asked = [("p", "a b"), ("q", "c d b"), ("r", "zz a"), ("s", "a b c"), ("t", "a b a"), ("u", "c")]
    queries_ = decontam.Queries.windows([(n, t.encode()) for n, t in asked], 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for within in (2, 3, 5):
        want = sorted({(d, n, at) for d, t in docs for n, q in asked for at in brute_near(split(t), q.split(), within)}, key=repr)
        for words in (1, 20, 1 << 20):
            got = decontam.search_near(decontam.build_index(df.coalesce(1), segment_words=words), queries_, within)
            assert rows(got.distinct()) == want and len(want) > 100
    assert (900, "s", 0) in want


def test_near_items_store_no_index_for_one_block(spark, monkeypatch):
    docs, _ = random_tables(6)
    asked = [("p", "a b"), ("q", "c d b"), ("r", "zz a"), ("s", "a b c"), ("u", "c")]
    monkeypatch.setattr(decontam.indexer, "__defaults__", (None, 50))
    monkeypatch.setattr(decontam.build_index, "__defaults__", (None, 50))
    df, bench = spark.createDataFrame(docs[:60], "doc_id long, text string").coalesce(1), spark.createDataFrame(asked, "item_id string, text string")
    want = sorted(((d, n) for d, t in docs[:60] for n, q in asked if brute_near(split(t), q.split(), 4)), key=repr)
    made = stored_tables(monkeypatch)
    assert rows(decontam.near_items(df, bench, size=3, within=4)) == want and len(want) > 50
    assert [name for name, _ in made] == ["near"]
    assert rows(decontam.near_items(df, bench, size=3, within=4, block_bytes=4)) == want
    [path] = [p for name, p in made if name == "index"]
    assert sum(groups := row_groups(path)) > 20 and max(groups) <= 4


def test_edge_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some plain words and more of them"), (2, None)], "item_id long, text string")
    found = decontam.contamination(edge_docs(spark), bench)
    assert found.count() == len(TEXTS) and {r[0] for r in found.where("contaminated").select("doc_id").collect()} == {1, 2}
    kept = decontam.keep_clean(edge_docs(spark), bench)
    assert kept.columns == edge_docs(spark).columns and kept.count() == len(TEXTS) - 3
    assert decontam.contamination(empty_docs(spark), bench).count() == 0
    assert decontam.contamination(edge_docs(spark), bench.limit(0)).where("n_hit > 0").count() == 0


def test_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    same(queries.op5_decontamination(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op5_decontamination"])
    same(queries.near_items(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["near_items"])
