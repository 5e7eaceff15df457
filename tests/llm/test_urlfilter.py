import numpy as np
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqspark.llm import queries, urlfilter
from tests.conftest import rows
from tests.oracle import connect, same

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/a", "http://x.net?y=/", "http://anet/", "http://example.net/en/", "http://example.net/en", "http://a.Example.NET/en/x?q#f",
    "http://example.com/de/x", "http://org/fr/", "http://x.org/fr", "ftp://spam.org/a", "http://spam.net/a", "http://spamé.org", "x://y://z/p", "http://h:80/p", "http://u@spam/", "http://h#f?", "http://h/a\nb", "http://h/" + "long" * 50_000,
]


@given(st.sets(st.integers(0, 1 << 63), max_size=300), st.integers(0, 10))
def test_levels_answer_exactly(keys, tenths):
    h1 = np.array(sorted(keys), dtype=np.uint64)
    h2 = h1 * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    listed = np.arange(len(h1)) % 10 < tenths
    levels = urlfilter.build_levels(h1, h2, listed)
    assert (urlfilter.ask_levels(levels, h1, h2) == listed).all()


def test_cascade_is_smaller_than_its_keys(spark):
    hosts = spark.range(30_000).select(F.concat(F.lit("h"), "id").alias("host"), F.col("id").alias("n"), F.lit("x").alias("listed"))
    listed = hosts.where("n % 10 = 0").select("host").union(spark.createDataFrame([("elsewhere",), ("h0",), (None,)], "host string"))
    cascade, shards = urlfilter.build_cascade(hosts, "host", listed, keys_per_shard=1000)
    assert shards == 30
    assert cascade.agg(F.sum(F.octet_length("bits"))).first()[0] * 8 < 8 * 3000 * 1.5
    for limit in (1 << 26, 0):
        asked = urlfilter.in_cascade(hosts, "host", cascade, shards, "listed", limit)
        assert asked.count() == 30_000 and asked.where(F.col("listed") != (F.col("n") % 10 == 0)).count() == 0


def test_edge_urls_match_sql(spark, tmp_path):
    pages = pd.DataFrame({"page_id": range(len(URLS) * 2), "url": URLS * 2, "html": [None if k % 3 == 0 else "x" * (2000 * (k % 2)) for k in range(len(URLS))] * 2})
    extra = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "listed", "key", "h1", "shard")})
    extra.write.parquet(f"{tmp_path}/pages.parquet")
    con = connect("/root/testdata/sf0.001", pages=pages)
    same(queries.op9_urls(spark, str(tmp_path)), con, queries.ORACLE_SQL["op9_urls"])
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    large = urlfilter.judge(pages, queries.RULES, queries.thin_urls(pages), broadcast_bytes=0)
    same(large, con, queries.ORACLE_SQL["op9_urls"])


def test_rules(spark):
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(
        spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string"), queries.RULES, spark.createDataFrame([("spam.org",), ("spam.net",)], "host string"), "host").collect()}
    by_url = {u: got[k] for k, u in enumerate(URLS)}
    assert by_url["http://net"] == (None, "allow") and by_url["http://NET/a"] == ("net/", "block") and by_url["http://anet/"] == (None, "allow")
    assert by_url["http://a.Example.NET/en/x?q#f"] == ("example.net/en/", "allow") and by_url["http://example.net/en"] == ("net/", "block")
    assert by_url["ftp://spam.org/a"] == (None, "block") and by_url["http://x.org/fr"] == (None, "allow") and by_url[None] == (None, "allow")


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert rows(urlfilter.judge(none, queries.RULES, spark.createDataFrame([("x",)], "url string"))) == []
    one = spark.createDataFrame([(1, None)], "page_id long, url string")
    assert urlfilter.judge(one, queries.RULES, none.select("url")).first()["verdict"] == "allow"
    assert urlfilter.judge(one, queries.RULES, one.select("url")).first()["verdict"] == "block"


def test_rules_of_one_length(spark):
    page = spark.createDataFrame([(1, "http://a.io/b/c")], "page_id long, url string")
    none = page.select("url").limit(0)
    for rules in ([("io", "/b/c", "allow"), ("a.io", "/b", "block")], [("a.io", "/b", "block"), ("io", "/b/c", "allow")], [("a.io", "/b", "block"), ("a.io", "/b", "allow")]):
        got = urlfilter.judge(page, rules, none).first()
        assert (got["rule"], got["verdict"]) == ("a.io/b", "block")


def test_the_query_has_a_cascade_of_levels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", "html")
    cascade, _ = urlfilter.build_cascade(pages, "url", queries.thin_urls(pages))
    assert cascade.agg(F.max("level")).first()[0] >= 1 and 50 < queries.thin_urls(pages).count() < 1000


def test_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    same(queries.op9_urls(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op9_urls"])
