import time

import pandas as pd
import zstandard

from seqspark.llm import queries, warc
from tests.conftest import rows
from tests.oracle import connect, same

PAGES = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, "http://c/\r\nX-Bad: 1", "same"), (2, "http://c/", "same"), (4, None, None), (5, "u\x00%41\x7f\n", ""), (6, "u", "x" * 300_000), (None, "u", "same"), (7, "u", "é\r\n\r\nWARC/1.1")]
KIND = "page_id long, url string, html string"


def edge_pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, KIND).withColumns({c: F.lit("clash") for c in ("payload_digest", "first_id", "refers_to", "n", "archive")})


def test_edge_rows(spark):
    got = rows(warc.read_archives(warc.write_archives(edge_pages(spark), archive_bytes=1000), payloads=True))
    want = []
    first = {"same": 1, "": 4}
    for page_id, url, html in PAGES:
        html = html or ""
        refers = first[html] if html in first and page_id is not None and page_id > first[html] else None
        kept = None if refers is not None else html.encode()
        want.append((page_id, url, "response" if refers is None else "revisit", len(html.encode()), warc.digest_of(html.encode()), refers, kept))
    got = [(*r[:6], bytes(r[6]) if r[6] is not None else None) for r in got]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_small_payloads_are_responses(spark):
    got = warc.read_archives(warc.write_archives(edge_pages(spark), min_bytes=5))
    assert got.where("record_type = 'revisit'").count() == 0


def test_archives_begin_with_their_dictionary():
    records = [warc.record(k, f"http://h/{k}", b"<html><body>common text and number %d</body></html>" % k * 30, "D", None) for k in range(300)]
    data = warc.archive(records, 1 << 14, 3, 1 << 18)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    own = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert own.dict_id() and list(warc.records_of(data)) == records
    frames = data[8 + size :]
    assert int.from_bytes(frames[:4], "little") == warc.FRAME
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(frames) < alone
    assert list(warc.records_of(warc.archive(records[:1], 1 << 14, 3, 1 << 18))) == records[:1]


def test_samples_are_spread_over_the_archive():
    """The last records are unlike the first ones; the dictionary helps them too."""
    records = [b"first kind %d " % k * 40 for k in range(2000)] + [b"<p>another sort of record, number %d</p>" % k for k in range(2000)]
    data = warc.archive(records, 1 << 14, 3, 1 << 17)
    size = int.from_bytes(data[4:8], "little")
    assert b"another sort" in data[8 : 8 + size] and list(warc.records_of(data)) == records


def test_reading_takes_time_in_proportion():
    def seconds(n):
        data = warc.archive([b"record %d with some text" % k for k in range(n)], 1 << 12, 3, 1 << 16)
        began = time.perf_counter()
        assert sum(1 for _ in warc.records_of(data)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 16 * seconds(5_000)


def test_export(spark, tmp_path):
    archives = warc.write_archives(edge_pages(spark).coalesce(1))
    warc.export(archives, tmp_path.as_uri())
    files = list(tmp_path.glob("*.warc.zst"))
    assert len(files) == archives.count() and sum(len(list(warc.records_of(f.read_bytes()))) for f in files) == len(PAGES)


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], KIND))).count() == 0


def test_matches_sql(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    same(queries.op8_warc(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op8_warc"])
    unique = pd.DataFrame([p for p in PAGES if p[0] is not None and p != (2, "http://c/", "same")], columns=["page_id", "url", "html"])
    spark.createDataFrame(unique, KIND).write.parquet(f"{tmp_path}/pages.parquet")
    same(queries.op8_warc(spark, str(tmp_path)), connect(sf_dir, pages=unique), queries.ORACLE_SQL["op8_warc"])
