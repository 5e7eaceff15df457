"""The numbered operators' queries over the tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import chat, decontam, linededup, media, mixing, sharding, simhash, toxicity, urlfilter, warc
from seqspark.llm.common import stored

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(stored(media.store_audio(table(spark, sf_dir, "documents")), "audio", "zstd"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", mixing.word_count().alias("size"), F.col("doc_id").alias("row"))
    mixed = mixing.copies(rows)
    return mixed.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(conversations))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of operator 5: documents that hold all words of a benchmark window within 26 words."""
    return decontam.near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sharding.byte_size().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    k1, _ = sharding.sort_key()
    rows = docs.select("doc_id", "size", "text_crc32", k1.alias("text_hash"))
    placed = sharding.shard_by_bytes(rows, 8, F.col("size"), key=(F.col("text_hash"), F.xxhash64("doc_id")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(table(spark, sf_dir, "pages")), "warc", "uncompressed")
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def thin_urls(pages: DataFrame) -> DataFrame:
    """The urls of thin pages: those that have no page of at least 1,200 characters of html (null: none)."""
    size = F.coalesce(F.length("html"), F.lit(0))
    return pages.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.max(size).alias("size")).where("size < 1200").select("url")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is a table of urls, those of thin pages; the cascade's universe are all urls of pages."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, RULES, thin_urls(pages))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_telephony": op1_telephony,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_chat": op4_chat,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_urls": op9_urls,
    "op10_lines": op10_lines,
    "near_items": near_items,
}

OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks AS (
  SELECT *, CASE role WHEN 'system' THEN '[SYS]' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '<s>' ELSE '[ROLE]' || role || '[:]' END AS before,
    CASE role WHEN 'system' THEN '[/SYS]' WHEN 'user' THEN '[/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/ROLE]' END AS after,
    lag(role, 1, '') OVER w AS state, lead(role) OVER w IS NULL AS last
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
parts AS (
  SELECT *, length(before) + length(after) + length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + (length(text) - length(replace(text, '[SYS]', '')))//5 + (length(text) - length(replace(text, '[/SYS]', '')))//6
    + (length(text) - length(replace(text, '[INST]', '')))//6 + (length(text) - length(replace(text, '[/INST]', '')))//7
    + (length(text) - length(replace(text, '[ROLE]', '')))//6 + (length(text) - length(replace(text, '[/ROLE]', '')))//7
    + (length(text) - length(replace(text, '<s>', '')))//3 + (length(text) - length(replace(text, '</s>', '')))//4
    + (length(text) - length(replace(text, '[:]', '')))//3 + (length(text) - length(replace(text, '<|endoftext|>', '')))//13 AS chars,
    CASE state WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
      WHEN 'assistant' THEN role = 'user' ELSE false END AND (NOT last OR role = 'assistant') AS ok
  FROM marks)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid
FROM parts GROUP BY conv_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, html, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS b, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d
"""

OP9_SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
thin AS (SELECT coalesce(url, '') AS url FROM pages GROUP BY 1 HAVING max(length(coalesce(html, ''))) < 1200),
l AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, url IN (SELECT url FROM thin) AS listed FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM l)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""

OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM spans),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, item, n, k FROM places JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT item, least(13, len(w)) AS n, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, list_sort(list_distinct(w[k:k + n - 1])) AS win FROM spans),
places AS (SELECT doc_id, w, k, w[k] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words)),
known AS (SELECT DISTINCT term FROM (SELECT unnest(win) AS term FROM windows)),
often AS (SELECT term, count(*) AS n FROM places JOIN known USING (term) GROUP BY term),
anchored AS (SELECT item, win, arg_min(term, (coalesce(n, 0), term)) AS anchor FROM (SELECT item, win, unnest(win) AS term FROM windows) LEFT JOIN often USING (term) GROUP BY item, win)
SELECT DISTINCT doc_id, item FROM anchored JOIN places ON term = anchor
WHERE len(list_filter(range(greatest(1, k - 25), k + 1), lambda s: list_has_all(w[s:s + 25], win))) > 0
"""

OP10_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
heavy AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, k, line, top IS NOT NULL AND doc_id < top AS gone FROM keyed LEFT JOIN heavy USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_chat": OP4_SQL, "op5_decontamination": OP5_SQL, "op8_warc": OP8_SQL, "op9_urls": OP9_SQL, "op10_lines": OP10_SQL, "near_items": NEAR_SQL}
