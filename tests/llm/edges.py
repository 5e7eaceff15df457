"""Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows, extra columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k % 9973} Straße" for k in range(30_000))
TEXTS = [
    (1, "Some plain words, and more of them."), (2, "Some plain words, and more of them."), (2, "Some plain words, and more of them."), (3, ""), (4, None), (None, "no id"),
    (None, None), (5, " \t\n\x0b\x0c\r"), (6, "one"), (7, "two words"), (8, LONG), (9, "ÄÖÜ é ñ 中文 😀\n\nline\r\nline "), (-7, "x" * 5000), (10, "\x00\x01 nul"),
]
KIND = "doc_id long, text string"


def edge_docs(spark, source=None):
    """The edge rows with columns of names that operators use themselves."""
    docs = spark.createDataFrame(TEXTS, KIND).repartition(3)
    taken = ("score", "size", "shard", "slot", "row", "key", "keys", "fp", "anchor", "data", "media", "label", "lines", "copies", "draw", "leaf", "part", "k1", "listed", "row_id", "n")
    return docs.withColumns({c: F.lit("clash") for c in taken} | {"source": F.lit(source).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
