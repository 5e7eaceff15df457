"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys, bucketed by key and sorted within a bucket, with the number of documents that hold the key
and, in the run that saw the key first, the largest of them. Batches of documents come in descending order of doc_id.
Each new batch is anti-joined with the runs, bucket by bucket: the keys that are left are new, and their largest document
is in this batch; the others only add to the count. The batch then becomes a run of level 0. When a level has fanout
runs, they are merged into one of the next level, again bucket by bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import ASCII_SPACE, Bucketed, ascii_lower, bucketed, discard, stored

RUN = ("key", "n_docs", "top_doc")


def lines_of(text: str = "text") -> Column:
    """The text split at \\n; one empty line for null or empty."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the line's key; null if it has under min_chars code points."""
    stripped = F.btrim(line, F.lit(ASCII_SPACE))
    return F.when(F.length(stripped) >= min_chars, F.unhex(F.md5(ascii_lower(stripped).cast("binary"))))


def _summed(own: str, other: str) -> list[Column]:
    """The columns of two runs joined by key as one: counts add up, and at most one of them names a largest document."""
    n = F.coalesce(f"{own}.n_docs", F.lit(0)) + F.coalesce(f"{other}.n_docs", F.lit(0))
    return [F.coalesce(f"{own}.key", f"{other}.key").alias("key"), n.alias("n_docs"), F.coalesce(f"{own}.top_doc", f"{other}.top_doc").alias("top_doc")]


class LineRuns:
    """The runs, by level. Batches must be added in descending order of doc_id, null last.

    All runs have the same number of buckets, so that neither the anti-joins nor the merges move a run's rows.
    """

    def __init__(self, buckets: int, fanout: int = 3) -> None:
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[Bucketed]] = []

    def all(self) -> list[Bucketed]:
        return [run for level in self.levels for run in level]

    def _put(self, run: DataFrame, level: int) -> None:
        while level >= len(self.levels):
            self.levels.append([])
        self.levels[level].append(bucketed(run.select(*RUN), self.buckets, "key", f"run{level}"))

    def _merge(self, runs: list[Bucketed], level: int) -> None:
        merged = reduce(lambda a, b: a.alias("a").join(b.alias("b"), "key", "full_outer").select(*_summed("a", "b")), [run.table() for run in runs])
        self._put(merged, level)
        for run in runs:
            run.discard()

    def add(self, pairs: DataFrame) -> None:
        """Add a batch of doc_id, key pairs. Their key counts are made before they are dealt to the buckets."""
        own = pairs.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("top_doc"))
        if self.levels:
            batch = bucketed(own, self.buckets, "key", "batch")
            first = [run.table().where("top_doc IS NOT NULL").select("key") for run in self.all()]
            new = reduce(lambda left, run: left.join(run, "key", "left_anti"), first, batch.table())
            again = batch.table().join(new.select("key"), "key", "left_anti").withColumn("top_doc", F.lit(None).cast("long"))
            self._put(new.unionByName(again), 0)
            batch.discard()
        else:
            self._put(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._merge(runs, level + 1)
            level += 1

    def compact(self) -> Bucketed:
        """All runs merged into one; at least one batch was added."""
        if len(self.all()) > 1:
            runs, depth, self.levels = self.all(), len(self.levels), [[] for _ in self.levels]
            self._merge(runs, depth)
        return self.all()[0]


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """doc_id, own (a hash of the text), lost: for each row the places (from 0) of the lines that it loses, ascending.

    docs has doc_id, own and text. Rows that lose nothing are left out.
    """
    spark = docs.sparkSession
    each = F.posexplode(F.transform(lines_of(), lambda x: key_hash(x, min_chars))).alias("place", "key")
    pairs = stored(docs.select("doc_id", "own", each).where("key IS NOT NULL"), "lines")
    at = [k / batches for k in range(batches - 1, 0, -1)]
    bounds = [None, *sorted({int(x) for x in docs.approxQuantile("doc_id", at, 0.01)}, reverse=True), None] if at else [None, None]
    runs = LineRuns(int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for above, least in zip(bounds, bounds[1:], strict=False):
        batch = pairs if above is None else pairs.where((F.col("doc_id") < above) | F.col("doc_id").isNull())
        runs.add(batch if least is None else batch.where(F.col("doc_id") >= least))
    merged = runs.compact()
    heavy = merged.files().where(F.col("n_docs") >= min_docs).select("key", "top_doc")
    lost = pairs.join(heavy, "key").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("top_doc")))
    out = stored(lost.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("place")).alias("lost")), "lost")
    merged.discard()
    discard(pairs)
    return out


def without(lines: Column, ends: Column) -> Column:
    """The array without the elements at the places ends, ascending, which begin with -1 and end with the array's size:
    the stretches between them, put together. Both must be columns, not expressions, as each stretch reads them anew."""
    between = F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda k: F.slice(lines, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))
    return F.flatten(between)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """doc_id, text (the kept lines), n_lines and n_dropped, a row for each row of docs.

    Keys of at least min_chars code points that at least min_docs documents hold lose all their lines, except in the
    largest doc_id that holds the key, where all its lines stay. Rows of one doc_id are one document; rows with a null
    doc_id count as no document, and lose the lines that others keep. A null text is one empty line. Hot keys are made
    one row per task before the shuffle, and Spark splits them among the tasks of the joins. What a row loses is gathered
    by doc_id and text, so that rows without an id are not gathered into one group.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    lost = repeated_lines(rows, min_chars, min_docs, batches, fanout).withColumnsRenamed({"doc_id": "lost_id", "own": "lost_own"})
    same = (F.col("own") == F.col("lost_own")) & F.col("doc_id").eqNullSafe(F.col("lost_id"))
    split = rows.join(lost, same, "left").select("doc_id", lines_of().alias("lines"), "lost")
    ends = F.when(F.col("lost").isNotNull(), F.concat(F.array(F.lit(-1)), "lost", F.array(F.size("lines"))))
    split = split.select("doc_id", "lines", F.size("lines").cast("long").alias("n_lines"), ends.alias("ends"))
    kept = F.when(F.col("ends").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("ends")))
    done = split.select("doc_id", "n_lines", kept.alias("kept"))
    return done.select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
