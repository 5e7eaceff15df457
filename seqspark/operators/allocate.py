"""Allocation of strictly increasing ids per key, and the verdicts on requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.keys import parse_int64
from seqspark.sources.schemas import REASONS
from seqspark.sources.shared import stored


def allocate_ordered(requests: DataFrame, order: list[str], watermarks: DataFrame | None = None, hot_rows: int = 1_000_000, hot_parts: int | None = None) -> DataFrame:
    """requests with id: 1, 2, ... per sequence_key in the given order, from the key's watermark if there is one.

    order must tell all rows of a key apart. Keys of up to hot_rows rows are numbered by a window. The few hotter ones
    (their number is at most the rows' divided by hot_rows) are sorted into ranges of (key, order); a row's id is the
    number of the key's rows in the ranges before plus its place in its own. So no key has to fit into a task.
    """
    counts = requests.groupBy("sequence_key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = [r["sequence_key"] for r in counts.collect()]
    window = f"row_number() OVER (PARTITION BY sequence_key ORDER BY {', '.join(f'`{c}`' for c in order)})"
    if not hot:
        numbered = requests.withColumn("id", F.expr(window).cast("long"))
    else:
        names = F.broadcast(requests.sparkSession.createDataFrame([(k,) for k in hot], "sequence_key string"))
        cold = requests.join(names, requests.sequence_key.eqNullSafe(names.sequence_key), "left_anti").withColumn("id", F.expr(window).cast("long"))
        some = requests.join(names, requests.sequence_key.eqNullSafe(names.sequence_key), "left_semi")
        parts = hot_parts or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = some.repartitionByRange(parts, "sequence_key", *order).sortWithinPartitions("sequence_key", *order)
        dealt = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "hot")
        ranges = dealt.groupBy("sequence_key", F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
        before = "coalesce(sum(n) OVER (PARTITION BY sequence_key ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        offsets = F.broadcast(ranges.withColumn("_before", F.expr(before)).drop("n").withColumnRenamed("sequence_key", "_key"))
        placed = dealt.join(offsets, dealt.sequence_key.eqNullSafe(offsets["_key"]) & (F.shiftright("_place", 33) == F.col("_part")))
        numbered = cold.unionByName(placed.select(*requests.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("id")))
    if watermarks is None:
        return numbered
    base = watermarks.select("sequence_key", F.col("max_id").alias("_base"))
    return numbered.join(base, "sequence_key", "left").withColumn("id", F.col("id") + F.coalesce("_base", F.lit(0))).drop("_base").select(*requests.columns, "id")


def admitted(is_new: Column, managed: Column, limit: Column, ratio: float) -> Column:
    """Whether a key may be served: known keys always, new ones while managed memory is below ratio of the limit. No
    limit (0 or the largest integer) admits all."""
    none = (limit <= 0) | (limit >= F.lit((1 << 63) - 1))
    return ~is_new | none | (managed.cast("double") < limit.cast("double") * F.lit(ratio))


def fetch_verdict(paused: Column, owned: Column, allowed: Column) -> Column:
    """The reason that refuses an allocation, in the order of the checks; null if it is served."""
    return F.when(paused, REASONS[150][0]).when(~F.coalesce(owned, F.lit(False)), REASONS[151][0]).when(~allowed, REASONS[153][0])


def service_verdict(verdict: Column, client_version: Column, cached_version: Column) -> Column:
    """A request's answer at the service. A slot that is not owned is an invalid request without a readable client
    version, an expired route if the client's is not newer than the node's, else a retry after the node catches up."""
    version = parse_int64(client_version)
    refused = F.when(version.isNull(), "INVALID_ARGUMENT").when(version <= cached_version, REASONS[152][0]).otherwise("RETRY")
    return F.when(verdict == REASONS[151][0], refused).otherwise(verdict)


def retryable(reason: Column, code: Column) -> Column:
    """Whether a client refreshes its route and asks once more."""
    return F.coalesce(reason.isin(REASONS[151][0], REASONS[152][0]), F.lit(False)) | F.coalesce(code == "UNAVAILABLE", F.lit(False))
