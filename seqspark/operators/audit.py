"""Audits of allocated ids, and the allocator's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqspark.functions.sizes import utilization
from seqspark.sources.schemas import REASONS

#: Errors that a client may see without an audit failing.
TRANSIENT = ("UNAVAILABLE", "DEADLINE_EXCEEDED", "CANCELLED", *(REASONS[n][0] for n in (150, 151, 152, 154)))


def audit_ids(ids: DataFrame, watermarks: DataFrame | None = None) -> DataFrame:
    """sequence_key, n, n_ids, n_duplicates, max_id, n_gaps and, with watermarks, covered (the watermark is not below
    max_id), a row for each key of ids (sequence_key, id)."""
    once = ids.groupBy("sequence_key", "id").agg(F.count("*").alias("times"))
    sums = once.groupBy("sequence_key").agg(
        F.sum("times").alias("n"), F.count("*").alias("n_ids"), F.sum(F.col("times") - 1).alias("n_duplicates"), F.max("id").alias("max_id")
    )
    sums = sums.withColumn("n_gaps", F.col("max_id") - F.col("n_ids"))
    if watermarks is None:
        return sums
    own = watermarks.select("sequence_key", F.col("max_id").alias("_mark"))
    return sums.join(own, "sequence_key", "left").withColumn("covered", F.coalesce(F.col("_mark") >= F.col("max_id"), F.lit(False))).drop("_mark")


def not_increasing(ids: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ids (sequence_key, id, order) whose id is not above the one before."""
    before = f"lag(id) OVER (PARTITION BY sequence_key ORDER BY {', '.join(f'`{c}`' for c in order)})"
    return ids.withColumn("before", F.expr(before)).where("id <= before")


def unexpected_errors(results: DataFrame) -> DataFrame:
    """Rows of results with a reason that no client should see."""
    return results.where(F.col("reason").isNotNull() & ~F.col("reason").isin(*TRANSIENT))


def allocator_metrics(state: DataFrame, managed: int, limit: int, rejected: Column, scanned: Column, evicted: Column) -> DataFrame:
    """One row: cached_keys, managed_memory, memory_limit, memory_utilization, admission_rejected, cleanup_scanned and
    cleanup_evicted; the last three are aggregates over state."""
    held, most = F.lit(managed).cast("long"), F.lit(limit).cast("long")
    return state.agg(
        F.count("*").alias("cached_keys"), F.max(held).alias("managed_memory"), F.max(most).alias("memory_limit"), F.max(utilization(held, most)).alias("memory_utilization"),
        rejected.alias("admission_rejected"), scanned.alias("cleanup_scanned"), evicted.alias("cleanup_evicted"),
    )


def observed(verdicts: DataFrame) -> tuple[DataFrame, Observation]:
    """verdicts (reason) unchanged, with an observation of served and refused requests that fills when they are read."""
    seen = Observation("verdicts")
    return verdicts.observe(seen, F.count_if(F.col("reason").isNull()).alias("served"), F.count_if(F.col("reason") == REASONS[153][0]).alias("admission_rejected")), seen
