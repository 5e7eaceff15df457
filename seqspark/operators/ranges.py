"""Ranges of ids: reservation against a durable watermark, the ids that prefetching leaves reserved, and range lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions.keys import key_problem


def demand_problem(key: Column, step: Column) -> Column:
    """Why a reservation is refused: a problem of the key, or bad_step; null if it is valid."""
    return F.coalesce(key_problem(key), F.when(step.isNull() | (step <= 0), "bad_step"))


def reserve(demands: DataFrame, watermarks: DataFrame | None = None) -> DataFrame:
    """sequence_key, seq, step, start, end and max_id for each valid demand; demands has sequence_key, seq, step.

    Demands of a key are served by seq: each gets the next step ids, [max_id - step + 1, max_id], from the key's watermark
    or from 1. Refused demands are left out; demand_problem() names them. An id beyond 64 bits is an error (ANSI mode).
    """
    valid = demands.where(demand_problem(F.col("sequence_key"), F.col("step")).isNull())
    running = valid.withColumn("taken", F.expr("sum(step) OVER (PARTITION BY sequence_key ORDER BY seq ROWS UNBOUNDED PRECEDING)"))
    base = F.lit(0).cast("long")
    if watermarks is not None:
        running = running.join(watermarks.select("sequence_key", F.col("max_id").alias("base")), "sequence_key", "left")
        base = F.coalesce("base", base)
    top = running.withColumn("max_id", base + F.col("taken"))
    return top.select("sequence_key", "seq", "step", (F.col("max_id") - F.col("step") + 1).alias("start"), F.col("max_id").alias("end"), "max_id")


def checked_range(start: Column, end: Column, step: Column) -> Column:
    """The range as a struct; an error if a store answers with any but step ids from above 0."""
    ok = (start > 0) & (end >= start) & (end - start + 1 == step)
    return F.when(ok, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.raise_error(F.lit("the store returned an invalid range")))


def advance(watermarks: DataFrame, reserved: DataFrame, now: Column) -> DataFrame:
    """The watermarks after reservations: keys of either side, each with the larger id."""
    top = reserved.groupBy("sequence_key").agg(F.max("max_id").alias("reached"))
    both = watermarks.join(top, "sequence_key", "full_outer")
    moved = F.col("reached") > F.coalesce("max_id", F.lit(0))
    return both.select(
        "sequence_key", F.greatest("max_id", "reached").alias("max_id"), F.when(moved | F.col("updated_at").isNull(), now).otherwise(F.col("updated_at")).alias("updated_at")
    )


def used_ids(n: Column, step: int, prefetch_ratio: float) -> Column:
    """The ids that n allocations of one holder reserve in ranges of a fixed step: those of the ranges in use, and one
    range more once prefetch_ratio of the last is consumed."""
    ranges = F.ceil(n / F.lit(step))
    consumed = n - (ranges - 1) * step
    return (ranges + F.when(consumed / F.lit(step) >= prefetch_ratio, 1).otherwise(0)) * F.lit(step)


def ids_in_ranges(ids: DataFrame, ranges: DataFrame, bucket: int = 1000) -> DataFrame:
    """Each of ids (sequence_key, id) with start and end of the ranges (sequence_key, start, end) that hold it.

    An equi-join on the key and on id div bucket: a range is found in each bucket that it touches, so that a key with
    many ids and ranges is spread over its buckets. bucket should be about a range's size.
    """
    of_range = ranges.select(F.col("sequence_key"), "start", "end", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"end div {bucket}"))).alias("bucket"))
    of_id = ids.withColumn("bucket", F.expr(f"id div {bucket}"))
    return of_id.join(of_range, ["sequence_key", "bucket"]).where(F.col("id").between(F.col("start"), F.col("end"))).drop("bucket")
