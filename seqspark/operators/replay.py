"""Deterministic replay of an ordered request log: ids, ranges, prefetching and idle eviction.

Per key, requests come by (ts, tie). A gap of at least idle_timeout evicts the key's state; what it held of its ranges is
lost, the watermark stays. With a fixed step everything follows from window functions. With an adaptive step the log of
a key is folded in order; a task streams sorted keys and holds one state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.config import AllocatorConfig
from seqspark.operators.ranges import used_ids


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def sessions(requests: DataFrame, idle_timeout: timedelta) -> DataFrame:
    """requests (sequence_key, ts, tie) with sid, the number of evictions before, and rank within the session."""
    gap = f"unix_micros(ts) - lag(unix_micros(ts)) OVER (PARTITION BY sequence_key ORDER BY ts, tie) >= {_micros(idle_timeout)}"
    broken = requests.withColumn("_broken", F.coalesce(F.expr(gap), F.lit(False)).cast("int"))
    counted = broken.withColumn("sid", F.expr("sum(_broken) OVER (PARTITION BY sequence_key ORDER BY ts, tie ROWS UNBOUNDED PRECEDING)"))
    return counted.drop("_broken").withColumn("rank", F.expr("row_number() OVER (PARTITION BY sequence_key, sid ORDER BY ts, tie)"))


def session_sums(requests: DataFrame, config: AllocatorConfig) -> DataFrame:
    """sequence_key, sid, n, used, base for a fixed step: a session's requests, the ids that it reserved, and those of
    the sessions before."""
    sums = sessions(requests, config.idle_timeout).groupBy("sequence_key", "sid").agg(F.count("*").alias("n"))
    sums = sums.withColumn("used", used_ids(F.col("n"), config.default_step, config.prefetch_ratio))
    before = "coalesce(sum(used) OVER (PARTITION BY sequence_key ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return sums.withColumn("base", F.expr(before))


def replay_fixed(requests: DataFrame, config: AllocatorConfig) -> DataFrame:
    """requests with sid and id, for a step that never changes (max_step = default_step)."""
    numbered = sessions(requests, config.idle_timeout)
    n = F.expr("count(*) OVER (PARTITION BY sequence_key, sid)")
    last = F.col("rank") == F.col("_n")
    used = F.when(last, used_ids(F.col("_n"), config.default_step, config.prefetch_ratio)).otherwise(F.lit(0))
    before = "sum(_used) OVER (PARTITION BY sequence_key ORDER BY ts, tie ROWS UNBOUNDED PRECEDING)"
    placed = numbered.withColumn("_n", n).withColumn("_used", used).withColumn("_base", F.expr(before) - F.col("_used"))
    return placed.withColumn("id", F.col("_base") + F.col("rank")).drop("_n", "_used", "_base", "rank")


def discarded_fixed(requests: DataFrame, config: AllocatorConfig) -> DataFrame:
    """sequence_key, sid, discarded_active, discarded_standby of each eviction, for a fixed step."""
    sums = session_sums(requests, config)
    ended = F.expr("lead(sid) OVER (PARTITION BY sequence_key ORDER BY sid)").isNotNull()
    in_ranges = F.ceil(F.col("n") / F.lit(config.default_step)) * config.default_step
    return sums.withColumn("_ended", ended).where("_ended").select(
        "sequence_key", "sid", (in_ranges - F.col("n")).alias("discarded_active"), (F.col("used") - in_ranges).alias("discarded_standby")
    )


def next_step(active_step: Column, elapsed_ns: Column, consumed: Column, size: Column, config: AllocatorConfig) -> Column:
    """The size of the next range: doubled (from half of max_step on, max_step) if the range would be used up within
    the increase threshold, halved down to default_step if it would last for the decrease threshold, else kept."""
    step = F.greatest(active_step, F.lit(config.default_step))
    ratio = consumed.cast("double") / size.cast("double")
    lasts = F.when(ratio > 0, (elapsed_ns.cast("double") / ratio)).cast("long")
    half, most = config.max_step // 2, config.max_step
    doubled = F.when(step >= half, F.lit(most)).otherwise(step * 2)
    halved = F.greatest(F.floor(step / 2), F.lit(config.default_step))
    return (
        F.when(lasts <= _micros(config.step_increase_threshold) * 1000, doubled)
        .when(lasts >= _micros(config.step_decrease_threshold) * 1000, halved)
        .otherwise(step)
        .cast("long")
    )


@dataclass
class KeyState:
    """A key's ranges. watermark is the durable one; times are microseconds; end is 0 without an active range.

    retry_after is when the next prefetch may be tried after one has failed.
    """

    watermark: int = 0
    start: int = 0
    end: int = 0
    current: int = 0
    step: int = 0
    activated: int = 0
    standby: int = 0
    last: int = 0
    evictions: int = 0
    lost: int = 0
    retry_after: int = 0

    def _next_step(self, now: int, c: AllocatorConfig) -> int:
        step = max(self.step, c.default_step)
        size, used = self.end - self.start + 1, self.current - self.start + 1
        lasts = int((now - self.activated) * 1000 / (used / size))
        if lasts <= _micros(c.step_increase_threshold) * 1000:
            return c.max_step if step >= c.max_step // 2 else 2 * step
        if lasts >= _micros(c.step_decrease_threshold) * 1000:
            return max(step // 2, c.default_step)
        return step

    def _reserve(self, step: int) -> int:
        if self.watermark + step >= 1 << 63:
            raise OverflowError("no ids are left below 2^63")
        self.watermark += step
        self.retry_after = 0
        return self.watermark - step + 1

    def allocate(self, now: int, c: AllocatorConfig, stored: bool = True) -> int | None:
        """The next id: evict when idle, go on to the standby range or a new one, prefetch when enough is consumed.

        stored is false while the store refuses reservations. A request that needs a new range then fails: it has no id,
        and leaves the state as it was, but for an eviction. A prefetch that fails is tried again by the first request
        after reserve_timeout, or as soon as a reservation succeeds and the next range is consumed as far.
        """
        if self.end and now - self.last >= _micros(c.idle_timeout):
            self.lost += self.end - self.current + (self.watermark - self.standby + 1 if self.standby else 0)
            self.evictions += 1
            self.start = self.end = self.current = self.step = self.standby = self.retry_after = 0
        if not self.end or self.current >= self.end:
            if not self.standby:
                if not stored:
                    return None
                self.standby = self._reserve(self._next_step(now, c) if self.end else c.default_step)
            self.start, self.end, self.standby = self.standby, self.watermark, 0
            self.step, self.activated, self.current = self.end - self.start + 1, now, self.start
        else:
            self.current += 1
        if not self.standby and now >= self.retry_after and (self.current - self.start + 1) / (self.end - self.start + 1) >= c.prefetch_ratio:
            if stored:
                self.standby = self._reserve(self._next_step(now, c))
            else:
                self.retry_after = now + _micros(c.reserve_timeout)
        self.last = now
        return self.current


REPLAY = "sequence_key string, tie bigint, id bigint, active_step bigint, watermark bigint, evictions bigint, discarded bigint"


def replay(requests: DataFrame, config: AllocatorConfig) -> DataFrame:
    """sequence_key, tie, id, active_step, watermark, evictions and discarded ids so far, for each request of (sequence_key,
    ts, tie). A null key is a key of its own; requests with equal ts go by tie.

    A column reserve_ok, if there is one, says whether the store answers what a request makes the key reserve (null: it
    does); a request that fails has a null id."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), KeyState()
        names = [x.split()[0] for x in REPLAY.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 6]
        for batch in batches:
            out: list[tuple] = []
            for own, at, tie, ok in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    key, state = own, KeyState()
                out.append((own, tie, state.allocate(at, config, ok), state.step, state.watermark, state.evictions, state.lost))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ok = (F.coalesce("reserve_ok", F.lit(True)) if "reserve_ok" in requests.columns else F.lit(True)).alias("ok")
    rows = requests.select("sequence_key", F.unix_micros("ts").alias("at"), F.col("tie").cast("long").alias("tie"), ok)
    return rows.repartition("sequence_key").sortWithinPartitions("sequence_key", "at", "tie").mapInArrow(fold, REPLAY)


def idle_candidates(state: DataFrame, cutoff: Column, order: tuple[str, ...] = ("slot", "sequence_key"), most: int = 1024) -> DataFrame:
    """Of state (slot, sequence_key, last_used) the keys last used at the cutoff or before, in order, up to most."""
    return state.where(F.col("last_used") <= cutoff).orderBy(*order).limit(most)


def cleanup_run(state: DataFrame, owned: DataFrame, cursor: int, per_run: int, cutoff: Column) -> tuple[DataFrame, int]:
    """The idle keys of the next per_run owned slots from the cursor on, in a circle, and the cursor that follows. If
    there are more than one run takes, those of the slots that come first in the circle are taken.

    owned has slot; there are up to 16,384 of them, so that their order may be found in one task.
    """
    placed = owned.select("slot").distinct().withColumn("at", F.expr("row_number() OVER (ORDER BY slot)") - 1)
    n = placed.count()
    if not n:
        return state.limit(0), 0
    start, some = cursor % n, min(per_run, n)
    turn = F.pmod(F.col("at") - start, F.lit(n))
    run = F.broadcast(placed.where(turn < some).select("slot", turn.alias("turn")))
    return idle_candidates(state.join(run, "slot"), cutoff, ("turn", "sequence_key")).drop("turn"), (start + some) % n


def evict(state: DataFrame, candidates: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """What stays of state, and one row of sums: evicted, inflight, discarded_active, discarded_standby.

    state has slot, sequence_key, last_used, initialized, start, end, returned, standby_size, fetching. A candidate that
    was used since, or is fetching, stays.
    """
    joined = state.join(candidates.select("slot", "sequence_key", F.lit(True).alias("chosen")), ["slot", "sequence_key"], "left")
    due = F.coalesce("chosen", F.lit(False)) & (F.col("last_used") <= cutoff)
    gone = due & ~F.col("fetching")
    active = F.when(gone & F.col("initialized"), F.greatest(F.col("end") - F.greatest("returned", F.col("start") - 1), F.lit(0)))
    sums = joined.agg(
        F.count_if(gone).alias("evicted"),
        F.count_if(due & F.col("fetching")).alias("inflight"),
        F.coalesce(F.sum(active), F.lit(0)).alias("discarded_active"),
        F.coalesce(F.sum(F.when(gone, F.col("standby_size"))), F.lit(0)).alias("discarded_standby"),
    )
    return joined.where(~gone).drop("chosen"), sums

