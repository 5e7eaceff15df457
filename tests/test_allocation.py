import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqspark.config import AllocatorConfig
from seqspark.operators import allocate, audit, ranges, replay
from seqspark.sources.store import FolderRoutes, FolderWatermarks
from tests.conftest import rows

BASE = datetime(2024, 1, 1)
KIND = "sequence_key string, ts timestamp, tie long"


def log(seed=1, n=800, keys=("a", "b", "hot", None)):
    rng = random.Random(seed)
    return [(rng.choice([*keys, "hot"]), BASE + timedelta(minutes=rng.randint(0, 60 * 200)), k) for k in range(n)]


def walk(requests, config):
    """The replay, a request at a time; ranges are lists, reservations a counter."""
    out, held = [], {}
    us = lambda t: (t - BASE) // timedelta(microseconds=1)
    for key, ts, tie in sorted(requests, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        s = held.setdefault(key, {"mark": 0, "active": None, "standby": None, "last": None, "lost": 0, "gone": 0})

        def reserve(step, s=s):
            s["mark"] += step
            return (s["mark"] - step + 1, s["mark"])

        def step(s=s, ts=ts):
            lo, hi = s["active"]
            size, used = hi - lo + 1, s["cur"] - lo + 1
            own = max(s["step"], config.default_step)
            lasts = int(us(ts) * 1000 - s["at"] * 1000) / (used / size)
            if lasts <= config.step_increase_threshold / timedelta(microseconds=1) * 1000:
                return config.max_step if own >= config.max_step // 2 else own * 2
            if lasts >= config.step_decrease_threshold / timedelta(microseconds=1) * 1000:
                return max(own // 2, config.default_step)
            return own

        if s["active"] and ts - s["last"] >= config.idle_timeout:
            s["lost"] += s["active"][1] - s["cur"] + (s["standby"][1] - s["standby"][0] + 1 if s["standby"] else 0)
            s["gone"] += 1
            s["active"] = s["standby"] = None
            s["step"] = 0
        if not s["active"] or s["cur"] == s["active"][1]:
            new = s["standby"] or reserve(step() if s["active"] else config.default_step)
            s.update(active=new, standby=None, step=new[1] - new[0] + 1, at=us(ts), cur=new[0])
        else:
            s["cur"] += 1
        lo, hi = s["active"]
        if not s["standby"] and (s["cur"] - lo + 1) / (hi - lo + 1) >= config.prefetch_ratio:
            s["standby"] = reserve(step())
        s["last"] = ts
        out.append((key, tie, s["cur"], s["step"], s["mark"], s["gone"], s["lost"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("calls,want", [([("orders", 1, 10), ("orders", 2, 10), ("orders", 3, 5), ("other", 1, 3)], {("orders", 1, 10), ("orders", 11, 20), ("orders", 21, 25), ("other", 1, 3)}), ([("", 1, 1), ("k", 1, 0), ("k", 2, None), (None, 1, 1)], set())])
def test_reservations(spark, calls, want):
    got = ranges.reserve(spark.createDataFrame(calls, "sequence_key string, seq long, step long"))
    assert {(r["sequence_key"], r["start"], r["end"]) for r in got.collect()} == want


def test_reservation_overflow_is_an_error(spark):
    demand = spark.createDataFrame([("k", 1, 3)], "sequence_key string, seq long, step long")
    marks = spark.createDataFrame([("k", 2**63 - 3)], "sequence_key string, max_id long")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        ranges.reserve(demand, marks).collect()


def test_invalid_range_is_an_error(spark):
    bad = spark.createDataFrame([(10, 10, 10)], "s long, e long, n long")
    with pytest.raises(Exception, match="invalid range"):
        bad.select(ranges.checked_range(F.col("s"), F.col("e"), F.col("n"))).collect()


def test_store_goes_on_behind_its_watermark(spark, tmp_path):
    path = f"file://{tmp_path}/marks"
    demand = lambda *rows: spark.createDataFrame(rows, "sequence_key string, seq long, step long")
    assert rows(FolderWatermarks(spark, path).reserve(demand(("k", 1, 10))).select("start", "end")) == [(1, 10)]
    assert rows(FolderWatermarks(spark, path).reserve(demand(("k", 1, 7), ("k", 2, 7), ("j", 1, 2))).select("sequence_key", "start", "end")) == [("j", 1, 2), ("k", 11, 17), ("k", 18, 24)]
    assert rows(FolderWatermarks(spark, path).read().select("sequence_key", "max_id")) == [("j", 2), ("k", 24)]


def test_route_store(spark, tmp_path):
    store = FolderRoutes(spark, f"file://{tmp_path}/routes")
    snap = lambda v, p: spark.createDataFrame([(v, p)], "version long, payload string")
    store.publish(snap(1, "one"))
    store.publish(snap(2, "two"))
    store.publish(snap(2, "again"))
    assert [tuple(r)[:2] for r in store.newer(0).collect()] == [(2, "two")] and store.newer(2).count() == 0


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_ordered_allocation(spark, hot_rows):
    data = log(3)
    df = spark.createDataFrame(data, KIND).repartition(5)
    marks = spark.createDataFrame([("a", 100)], "sequence_key string, max_id long")
    got = rows(allocate.allocate_ordered(df, ["ts", "tie"], marks, hot_rows, 4).select("sequence_key", "tie", "id"))
    seen, want = {}, []
    for key, _, tie in sorted(data, key=lambda r: (r[1], r[2])):
        seen[key] = seen.get(key, 100 if key == "a" else 0) + 1
        want.append((key, tie, seen[key]))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("step,ratio,n,mark", [(10, 0.5, 1, 10), (10, 0.5, 4, 10), (10, 0.5, 5, 20), (10, 0.6, 5, 10), (10, 0.6, 6, 20), (10, 0.5, 10, 20), (10, 0.5, 11, 20), (10, 0.5, 15, 30)])
def test_prefetch_moves_the_watermark(spark, step, ratio, n, mark):
    assert spark.range(1).select(ranges.used_ids(F.lit(n), step, ratio)).first()[0] == mark
    c = AllocatorConfig(default_step=step, max_step=step, prefetch_ratio=ratio)
    state = replay.KeyState()
    ids = [state.allocate(k, c) for k in range(n)]
    assert ids == list(range(1, n + 1)) and state.watermark == mark


@pytest.mark.parametrize("minutes,active,most,want", [(5, 20, 100, 40), (5, 80, 100, 100), (10, 20, 100, 20), (20, 40, 100, 20), (20, 10, 100, 10)])
def test_step_table(spark, minutes, active, most, want):
    c = AllocatorConfig(default_step=10, max_step=most)
    got = spark.range(1).select(replay.next_step(F.lit(active), F.lit(minutes * 60 * 10**9).cast("long"), F.lit(5), F.lit(10), c))
    assert got.first()[0] == want
    state = replay.KeyState(start=1, end=10, current=5, step=active)
    assert state._next_step(minutes * 60 * 10**6, c) == want


ADAPTIVE = AllocatorConfig(default_step=2, max_step=16, step_increase_threshold=timedelta(hours=2), step_decrease_threshold=timedelta(hours=6), idle_timeout=timedelta(hours=10))


@pytest.mark.parametrize("config", [ADAPTIVE, AllocatorConfig(default_step=5, max_step=5, idle_timeout=timedelta(hours=3)), AllocatorConfig(default_step=3, max_step=100, prefetch_ratio=0.9)])
def test_replay_matches_a_walk(spark, config):
    data = log(7)
    got = rows(replay.replay(spark.createDataFrame(data, KIND).repartition(6), config))
    assert got == walk(data, config)


def test_fixed_replay_matches_a_walk_and_the_invariants(spark):
    config = AllocatorConfig(default_step=5, max_step=5, idle_timeout=timedelta(hours=3))
    data = [r for r in log(9, 1500) if r[0] is not None]
    df = spark.createDataFrame(data, KIND)
    got = replay.replay_fixed(df, config)
    want = walk(data, config)
    assert rows(got.select("sequence_key", "tie", "id")) == sorted([w[:3] for w in want], key=repr)
    lost = {}
    for key, *_, total in want:
        lost[key] = max(lost.get(key, 0), total)
    sums = replay.discarded_fixed(df, config).groupBy("sequence_key").agg(F.sum(F.col("discarded_active") + F.col("discarded_standby")))
    assert dict(rows(sums)) == {k: n for k, n in lost.items() if n}
    marks = replay.session_sums(df, config).groupBy("sequence_key").agg(F.sum("used").alias("max_id"))
    audited = audit.audit_ids(got, marks)
    assert audited.where("n_duplicates > 0 OR NOT covered").count() == 0
    assert audit.not_increasing(got, ["ts", "tie"]).count() == 0


def test_idle_boundary(spark):
    config = AllocatorConfig(default_step=10, max_step=10, idle_timeout=timedelta(minutes=10))
    data = [("k", BASE, 0), ("k", BASE + timedelta(minutes=10), 1), ("j", BASE, 2), ("j", BASE + timedelta(minutes=9, seconds=59), 3)]
    got = rows(replay.replay_fixed(spark.createDataFrame(data, KIND), config).select("sequence_key", "tie", "id"))
    assert got == [("j", 2, 1), ("j", 3, 2), ("k", 0, 1), ("k", 1, 11)]


def test_cleanup_in_turns(spark):
    state = spark.createDataFrame([(s, f"k{s}", 0) for s in (1, 5, 9, 12)], "slot int, sequence_key string, last_used long")
    owned = state.select("slot")
    first, cursor = replay.cleanup_run(state, owned, 0, 2, F.lit(0))
    second, after = replay.cleanup_run(state, owned, cursor, 2, F.lit(0))
    assert [r["slot"] for r in first.collect()] == [1, 5] and [r["slot"] for r in second.collect()] == [9, 12] and after == 0
    assert replay.cleanup_run(state, owned.limit(0), 0, 2, F.lit(0))[0].count() == 0


def test_cleanup_takes_the_slots_that_come_first_in_the_circle(spark):
    keys = [(12, f"k{k}", 0) for k in range(1500)] + [(1, f"first{k}", 0) for k in range(3)] + [(5, "later", 0)]
    state = spark.createDataFrame(keys, "slot int, sequence_key string, last_used long")
    owned = spark.createDataFrame([(1,), (5,), (9,), (12,)], "slot int")
    run, cursor = replay.cleanup_run(state, owned, 3, 2, F.lit(0))
    assert {r["slot"] for r in run.collect()} == {12} and run.count() == 1024 and cursor == 1
    some = replay.cleanup_run(state.where("sequence_key <> 'k0' AND (slot <> 12 OR sequence_key = 'k1')"), owned, 3, 2, F.lit(0))[0]
    assert [r["slot"] for r in some.collect()] == [12, 1, 1, 1]


def test_a_failed_prefetch_waits_and_a_failed_request_has_no_id(spark):
    c = AllocatorConfig(default_step=10, max_step=10, prefetch_ratio=0.5)  # reserve_timeout is a second
    at = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    data = [("k", BASE + timedelta(milliseconds=t), t, t == 0) for t in at]
    kind = KIND + ", reserve_ok boolean"
    got = rows(replay.replay(spark.createDataFrame(data, kind).repartition(3), c).select("tie", "id", "watermark"))
    assert got == sorted([(t, t + 1 if t < 10 else None, 10) for t in at], key=repr)
    # Within the second a prefetch is not tried again, though the store would answer; after it, it is.
    data = [("k", BASE + timedelta(milliseconds=t), n, n != 4) for n, t in enumerate([0, 1, 2, 3, 4, 5, 1003, 1004, 1005])] + [("k", BASE + timedelta(hours=30), 9, None)]
    got = rows(replay.replay(spark.createDataFrame(data, kind), c).select("tie", "id", "watermark", "evictions"))
    assert [r[2] for r in got] == [10] * 7 + [20] * 2 + [30] and [r[1] for r in got] == [*range(1, 10), 21] and got[-1][3] == 1


def test_eviction_counts(spark):
    kind = "slot int, sequence_key string, last_used long, initialized boolean, start long, end long, returned long, standby_size long, fetching boolean"
    state = spark.createDataFrame([(1, "a", 5, True, 1, 10, 3, 20, False), (1, "busy", 5, True, 1, 10, 3, 20, True), (2, "used", 50, True, 1, 10, 3, 0, False), (2, "new", 0, False, 0, 0, 0, 0, False)], kind)
    left, sums = replay.evict(state, state.select("slot", "sequence_key"), F.lit(5))
    assert tuple(sums.first()) == (2, 1, 7, 20) and {r["sequence_key"] for r in left.collect()} == {"busy", "used"}


def test_verdicts(spark):
    df = spark.createDataFrame([(True, True, True), (False, None, True), (False, False, True), (False, True, False), (False, True, True)], "p boolean, o boolean, a boolean")
    got = [r[0] for r in df.select(allocate.fetch_verdict(F.col("p"), F.col("o"), F.col("a"))).collect()]
    assert got == ["SEQUENCE_ALLOCATOR_PAUSED", "SEQUENCE_SLOT_NOT_OWNER", "SEQUENCE_SLOT_NOT_OWNER", "SEQUENCE_CAPACITY_EXHAUSTED", None]
    df = spark.createDataFrame([("",), (None,), ("bad",), ("2",), ("1",), ("3",)], "v string")
    got = [r[0] for r in df.select(allocate.service_verdict(F.lit("SEQUENCE_SLOT_NOT_OWNER"), F.col("v"), F.lit(2))).collect()]
    assert got == ["INVALID_ARGUMENT"] * 3 + ["SEQUENCE_ROUTE_EXPIRED"] * 2 + ["RETRY"]
    df = spark.createDataFrame([(True, 90, 100), (True, 89, 100), (False, 95, 100), (True, 95, 0), (True, 95, 2**63 - 1)], "n boolean, m long, l long")
    assert [r[0] for r in df.select(allocate.admitted(F.col("n"), F.col("m"), F.col("l"), 0.9)).collect()] == [False, True, True, True, True]
    df = spark.createDataFrame([("SEQUENCE_ROUTE_EXPIRED", None), (None, "UNAVAILABLE"), (None, None), ("SEQUENCE_CAPACITY_EXHAUSTED", "RESOURCE_EXHAUSTED")], "r string, c string")
    assert [r[0] for r in df.select(allocate.retryable(F.col("r"), F.col("c"))).collect()] == [True, True, False, False]


def test_metrics_are_observed(spark):
    df = spark.createDataFrame([(None,), ("SEQUENCE_CAPACITY_EXHAUSTED",), (None,)], "reason string")
    watched, seen = audit.observed(df)
    watched.collect()
    assert seen.get == {"served": 2, "admission_rejected": 1}
    assert audit.unexpected_errors(df.union(spark.createDataFrame([("INTERNAL",), ("UNAVAILABLE",)], "reason string"))).count() == 2


def test_ids_in_ranges(spark):
    ids = spark.createDataFrame([("k", i) for i in range(1, 40)] + [("j", 5)], "sequence_key string, id long")
    some = spark.createDataFrame([("k", 1, 10), ("k", 11, 25), ("j", 1, 4)], "sequence_key string, start long, end long")
    got = ranges.ids_in_ranges(ids, some, 7)
    assert rows(got) == sorted([("k", i, 1, 10) for i in range(1, 11)] + [("k", i, 11, 25) for i in range(11, 26)], key=repr)
