import zlib
from datetime import timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqspark.config import AllocatorConfig, Config, ConfigError, NodeConfig
from seqspark.functions import keys, sizes


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("key,slot", [("", 0), ("orders", 15854), ("sequence-key-123", 2336), ("中文", 11575), ("invoices", 12181), (None, None)])
def test_slots(spark, key, slot):
    assert one(spark, key, keys.slot_for_key) == slot


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=20), min_size=20, max_size=60))
def test_slots_are_crc32(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "k string").select("k", keys.slot_for_key(F.col("k"))).collect()
    assert all(slot == zlib.crc32(k.encode()) % 16384 for k, slot in got)


@pytest.mark.parametrize(
    "key,problem",
    [("a", None), (None, "null"), ("", "empty"), (" \t", "blank"), (" 　\u0085", "blank"), ("​", None), ("a" * 256, None), ("a" * 257, "too_long"), ("é" * 129, "too_long"), ("é" * 128, None), (" a ", None)],
)
def test_key_problems(spark, key, problem):
    assert one(spark, key, keys.key_problem) == problem


@pytest.mark.parametrize("value,want", [(None, "d"), ("", "d"), (" \t", "d"), (" a b ", "a b")])
def test_defaults(spark, value, want):
    assert one(spark, value, lambda c: keys.or_default(c, "d")) == want


@pytest.mark.parametrize("text,value", [("7", 7), ("+4", 4), ("-3", -3), (" 7", None), ("7 ", None), ("7\n", None), ("", None), ("bad", None), ("1.0", None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), (None, None)])
def test_integers(spark, text, value):
    assert one(spark, text, keys.parse_int64) == value


@pytest.mark.parametrize(
    "text,size",
    [("67108864", 1 << 26), ("64MiB", 1 << 26), ("1GiB", 1 << 30), ("2TiB", 2 << 40), ("1024KiB", 1 << 20), (" 64MiB ", 1 << 26), ("", None), ("auto", None), ("64MB", None), ("1.5GiB", None), ("-1", None),
     ("18446744073709551615TiB", None), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), ("00000000000000000000000007B", 7), ("7 B", None), (None, None)],
)
def test_sizes(spark, text, size):
    got = one(spark, text, sizes.parse_size)
    assert (None if got is None else int(got)) == size


@pytest.mark.parametrize("size,problem", [("64MiB", None), ("67108863", "too_small"), ("0", "too_small"), ("9223372036854775806", None), ("9223372036854775807", "unlimited"), ("x", "invalid")])
def test_limits(spark, size, problem):
    assert one(spark, size, lambda c: sizes.limit_problem(sizes.parse_size(c))) == problem


def test_memory(spark):
    df = spark.createDataFrame([(100, 30), (30, 30), (30, 40)], "t long, r long")
    assert [r[0] for r in df.select(sizes.managed_memory(F.col("t"), F.col("r"))).collect()] == [70, 0, 0]
    df = spark.createDataFrame([(45, 100), (45, 0), (45, 2**63 - 1)], "m long, l long")
    assert [r[0] for r in df.select(sizes.utilization(F.col("m"), F.col("l"))).collect()] == [0.45, 0.0, 0.0]


@pytest.mark.parametrize(
    "config,env,cgroup,system,want",
    [("512MiB", "1GiB", 1 << 31, 1 << 32, (512 << 20, "configuration")), (None, "1GiB", 1 << 31, 1 << 32, (1 << 30, "environment")), (None, None, 1 << 31, 1 << 32, (int((1 << 31) * 0.8), "cgroup")),
     (None, None, 1 << 32, 1 << 32, (int((1 << 32) * 0.8), "cgroup")), (None, None, 1 << 33, 1 << 32, (int((1 << 32) * 0.8), "system")), (None, "auto", None, 1 << 32, (int((1 << 32) * 0.8), "system")),
     (None, None, None, 2**63 - 1, (None, None)), ("auto", "1GiB", 0, 1 << 30, (int((1 << 30) * 0.8), "system")), ("bad", None, 1 << 31, None, (None, None)), ("1MiB", None, 1 << 31, None, (None, None))],
)
def test_configured_limit(spark, config, env, cgroup, system, want):
    df = spark.createDataFrame([(config, env, cgroup, system)], "c string, e string, g long, s long")
    limit, source = sizes.configured_limit(*[F.col(c) for c in "cegs"], F.lit(0.8))
    got = df.select(limit.cast("long"), source).first()
    assert tuple(got) == want


def test_config_defaults_and_bounds():
    c = Config.of({"node": {"node_id": "n"}}).allocator
    assert (c.default_step, c.max_step, c.prefetch_ratio, c.idle_timeout, c.cleanup_slots_per_run) == (100, 10_000, 0.5, timedelta(hours=24), 64)
    bad = [
        {"default_step": 0}, {"default_step": 11, "max_step": 10}, {"prefetch_ratio": 0.0}, {"prefetch_ratio": 1.0}, {"step_increase_threshold": timedelta(0)}, {"step_decrease_threshold": timedelta(minutes=15)},
        {"reserve_timeout": timedelta(0)}, {"idle_timeout": timedelta(0)}, {"cleanup_interval": timedelta(0)}, {"cleanup_slots_per_run": 0}, {"cleanup_slots_per_run": 16385},
        {"memory_high_watermark_ratio": 1.0}, {"idle_timeout": timedelta(milliseconds=1)},
    ]
    for settings_ in bad:
        with pytest.raises(ConfigError):
            AllocatorConfig(**settings_).validate()
    for node in ({"node_id": ""}, {"node_id": " "}, {"node_id": "n" * 257}, {"node_id": "n", "heartbeat_timeout_ticks": 1}, {"node_id": "n", "heartbeat_ticks": 0}, {"node_id": "n", "route_query_timeout": timedelta(0)}):
        with pytest.raises(ConfigError):
            NodeConfig(**node).validate()
    for unknown in ({"allocator": {"step": 5}, "node": {"node_id": "n"}}, {"other": {}, "node": {"node_id": "n"}}):
        with pytest.raises(ConfigError):
            Config.of(unknown)
