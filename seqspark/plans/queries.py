"""The queries over the driver's tables. Routes and other literal inputs are generated on both sides."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.config import AllocatorConfig
from seqspark.functions import keys, sizes
from seqspark.operators import allocate, audit, nodes, ranges, releases, replay, routes
from seqspark.sources.schemas import REASONS
from seqspark.sources.shared import own_path

FIXED = AllocatorConfig(default_step=10, max_step=10)
ADAPTIVE = AllocatorConfig(
    default_step=2, max_step=16, step_increase_threshold=timedelta(hours=24), step_decrease_threshold=timedelta(hours=48), idle_timeout=timedelta(hours=36)
)
STEPS = AllocatorConfig(
    default_step=10, max_step=100, step_increase_threshold=timedelta(days=100), step_decrease_threshold=timedelta(days=400)
)
#: version, when a losing node stops, when a gaining node starts.
PUBLISHED = [(1, "2024-01-03 00:00:00", "2024-01-03 06:00:00"), (2, "2024-01-12 00:00:00", "2024-01-12 06:00:00"), (3, "2024-01-22 00:00:00", "2024-01-22 06:00:00")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """The log of requests: sequence_key, ts, tie."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col(key).cast("string").alias("sequence_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"))


def route_log(spark: SparkSession) -> DataFrame:
    """version, node_id, slot of three snapshots: one node, two nodes by even and odd slots, three nodes in turn."""
    node = F.when(F.col("version") == 1, "node-a").when(F.col("version") == 2, F.element_at(F.array(F.lit("node-a"), F.lit("node-b")), F.col("slot") % 2 + 1))
    third = F.element_at(F.array(F.lit("node-a"), F.lit("node-b"), F.lit("node-c")), F.col("slot") % 3 + 1)
    slots = spark.range(keys.SLOT_COUNT).select(F.col("id").cast("int").alias("slot"), F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 2, 3)])).alias("version"))
    return slots.select("version", node.otherwise(third).alias("node_id"), "slot")


def snapshots(spark: SparkSession) -> DataFrame:
    """The snapshots as stored: version, payload."""
    owners = route_log(spark)
    return reduce(DataFrame.unionByName, [routes.publish(owners.where(F.col("version") == v), v) for v in (1, 2, 3)])


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each event's slot and node by the route of two nodes, and its id per user."""
    numbered = allocate.allocate_ordered(requests(spark, sf_dir).where(keys.key_problem(F.col("sequence_key")).isNull()), ["ts", "tie"])
    placed = numbered.withColumn("slot", keys.slot_for_key(F.col("sequence_key")))
    owners = route_log(spark).where("version = 2")
    return routes.owner_of(placed, owners).select(F.col("tie").alias("event_id"), "sequence_key", "slot", "node_id", "id")


def slot_for_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sequence_key"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("sequence_key"))
    return users.union(names).distinct().withColumn("slot", keys.slot_for_key(F.col("sequence_key")))


def slot_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    return orders.groupBy("k").agg(F.count("*").alias("n")).groupBy(keys.slot_for_key(F.col("k")).alias("slot")).agg(F.sum("n").alias("n_requests"), F.count("*").alias("n_keys"))


def key_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("row_id"), F.col("text").alias("k"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("row_id"), F.col("url").alias("k"))
    return docs.union(pages).select("kind", "row_id", keys.key_problem(F.col("k")).alias("problem"))


def allocate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hot keys; those of over 1,000 rows are numbered by ranges."""
    return allocate.allocate_ordered(requests(spark, sf_dir, "event_type"), ["ts", "tie"], hot_rows=1000).select("sequence_key", "tie", "id")


def _reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    by_order = lines.groupBy(F.col("l_suppkey").cast("string").alias("sequence_key"), F.col("l_orderkey").alias("seq"))
    demands = by_order.agg(F.sum(F.col("l_quantity").cast("long")).alias("step"))
    marks = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("sequence_key"), (F.col("s_suppkey") * 1000).alias("max_id"))
    return ranges.reserve(demands, marks)


def reserve_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reserved(spark, sf_dir).withColumn("range", ranges.checked_range(F.col("start"), F.col("end"), F.col("step"))).select(
        "sequence_key", "seq", F.col("range.start").alias("first_id"), F.col("range.end").alias("last_id")
    )


def watermark_after_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = requests(spark, sf_dir).groupBy("sequence_key").agg(F.count("*").alias("n"))
    return counts.select("sequence_key", "n", ranges.used_ids(F.col("n"), FIXED.default_step, FIXED.prefetch_ratio).alias("max_id"))


def range_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = allocate.allocate_ordered(requests(spark, sf_dir, "event_type"), ["ts", "tie"]).select("sequence_key", "id")
    top = ids.groupBy("sequence_key").agg(F.max("id").alias("n"))
    starts = top.select("sequence_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(100).cast("long"))).alias("start"))
    return ranges.ids_in_ranges(ids, starts.withColumn("end", F.col("start") + 99), 100).select("sequence_key", "id", F.col("start").alias("first_id"), F.col("end").alias("last_id"))


def idle_gap_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_fixed(requests(spark, sf_dir), FIXED).select("sequence_key", "tie", "sid", "id")


def idle_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.discarded_fixed(requests(spark, sf_dir), FIXED)


def step_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    gaps = orders.withColumn("elapsed_us", F.expr("at - lag(at) OVER (PARTITION BY o_custkey ORDER BY at, o_orderkey)")).where("elapsed_us IS NOT NULL")
    active = (F.lit(10) * F.pow(F.lit(2), F.pmod("o_orderkey", F.lit(5)))).cast("long")
    step = replay.next_step(active, F.col("elapsed_us") * 1000, F.pmod("o_orderkey", F.lit(9)) + 1, F.lit(10), STEPS)
    return gaps.select("o_orderkey", active.alias("active_step"), "elapsed_us", step.alias("next_step"))


def adaptive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay(requests(spark, sf_dir), ADAPTIVE)


def route_latest_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = snapshots(spark)
    asked = [routes.owners_of(routes.latest_newer(stored, known)).withColumn("known", F.lit(known).cast("long")) for known in (0, 2, 3)]
    return reduce(DataFrame.unionByName, asked)


def _broken(spark: SparkSession) -> DataFrame:
    """version, payload of a valid snapshot and of several with one fault each."""
    base = spark.range(keys.SLOT_COUNT).select(F.col("id").alias("slot"), (F.col("id") % 2).alias("entry"))
    name = F.when(F.col("entry") == 0, "node-a").otherwise("node-b")
    good = base.select("slot", "entry", name.alias("node_id"))
    extra = lambda slot, entry, node: spark.createDataFrame([(slot, entry, node)], "slot long, entry long, node_id string")
    forms = {
        10: good,
        11: good.where("slot <> 5"),
        12: good.union(extra(7, 0, "node-a")),
        13: good.union(extra(keys.SLOT_COUNT, 1, "node-b")),
        14: good.withColumn("node_id", F.when(F.col("entry") == 0, "").otherwise(F.col("node_id"))),
        15: good.withColumn("node_id", F.lit("node-a")),
        0: good,
        16: good,
    }
    out = []
    for version, form in forms.items():
        entries = form.groupBy("entry", "node_id").agg(F.array_sort(F.collect_list("slot")).alias("slots")).groupBy().agg(F.array_sort(F.collect_list(F.struct("entry", "node_id", "slots"))).alias("nodes"))
        text = F.to_json(F.struct(F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["slots"].alias("slots"))).alias("nodes")))
        out.append(entries.select(F.lit(version).cast("long").alias("version"), (F.substring(text, 1, 100) if version == 16 else text).alias("payload")))
    return reduce(DataFrame.unionByName, out)


def route_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.violations(_broken(spark))


def route_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = route_log(spark).where("node_id = 'node-b'")
    return routes.diff(owners.where("version = 2"), owners.where("version = 3"))


def route_update_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each held version, or none, is offered each version, and version 3 with the content of version 2."""
    contents = snapshots(spark)
    offers = [(held, version, content) for held in (1, 2, 3, None) for version, content in ((1, 1), (2, 2), (3, 3), (3, 2))]
    asked = spark.createDataFrame(offers, "held_version long, version long, content long")
    held = contents.select(F.col("version").alias("held_version"), F.col("payload").alias("held"))
    offered = contents.select(F.col("version").alias("content"), "payload")
    pairs = asked.join(held, "held_version", "left").join(offered, "content")
    verdict = routes.update_verdict(F.col("held_version"), F.col("held"), F.col("version"), F.col("payload"))
    return pairs.groupBy("held_version", "version", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = requests(spark, sf_dir).withColumn("slot", keys.slot_for_key(F.col("sequence_key")))
    owned = routes.owner_of(placed, route_log(spark).where("version = 3"))
    return owned.groupBy("node_id").agg(F.count("*").alias("n_requests"), F.countDistinct("sequence_key").alias("n_keys"))


def owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = spark.createDataFrame(PUBLISHED, "version long, taken string, applies string").select(
        "version", F.col("taken").cast("timestamp").alias("taken_at"), F.col("applies").cast("timestamp").alias("applies_at")
    )
    placed = requests(spark, sf_dir).withColumn("slot", keys.slot_for_key(F.col("sequence_key")))
    return routes.owner_at(placed, routes.effective(route_log(spark), published)).select("tie", "slot", "version", "node_id")


def fetch_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests at node-b under route 3; a tenth of the ticks are paused, memory grows with the day."""
    log = requests(spark, sf_dir).withColumn("slot", keys.slot_for_key(F.col("sequence_key")))
    first = log.groupBy("sequence_key").agg(F.min(F.struct("ts", "tie")).alias("earliest"))
    log = log.join(first, "sequence_key").withColumn("first", F.col("tie") == F.col("earliest.tie")).drop("earliest")
    owned = routes.owner_of(log, route_log(spark).where("version = 3"))
    allowed = allocate.admitted(F.col("first"), F.dayofmonth("ts").cast("long") * 4, F.lit(100).cast("long"), 0.5)
    verdict = allocate.fetch_verdict(F.col("tie") % 10 == 0, F.col("node_id") == "node-b", allowed)
    version = F.when(F.col("tie") % 7 == 0, "bad").when(F.col("tie") % 7 == 1, " 3").when(F.col("tie") % 7 == 2, "+4").otherwise((F.col("tie") % 7).cast("string"))
    answer = allocate.service_verdict(verdict, version, F.lit(3))
    return owned.select("tie", verdict.alias("reason"), answer.alias("answer"))


ENDPOINTS = [("e1", "node-a", "READY"), ("e2", "node-b", "READY"), ("e3", "node-b", "READY"), ("e4", "node-c", "CONNECTING"), ("e5", "", "READY"), ("e6", "node-d", "READY")]


def endpoint_ready_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    endpoints = spark.createDataFrame(ENDPOINTS, "name string, node_id string, state string")
    return routes.ready_owners(endpoints).withColumn("overall", F.lit(routes.connectivity(endpoints).first()["state"]))


def endpoint_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    endpoints = spark.createDataFrame(ENDPOINTS, "name string, node_id string, state string")
    return routes.round_robin(table(spark, sf_dir, "events").select("event_id"), "event_id", endpoints)


def endpoint_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = spark.createDataFrame(ENDPOINTS, "name string, node_id string, state string")
    wanted = spark.createDataFrame([("e2", "node-b", 0), ("e6", "node-x", 1), ("e7", "node-e", 2), ("e6", "node-y", 3)], "name string, node_id string, place int")
    return routes.reconcile(current, wanted)


def get_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("known"), F.when(F.col("event_id") % 11 != 0, F.lit(3).cast("long")).alias("current"))
    return asked.select("event_id", routes.get_route(F.col("known"), F.col("current")).alias("answer"))


def audit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir)
    marks = replay.session_sums(log, FIXED).groupBy("sequence_key").agg(F.sum("used").alias("max_id"))
    return audit.audit_ids(replay.replay_fixed(log, FIXED), marks)


def allocator_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = requests(spark, sf_dir).groupBy("sequence_key").agg(F.unix_micros(F.max("ts")).alias("last_used"))
    cutoff = F.lit(1706486400000000)  # 2024-01-29 00:00:00 UTC
    return audit.allocator_metrics(last, 45, 100, F.lit(0), F.count("*"), F.count_if(F.col("last_used") <= cutoff))


def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cleanup run over 4,096 slots from slot 14,000 on, past the last slot to the first ones, and what its evictions discard; keys hold ranges of 100."""
    log = requests(spark, sf_dir)
    state = log.groupBy("sequence_key").agg(F.unix_micros(F.max("ts")).alias("last_used"), F.count("*").alias("returned")).select(
        keys.slot_for_key(F.col("sequence_key")).alias("slot"), "sequence_key", "last_used", F.lit(True).alias("initialized"), F.lit(1).cast("long").alias("start"),
        F.lit(100).cast("long").alias("end"), "returned", F.when(F.col("returned") >= 50, 100).otherwise(0).alias("standby_size"), (F.col("returned") % 17 == 0).alias("fetching"),
    )
    cutoff = F.lit(1706486400000000)
    owned = spark.range(keys.SLOT_COUNT).select(F.col("id").cast("int").alias("slot"))
    candidates, cursor = replay.cleanup_run(state, owned, 14000, 4096, cutoff)
    _, sums = replay.evict(state, candidates, cutoff)
    return sums.withColumn("cursor", F.lit(cursor))


SIZES = ["67108864", "64MiB", "1GiB", "2TiB", "1024KiB", " 64MiB ", "", "auto", "64MB", "1.5GiB", "-1", "18446744073709551615TiB", "18446744073709551615", "63MiB", "9223372036854775807B", "007KiB"]


def parse_memory_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(v,) for v in SIZES], "value string")
    size = sizes.parse_size(F.col("value"))
    return rows.select("value", size.cast("string").alias("bytes"), sizes.limit_problem(size).alias("problem"))


def memory_limit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes stand for machines with and without limits."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    gib = F.lit(1 << 30).cast("long")
    cgroup = F.when(F.col("n") % 3 != 0, F.col("n") * gib)
    system = F.when(F.col("n") % 5 != 0, F.lit(25 << 30))
    config = F.when(F.col("n") % 7 == 0, "512MiB")
    env = F.when(F.col("n") % 4 == 0, F.when(F.col("n") % 8 == 0, "auto").otherwise("1GiB"))
    limit, source = sizes.configured_limit(config, env, cgroup, system, F.lit(0.8))
    return part.select("p_partkey", limit.cast("long").alias("limit_bytes"), source.alias("source"))


MANIFESTS = [
    ("sequence", [("v0.1.0", "gen/go/sequence/v0.1.0", ["pkg/sequence/v0.1.0"]), ("v0.2.0", "gen/go/sequence/v0.2.0", ["pkg/sequence/v0.1.0", "pkg/sequence/v0.2.0", "pkg/sequence/v0.2.0"]), ("v0.2.0", "", [])]),
    ("Other", [("0.1", "gen/go/other/v1", []), ("v1.0.0", "", ["pkg/other/v1.0.0"]), ("v1.1.0", "gen/go/sequence/v1.1.0", ["client/other/v1.0.0"])]),
]
RELEASED = [("sequence", [("v0.0.9", "", []), ("v0.1.0", "gen/go/sequence/v0.0.9", ["pkg/sequence/v0.1.0", "pkg/sequence/v0.0.9"])])]
TAGS = ["gen/go/sequence/v0.1.0", "gen/go/sequence/v0.2.0", "pkg/sequence/v0.1.0"]
MANIFEST_KIND = "service string, releases array<struct<version: string, contract: string, tested_clients: array<string>>>"


def release_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = releases.releases_of(spark.createDataFrame(MANIFESTS, MANIFEST_KIND))
    old = releases.releases_of(spark.createDataFrame(RELEASED, MANIFEST_KIND))
    tags = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    root = spark.createDataFrame([("gen/go/sequence", "v0.2.0"), ("pkg/sequence", "v0.2.0")], "module string, version string")
    clients = spark.createDataFrame([("pkg/sequence/v0.1.0", "gen/go/sequence", "v0.1.0"), ("pkg/sequence/v0.2.0", "gen/go/sequence", "v0.2.0")], "client string, module string, version string")
    told = [releases.entry_violations(current), releases.missing_tags(current, tags), releases.dependency_violations(current, root, clients), releases.history_violations(current, old)]
    return reduce(DataFrame.unionByName, told).distinct()


def tree_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: since the tag, those with a fragment in their URL were renamed, those with a query changed."""
    pages, stem = table(spark, sf_dir, "pages"), F.concat(F.lit("p"), F.col("page_id"))
    now = pages.select(F.concat(stem, F.when(F.col("url").contains("#"), ".htm").otherwise(".html")).alias("path"), F.when(F.col("url").contains("?"), F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("text"))
    return releases.tree_drift(now, pages.select(F.concat(stem, F.lit(".html")).alias("path"), F.col("html").alias("text")))


def node_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nodes over 60 ticks, a heartbeat in two; route 2 is published at tick 10, route 3 at tick 30; queries fail from tick 40 to 49."""
    ticks = nodes.schedule(spark, ["node-a", "node-b"], 60, 2)
    version = F.when(F.col("tick") >= 30, 3).when(F.col("tick") >= 10, 2).otherwise(1)
    three = F.when(F.col("node_id") == "node-a", F.array(F.lit(3))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    two = F.when(F.col("node_id") == "node-a", F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(3)))
    one = F.when(F.col("node_id") == "node-a", F.array(*[F.lit(k) for k in range(4)])).otherwise(F.array().cast("array<int>"))
    slots = F.when(version == 3, three).when(version == 2, two).otherwise(one)
    rows = ticks.select("node_id", "tick", "heartbeat", F.col("tick").between(40, 49).alias("failed"), version.alias("version"), slots.alias("slots"))
    log = nodes.node_log(rows, 3)
    return log.select("node_id", "tick", "paused", "version", F.array_join("slots", ",").alias("slots"))


def stream_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive replay as a stream over the events, read to its end; the same ids as adaptive_replay."""
    from seqspark.streaming.allocator import allocate_stream

    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as streams take no single file
    log = source.select(F.col("user_id").cast("string").alias("sequence_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"))
    base = own_path(spark, "stream")
    run = allocate_stream(log, ADAPTIVE).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema("sequence_key string, tie bigint, id bigint, watermark bigint").parquet(f"{base}/out")


def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks of all suppliers, moved on by the demands of all customers; keys are their ids, so that many customers
    have no watermark yet. A step of 0 is refused."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sequence_key"), (F.col("s_suppkey") * 10).cast("long").alias("max_id"))
    marks = suppliers.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    demands = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sequence_key"), F.lit(1).alias("seq"), (F.col("c_custkey") % 7).cast("long").alias("step"))
    moved = ranges.advance(marks, ranges.reserve(demands, marks), F.lit("2024-02-01").cast("timestamp"))
    return moved.select("sequence_key", "max_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def metadata_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client versions as sent: plain, signed, with blanks around, beyond 64 bits, hexadecimal or empty."""
    n = F.col("event_id").cast("string")
    sent = [n, F.concat(F.lit("+"), n), F.concat(F.lit(" "), n), F.concat(n, F.lit("99999999999999999999")), F.concat(F.lit("0x"), n), F.lit(""), F.concat(F.lit("-"), n)]
    text = F.element_at(F.array(*sent), (F.col("event_id") % len(sent) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", keys.parse_int64(text).alias("version"))


def names_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with blanks around; some are blank alone, some missing."""
    blank = F.lit(" \t\n\u00a0")
    name = F.when(F.col("c_custkey") % 3 == 0, blank).when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.concat(blank, "c_name", blank))
    return table(spark, sf_dir, "customer").select("c_custkey", keys.or_default(name, "sequence").alias("name"))


def memory_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part as a node: its size as total memory, its key as released memory, with and without a limit."""
    managed = sizes.managed_memory(F.col("p_size").cast("long"), (F.col("p_partkey") % 20).cast("long"))
    limit = F.when(F.col("p_partkey") % 4 == 0, 0).when(F.col("p_partkey") % 7 == 0, F.lit((1 << 63) - 1)).otherwise(64).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", managed.alias("managed"), sizes.utilization(managed, limit).alias("utilization"))


def route_answer_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's judgement of each answer to a refresh."""
    known, same = F.col("event_id") % 3, F.col("event_id") % 2 == 0
    version = F.when(F.col("event_id") % 5 > 1, F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", routes.refresh_problem(known, same, version).alias("problem"))


def route_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What node-b drops and adds as it opens again with route 3, having applied route 2, and with route 2 once more."""
    own = route_log(spark).where("node_id = 'node-b'")
    two, three = own.where("version = 2"), own.where("version = 3")
    newer = routes.open_diff(two, three, 3, 2).withColumn("version", F.lit(3).cast("long"))
    return newer.unionByName(routes.open_diff(two, two, 2, 2).withColumn("version", F.lit(2).cast("long")))


def route_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshots after version 3 was added to them and a publication of version 2 by others was left out."""
    every = snapshots(spark)
    held, again = every.where("version < 3"), every.where("version = 1").withColumn("version", F.lit(2).cast("long"))
    return routes.append_new(routes.append_new(held, again), every.where("version = 3"))


def client_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a client asks once more, by the reason or the code of a refusal."""
    reasons = F.array(F.lit(None), *[F.lit(r) for r, _ in REASONS.values()])
    reason = F.element_at(reasons, (F.col("event_id") % (len(REASONS) + 1) + 1).cast("int"))
    code = F.when(F.col("event_id") % 4 == 0, "UNAVAILABLE").otherwise("INTERNAL")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(allocate.retryable(reason, code), F.lit(False)).alias("again"))


def ids_not_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id is not above that of their user's event before, by time."""
    log = requests(spark, sf_dir).withColumn("id", F.col("tie") % 100)
    return audit.not_increasing(log, ["ts", "tie"]).select("sequence_key", "tie", "id", "before")


def release_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against releasing v0.1.0 and v9.0.0 of sequence."""
    manifests = spark.createDataFrame(MANIFESTS, MANIFEST_KIND)
    return reduce(DataFrame.unionByName, [releases.lookup_violations(manifests, "sequence", v) for v in ("v0.1.0", "v9.0.0")])


def selected_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tested client of each release that the root module requires."""
    root = spark.createDataFrame([("gen/go/sequence", "v0.2.0"), ("pkg/sequence", "v0.2.0")], "module string, version string")
    return releases.selected_clients(releases.releases_of(spark.createDataFrame(MANIFESTS, MANIFEST_KIND)), root)


def tag_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of modules named after parts: path, version, and whether the tag is a contract's."""
    n = F.col("p_partkey").cast("string")
    tags = [F.concat(F.lit("gen/go/p"), n, F.lit("/v1.2."), n), F.concat(F.lit("gen/go/p/v2/v"), n), F.concat(F.lit("pkg/p"), n, F.lit("/v0.0.1")), F.concat(F.lit("gen/go//v1.0."), n), F.lit("v1.0.0")]
    tag = F.element_at(F.array(*tags), (F.col("p_partkey") % len(tags) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", releases.tag_path(tag).alias("path"), releases.tag_version(tag).alias("version"), releases.valid_tag(tag, releases.CONTRACTS).alias("valid"))


def version_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When requests that wait for versions 1 to 4 at tick 5 or 35 may go on, by the log of node_ticks."""
    log = node_ticks(spark, sf_dir)
    waits = spark.createDataFrame([(n, v, t) for n in ("node-a", "node-b") for v in (1, 2, 3, 4) for t in (5, 35)], "node_id string, version long, tick long")
    return nodes.first_applied(log.select("node_id", "tick", "version"), waits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        first_ids, slot_for_key, slot_histogram, key_validity, allocate_ordered, reserve_ranges, watermark_after_prefetch, range_of_id, idle_gap_allocate,
        idle_discarded, step_decision, adaptive_replay, route_latest_newer, route_violations, route_diff, route_update_verdict, owner_lookup, owner_asof,
        fetch_verdict, endpoint_ready_owner, endpoint_round_robin, endpoint_reconcile, get_route, audit_ids, allocator_metrics, cleanup, parse_memory_limit,
        memory_limit_source, release_violations, tree_drift, node_ticks, stream_allocate, watermark_advance, metadata_integers, names_or_default,
        memory_utilization, route_answer_problem, route_reopen, route_publication, client_retry, ids_not_increasing, release_lookup, selected_clients,
        tag_parts, version_barrier,
    )
}
