"""Versioned route snapshots: publication, decoding and its rules, comparison, and who owns a slot when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions.keys import SLOT_COUNT
from seqspark.sources.schemas import PAYLOAD, REASONS


def split_slots(spark: SparkSession, nodes: list[str]) -> DataFrame:
    """node_id, slot: all slots dealt to the nodes in turn."""
    names = F.array(*[F.lit(n) for n in nodes])
    return spark.range(SLOT_COUNT).select(F.element_at(names, (F.col("id") % len(nodes) + 1).cast("int")).alias("node_id"), F.col("id").cast("int").alias("slot"))


def publish(owners: DataFrame, version: int) -> DataFrame:
    """The one row (version, payload) of a snapshot from node_id, slot; nodes and slots are in order."""
    by_node = owners.groupBy("node_id").agg(F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    nodes = F.array_sort(F.collect_list(F.struct("node_id", "slots")))
    return by_node.agg(nodes.alias("nodes")).select(F.lit(version).cast("long").alias("version"), F.to_json(F.struct("nodes")).alias("payload"))


def append_new(routes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """routes with the snapshots of versions that it has not yet."""
    return routes.unionByName(snapshot.join(routes.select("version"), "version", "left_anti"), allowMissingColumns=True)


def latest_newer(routes: DataFrame, known: int) -> DataFrame:
    """The newest snapshot above the known version, if any."""
    return routes.where(F.col("version") > known).orderBy(F.desc("version")).limit(1)


def _nodes(routes: DataFrame) -> DataFrame:
    parsed = F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"})
    return routes.select("version", parsed.alias("route")).select("version", F.posexplode_outer("route.nodes").alias("place", "node"))


def owners_of(routes: DataFrame) -> DataFrame:
    """version, node_id, slot: the snapshots in long form."""
    rows = _nodes(routes).select("version", F.col("node.node_id").alias("node_id"), F.explode("node.slots").alias("slot"))
    return rows.select("version", "node_id", F.col("slot").cast("int").alias("slot"))


def violations(routes: DataFrame) -> DataFrame:
    """version, problem: what is wrong with each snapshot, a row for each kind of problem; none for a valid one.

    bad_version (0 or less), bad_json (no text of the form, a number that is no integer included), empty_node,
    duplicate_node, slot_range (null, negative or too large), duplicate_slot, coverage (not all slots have an owner).
    Missing slots of a node are none. Field names are case-sensitive.
    """
    strict = F.from_json("payload", "nodes array<struct<node_id: string, slots: array<string>>>")
    raw = routes.select("version", strict.alias("route"), F.get_json_object("payload", "$.nodes").alias("nodes"))
    bad = F.col("route").isNull() | F.col("nodes").isNull() | F.col("route.nodes").isNull()
    digits = F.exists("route.nodes", lambda n: F.exists(F.coalesce(n["slots"], F.array().cast("array<string>")), lambda s: s.isNotNull() & ~s.rlike("^-?[0-9]+\\z")))
    bad = bad | F.coalesce(digits, F.lit(False))
    told = [raw.where("version <= 0").select("version", F.lit("bad_version").alias("problem")), raw.where(bad).select("version", F.lit("bad_json").alias("problem"))]
    good = raw.where(~bad).select("version", F.posexplode_outer("route.nodes").alias("place", "node"))
    told.append(good.where(F.col("node").isNotNull() & (F.coalesce("node.node_id", F.lit("")) == "")).select("version", F.lit("empty_node").alias("problem")))
    named = good.where(F.coalesce("node.node_id", F.lit("")) != "").groupBy("version", "node.node_id").count().where("count > 1")
    told.append(named.select("version", F.lit("duplicate_node").alias("problem")))
    slots = good.select("version", "place", F.explode("node.slots").alias("text")).select("version", F.col("text").try_cast("bigint").alias("slot"))
    inside = F.coalesce(F.col("slot").between(0, SLOT_COUNT - 1), F.lit(False))
    told.append(slots.where(~inside).select("version", F.lit("slot_range").alias("problem")))
    told.append(slots.where(inside).groupBy("version", "slot").count().where("count > 1").select("version", F.lit("duplicate_slot").alias("problem")))
    covered = slots.where(inside).groupBy("version").agg(F.countDistinct("slot").alias("n"))
    told.append(good.select("version").distinct().join(covered, "version", "left").where(F.coalesce("n", F.lit(0)) != SLOT_COUNT).select("version", F.lit("coverage").alias("problem")))
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out.distinct()


def valid_routes(routes: DataFrame) -> DataFrame:
    return routes.join(violations(routes).select("version").distinct(), "version", "left_anti")


def canonical(routes: DataFrame) -> DataFrame:
    """version, nodes: nodes by name, each with its slots in order."""
    by_node = owners_of(routes).groupBy("version", "node_id").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    return by_node.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("node_id", "slots"))).alias("nodes"))


def update_verdict(current_version: Column, current: Column, version: Column, payload: Column) -> Column:
    """What an update does: apply (newer, or there is none yet), regression, noop (same version and content) or conflict.
    Contents are compared as they stand, the order of nodes and slots included."""
    return (
        F.when(current_version.isNull() | (version > current_version), "apply")
        .when(version < current_version, "regression")
        .when(current == payload, "noop")
        .otherwise("conflict")
    )


def diff(current: DataFrame, new: DataFrame) -> DataFrame:
    """slot, change: dropped (owned now, not in the new route) or added (the other way round); both sides have slot."""
    dropped = current.select("slot").join(new.select("slot"), "slot", "left_anti").withColumn("change", F.lit("dropped"))
    added = new.select("slot").join(current.select("slot"), "slot", "left_anti").withColumn("change", F.lit("added"))
    return dropped.unionByName(added)


def open_diff(current: DataFrame, new: DataFrame, version: int, applied_version: int) -> DataFrame:
    """As diff(), for a node that reopens: a newer version drops all slots first, and adds all of the new route."""
    if version <= applied_version:
        return diff(current, new)
    all_dropped = current.select("slot", F.lit("dropped").alias("change"))
    return all_dropped.unionByName(new.select("slot", F.lit("added").alias("change")))


def effective(owners: DataFrame, published: DataFrame) -> DataFrame:
    """node_id, slot, from, until: the times in which a node serves a slot. published has version, applies_at, taken_at.

    A losing node stops at once, when the next version is taken; a gaining one starts when its version applies. A node
    that keeps a slot over several versions has one interval for each, which meet.
    """
    after = F.expr("lead(version) OVER (ORDER BY version)")
    following = F.expr("lead(taken_at) OVER (ORDER BY version)")
    spans = published.withColumn("next_version", after).withColumn("next_taken", following).withColumn("next_applies", F.expr("lead(applies_at) OVER (ORDER BY version)"))
    held = owners.join(F.broadcast(spans), "version")
    keeps = F.expr("lead(version) OVER (PARTITION BY node_id, slot ORDER BY version)") == F.col("next_version")
    ends = F.when(F.coalesce(keeps, F.lit(False)), F.col("next_applies")).otherwise(F.col("next_taken"))
    return held.select("version", "node_id", "slot", F.col("applies_at").alias("from"), ends.alias("until")).where(F.col("until").isNull() | (F.col("from") < F.col("until")))


def owner_at(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """requests (slot, ts) with the version and node that serves the slot at ts; nulls where none does."""
    spans = intervals.withColumnRenamed("slot", "_slot")
    inside = (F.col("slot") == F.col("_slot")) & (F.col("from") <= F.col("ts")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    return requests.join(spans, inside, "left").drop("_slot", "from", "until")


def owner_of(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """requests (slot) with node_id of one snapshot's owners; 16,384 rows at most, so they are broadcast."""
    return requests.join(F.broadcast(owners.select("slot", "node_id")), "slot", "left")


def get_route(known: Column, current_version: Column) -> Column:
    """The answer to a client: the reason of a missing route, not_modified if it knows this one, else snapshot."""
    none = current_version.isNull() | (current_version <= 0)
    return F.when(none, REASONS[154][0]).when(known >= current_version, "not_modified").otherwise("snapshot")


def refresh_problem(known: Column, not_modified: Column, version: Column) -> Column:
    """Why a client refuses an answer: invalid (a route together with not_modified, or neither), unavailable (not modified,
    but no route is known); null if it serves."""
    return (
        F.when(not_modified & version.isNotNull(), "invalid")
        .when(not_modified & (known == 0), "unavailable")
        .when(~not_modified & version.isNull(), "invalid")
    )


def ready_owners(endpoints: DataFrame) -> DataFrame:
    """node_id, name: nodes that exactly one endpoint (name, node_id, state) names, if that one is READY. Endpoints
    without a node are left out."""
    one = endpoints.where(F.coalesce("node_id", F.lit("")) != "").groupBy("node_id")
    return one.agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("state").alias("state")).where("n = 1 AND state = 'READY'").select("node_id", "name")


def connectivity(endpoints: DataFrame) -> DataFrame:
    """The state of all endpoints together, one row: READY if one is, else TRANSIENT_FAILURE if one is so or there are
    none, else CONNECTING."""
    ready, failed = F.bool_or(F.col("state") == "READY"), F.bool_or(F.col("state") == "TRANSIENT_FAILURE")
    return endpoints.agg(F.when(ready, "READY").when((F.count("*") == 0) | failed, "TRANSIENT_FAILURE").otherwise("CONNECTING").alias("state"))


def round_robin(requests: DataFrame, order: str, endpoints: DataFrame) -> DataFrame:
    """requests with the name of a READY endpoint each, in turn by name.

    order is a column of consecutive integers from 0, as a stream of requests has it, so that no order over all
    requests is needed.
    """
    ready = endpoints.where("state = 'READY'").select(F.col("name"), (F.expr("row_number() OVER (ORDER BY name)") - 1).alias("_turn"))
    n = ready.count()
    if not n:
        return requests.withColumn("name", F.lit(None).cast("string"))
    return requests.withColumn("_turn", F.pmod(F.col(order), F.lit(n))).join(F.broadcast(ready), "_turn").drop("_turn")


def reconcile(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, node_id, change: removed, added or kept, for endpoints of (name, node_id); wanted also has place, and of equal
    names the last counts. A kept one has the wanted node."""
    last = wanted.groupBy("name").agg(F.max_by("node_id", "place").alias("node_id"))
    old = current.select("name", F.col("node_id").alias("old"), F.lit(True).alias("was"))
    both = old.join(last.withColumn("is", F.lit(True)), "name", "full_outer")
    change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("kept")
    return both.select("name", F.when(F.col("is").isNull(), F.col("old")).otherwise(F.col("node_id")).alias("node_id"), change.alias("change"))
