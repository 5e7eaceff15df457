"""A node's life over a log of ticks: heartbeats, route changes, delayed application and fail-closed pauses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_LOG = "node_id string, tick bigint, paused boolean, version bigint, slots array<int>, elapsed bigint"


@dataclass
class Node:
    """A node between ticks. pending is (version, tick of application, slots that are added)."""

    timeout: int
    tick: int = 0
    elapsed: int = 0
    paused: bool = True
    version: int = 0
    slots: set[int] = field(default_factory=set)
    pending: tuple[int, int, list[int]] | None = None
    known: tuple[int, list[int]] | None = None

    def base_tick(self) -> None:
        """Pause after too many ticks without a heartbeat, else count the tick and apply a route that is due."""
        if self.elapsed >= self.timeout:
            self.paused = True
            return
        self.elapsed += 1
        if self.pending and self.pending[1] <= self.tick:
            self.version, _, added = self.pending
            self.slots |= set(added)
            self.pending = None

    def heartbeat(self, newer: tuple[int, list[int]] | None) -> None:
        """Take a newer route, or the known one again when paused: lost slots go at once, new ones after the timeout."""
        route = newer if newer else self.known if self.paused else None
        if route:
            version, slots = route
            if self.paused and version > self.version:
                self.slots = set()
            self.slots &= set(slots)
            if version > self.version:
                self.pending = (version, self.tick + self.timeout, [s for s in slots if s not in self.slots])
            self.known, self.paused = route, False
        self.elapsed = 0


def node_log(ticks: DataFrame, heartbeat_timeout_ticks: int) -> DataFrame:
    """The state of each node after each tick.

    ticks has node_id, tick, heartbeat (whether one is due), failed (whether its query failed), and version and slots of
    the newest route, with the node's own slots, or nulls. A tick runs the base tick first, then the heartbeat; tick 0 is the
    start, which has a heartbeat alone. Ticks of a node are folded in order; a task holds one node's state at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node = object(), Node(heartbeat_timeout_ticks)
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
        names = [x.split()[0] for x in NODE_LOG.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for name, tick, heartbeat, failed, version, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at:
                    at, node = name, Node(heartbeat_timeout_ticks)
                node.tick = tick
                if tick > 0:
                    node.base_tick()
                if heartbeat and not failed:
                    newer = (version, slots or []) if version is not None and version > (node.known or (0, []))[0] else None
                    node.heartbeat(newer)
                out.append((name, tick, node.paused, node.version, sorted(node.slots), node.elapsed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = ticks.select("node_id", F.col("tick").cast("long"), "heartbeat", "failed", F.col("version").cast("long"), F.col("slots").cast("array<int>"))
    return rows.repartition("node_id").sortWithinPartitions("node_id", "tick").mapInArrow(fold, NODE_LOG)


def schedule(spark: SparkSession, nodes: list[str], last_tick: int, heartbeat_ticks: int) -> DataFrame:
    """node_id, tick, heartbeat: the ticks from the start on; one in heartbeat_ticks has a heartbeat, the start too."""
    ticks = spark.range(last_tick + 1).withColumnRenamed("id", "tick")
    return ticks.select(F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node_id"), "tick", (F.col("tick") % heartbeat_ticks == 0).alias("heartbeat"))


def first_applied(log: DataFrame, waits: DataFrame) -> DataFrame:
    """waits (node_id, version, tick) with the first tick at which the node has that version or a later one."""
    reached = log.select("node_id", F.col("tick").alias("_tick"), F.col("version").alias("_version"))
    versions = reached.groupBy("node_id", "_version").agg(F.min("_tick").alias("_tick"))
    joined = waits.join(versions, "node_id", "left").where(F.col("_version").isNull() | (F.col("_version") >= F.col("version")))
    found = joined.groupBy("node_id", "version", "tick").agg(F.min(F.greatest("_tick", "tick")).alias("ready_tick"))
    return waits.join(found, ["node_id", "version", "tick"], "left")
