"""Schemas of the tables; they are always given, never inferred."""

from pyspark.sql import types as T

WATERMARKS = T.StructType(
    [T.StructField("sequence_key", T.StringType(), False), T.StructField("max_id", T.LongType(), False), T.StructField("updated_at", T.TimestampType(), False)]
)
ROUTES = T.StructType(
    [T.StructField("version", T.LongType(), False), T.StructField("payload", T.StringType(), False), T.StructField("created_at", T.TimestampType(), True)]
)
PAYLOAD = "nodes array<struct<node_id: string, slots: array<bigint>>>"
OWNERS = "version bigint, node_id string, slot int"
REQUESTS = "request_id bigint, sequence_key string, ts timestamp, client_version string"
MANIFEST = "service string, releases array<struct<version: string, contract: string, tested_clients: array<string>>>"

#: Why a request is refused, with the status code that goes with it.
REASONS = {
    150: ("SEQUENCE_ALLOCATOR_PAUSED", "UNAVAILABLE"),
    151: ("SEQUENCE_SLOT_NOT_OWNER", "FAILED_PRECONDITION"),
    152: ("SEQUENCE_ROUTE_EXPIRED", "FAILED_PRECONDITION"),
    153: ("SEQUENCE_CAPACITY_EXHAUSTED", "RESOURCE_EXHAUSTED"),
    154: ("SEQUENCE_ROUTE_UNAVAILABLE", "FAILED_PRECONDITION"),
}
