"""Stores for watermarks and routes: tables of versioned folders, and what any other store has to offer.

A folder store has one writer. A new version is written whole before the marker that names it; ids are handed out only
after their watermark is durable. A crash between the two loses ids, but none is given twice. Several writers need a
store with transactions behind the same protocol, such as a database reached by JDBC.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import ranges
from seqspark.operators.routes import append_new, latest_newer
from seqspark.sources.schemas import ROUTES, WATERMARKS
from seqspark.sources.shared import stored


class WatermarkStore(Protocol):
    def read(self) -> DataFrame:
        """The durable watermark of each key."""

    def reserve(self, demands: DataFrame) -> DataFrame:
        """Make the demands durable, then return their ranges."""


class RouteStore(Protocol):
    def newer(self, known: int) -> DataFrame:
        """The newest route above a version, if any."""

    def publish(self, snapshot: DataFrame) -> None:
        """Add a snapshot, unless its version is there."""


class _Versions:
    """Tables below a folder, one for each version, and the versions that are complete."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def current(self) -> int:
        if not self._exists("complete"):
            return 0
        return self.spark.read.schema("version long").parquet(f"{self.path}/complete").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def write(self, df: DataFrame) -> None:
        version = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/complete")

    def read(self, schema) -> DataFrame:
        version = self.current()
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={version}") if version else self.spark.createDataFrame([], schema)


class FolderWatermarks:
    """A WatermarkStore in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.tables = _Versions(spark, path)

    def read(self) -> DataFrame:
        return self.tables.read(WATERMARKS)

    def reserve(self, demands: DataFrame) -> DataFrame:
        before = self.read()
        reserved = stored(ranges.reserve(demands, before), "reserved")
        self.tables.write(ranges.advance(before, reserved, F.current_timestamp()))
        return reserved


class FolderRoutes:
    """A RouteStore in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.tables = _Versions(spark, path)

    def newer(self, known: int) -> DataFrame:
        return latest_newer(self.tables.read(ROUTES), known)

    def publish(self, snapshot: DataFrame) -> None:
        stamped = snapshot.select("version", "payload", F.current_timestamp().alias("created_at"))
        self.tables.write(append_new(self.tables.read(ROUTES), stamped))


#: How a database tells who it is.
IDENTITY_SQL = {
    "postgres": "SELECT current_database(), current_user",
    "mysql": "SELECT DATABASE(), SUBSTRING_INDEX(CURRENT_USER(), '@', 1)",
}


def identity_problem(found: tuple[str, str], expected: tuple[str, str]) -> str | None:
    return None if found == expected else f"the database is {'/'.join(found)}, not {'/'.join(expected)}"


class JdbcTables:
    """Reads and appends through JDBC; the driver's jar is the user's."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]) -> None:
        self.spark, self.url, self.properties = spark, url, properties

    def check_identity(self, query: str, database: str, account: str) -> None:
        """An error unless query, one row of database and account, gives these: a store that belongs to another."""
        found = tuple(self.spark.read.jdbc(self.url, f"({query}) AS identity", properties=self.properties).first())
        if problem := identity_problem(found, (database, account)):
            raise ValueError(problem)

    def read(self, table: str, known: int | None = None) -> DataFrame:
        """A table; with known only the rows of newer versions, a filter that the database runs."""
        rows = self.spark.read.jdbc(self.url, table, properties=self.properties)
        return rows if known is None else rows.where(F.col("version") > known)

    def append(self, df: DataFrame, table: str) -> None:
        df.write.jdbc(self.url, table, mode="append", properties=self.properties)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """service, releases of release manifests in JSON, one document to a line; unknown fields are an error."""
    from seqspark.sources.schemas import MANIFEST

    rows = spark.read.text(path)
    known = F.array(F.lit("service"), F.lit("releases"))
    strict = F.when(F.size(F.array_except(F.json_object_keys("value"), known)) > 0, F.raise_error(F.lit("unknown field in a manifest"))).otherwise(F.col("value"))
    return rows.select(F.from_json(strict, MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")
