"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The tables of this process are below a folder of their own.
_OWN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. An error where that is unset: executors would not see a folder of the driver's machine."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base


def own_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/seqspark-{_OWN}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut and executors may be lost. options:
    of the writer."""
    path = own_path(df.sparkSession, name)
    df.write.options(compression=compression, **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    delete(df.sparkSession, df._stored_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this process. Results that were not written elsewhere can't be read any more."""
    delete(spark, f"{shared_dir(spark)}/seqspark-{_OWN}")


@dataclass(frozen=True)
class Bucketed:
    """A table of files dealt into buckets by a column and sorted by it."""

    spark: SparkSession
    name: str
    path: str

    def table(self) -> DataFrame:
        """The rows by bucket: joins of tables with as many buckets don't move them."""
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """The rows as those of plain files: Spark deals them anew, and may split hot keys of what they are joined with."""
        return self.spark.read.schema(self.table().schema).parquet(self.path)

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def bucketed(df: DataFrame, buckets: int, column: str, name: str) -> Bucketed:
    """Write df as a table in the shared folder with one sorted file for each bucket."""
    out = Bucketed(df.sparkSession, f"{name}_{uuid.uuid4().hex}", own_path(df.sparkSession, name))
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", out.path).format("parquet").saveAsTable(out.name)
    return out
