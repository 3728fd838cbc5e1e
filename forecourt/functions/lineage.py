"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Where that is unset, a folder in the warehouse; but not where the warehouse is a folder of the machine and the
    executors are on others, which would each write to their own disk and read back only a part.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local_files = ":" not in warehouse.split("/")[0] or warehouse.startswith("file:")
    if local_files and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/pinned"


def new_folder(spark: SparkSession, name: str, parent: str | None = None) -> str:
    """The path of a folder nobody has, in `parent` or on shared storage."""
    return f"{parent or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a stored copy, on whatever file system it lies."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query run inside go when it ends, and do not wait until the driver collects garbage.

    For queries whose result is stored or gathered and whose plan nobody runs again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def pin(df: DataFrame, staging: str | None = None) -> DataFrame:
    """Write `df` to shared storage as Parquet and return the stored copy.  The shuffles that made it leave no files.

    The folder is `staging`, else `shared_folder`.  Each call writes a folder of its own, which the caller may delete
    when done: with a `staging` of its own for a batch, by one `delete_folder(spark, staging)`.
    """
    path = new_folder(df.sparkSession, "pinned", staging)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
