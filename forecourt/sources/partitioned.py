"""The part table in hash partitions of the order number, so that a batch reads and replaces only what it touches.

A full refresh is `write_parts`; `append_parts` adds the parts of new orders; the two `store_status_...` functions find
the partitions of a batch, read these alone, and replace them by a dynamic partition overwrite: all other files stay as
they are.  A batch that failed half-way can be run again: both kinds of status batch give the same table when repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schema
from forecourt.functions.lineage import delete_folder, new_folder, pin, shuffles_removed
from forecourt.operators import batches
from forecourt.tables import Tables, conform

PARTITION = "_partition"


def partition_of(order_number: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(order_number), F.lit(partitions)).cast("int")


def _placed(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows dealt out by their partition: a partition is one task's work."""
    return rows.withColumn(PARTITION, partition_of(F.col("order_number"), partitions)).repartition(PARTITION)


def _write(placed: DataFrame, folder: str, mode: str) -> None:
    """One file per partition and write, whichever task made the rows."""
    # Dynamic: only the partitions that `placed` has rows of are replaced.
    writer = placed.write.partitionBy(PARTITION).option("partitionOverwriteMode", "dynamic")
    with shuffles_removed(placed.sparkSession):
        writer.mode(mode).parquet(folder)


def write_parts(parts: DataFrame, folder: str, partitions: int) -> None:
    """The first snapshot, into a new folder.

    `partitions` stays with the folder: give the same number ever after.  Choose it so that a partition is about one task's
    data (100-200 MB); a batch costs as many partitions as it has different orders, at most.
    """
    _write(_placed(conform(parts, "part"), partitions), folder, "errorifexists")


def append_parts(parts: DataFrame, folder: str, partitions: int) -> None:
    _write(_placed(conform(parts, "part"), partitions), folder, "append")


def read_parts(spark: SparkSession, folder: str, numbers: list[int] | None = None) -> DataFrame:
    """The part table; with `numbers` only those partitions, chosen by their folders' names."""
    columns = T.StructType([*schema.SCHEMAS["part"].fields, T.StructField(PARTITION, T.IntegerType())])
    stored = spark.read.schema(columns).parquet(folder)
    rows = stored if numbers is None else stored.where(F.col(PARTITION).isin(numbers))
    return rows.select(*schema.SCHEMAS["part"].names)


def touched_partitions(updates: DataFrame, partitions: int) -> list[int]:
    """The partitions of the orders that `updates` name: at most `partitions` numbers reach the driver."""
    numbers = updates.where(F.col("order_number").isNotNull()).select(partition_of(F.col("order_number"), partitions))
    with shuffles_removed(updates.sparkSession):
        return sorted(row[0] for row in numbers.distinct().collect())


def _beside(parts: DataFrame, facts: DataFrame, partitions: int) -> DataFrame:
    """`parts LEFT JOIN facts USING (part key)`, dealt out by partition so that the result can be written as it lies.

    `facts` has one row per key.  A join would deal out both sides by the key, and its result once more by partition.
    """
    named = facts.where(reduce(and_, [F.col(c).isNotNull() for c in batches.PART_KEY]))
    rows = parts.withColumn("_is_part", F.lit(True)).unionByName(named, allowMissingColumns=True)
    same = Window.partitionBy(PARTITION, *batches.PART_KEY)
    facts_of = {c: F.max(c).over(same) for c in facts.columns if c not in batches.PART_KEY}
    return _placed(rows, partitions).withColumns(facts_of).where("_is_part")


def _store(
    updates: DataFrame,
    folder: str,
    partitions: int,
    facts: Callable[[DataFrame], DataFrame],
    settle: Callable[[DataFrame], DataFrame],
) -> list[int]:
    """`facts` has a row per part of the updates, and is stored first, so that its shuffles are gone when parts are read."""
    spark, numbers = updates.sparkSession, touched_partitions(updates, partitions)
    if numbers:
        staging = new_folder(spark, "status-batch")
        try:
            found = pin(facts(updates), staging)
            after = settle(_beside(read_parts(spark, folder, numbers), found, partitions))
            _write(after.select(*schema.SCHEMAS["part"].names, PARTITION), folder, "overwrite")
        finally:
            delete_folder(spark, staging)
    return numbers


def store_status_updates(tables: Tables, updates: DataFrame, folder: str, partitions: int) -> list[int]:
    """`batches.apply_status_updates` on the stored part table, in place.  Gives the numbers of the partitions replaced."""
    return _store(updates, folder, partitions, batches.latest_status, batches.with_latest_status)


def store_status_transitions(tables: Tables, updates: DataFrame, folder: str, partitions: int) -> list[int]:
    """`batches.apply_status_transitions`, likewise."""
    return _store(updates, folder, partitions, batches.first_moves, batches.with_moved_status)
