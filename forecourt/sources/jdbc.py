"""Reading the tables from a live relational database (needs its JDBC driver on the class path)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from forecourt.tables import conform


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    source_table: str,
    target: str,
    *,
    renames: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    lower: int = 0,
    upper: int = 0,
    partitions: int = 1,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """One table, read in parallel ranges of `partition_column` if given, in the declared shape of `target`."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source_table)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if partition_column:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return conform(reader.load().withColumnsRenamed(dict(renames or {})), target)
