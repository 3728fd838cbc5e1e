"""Tab-separated raw files and Parquet tables on shared storage."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schema
from forecourt.functions.lineage import pin
from forecourt.operators.ingest import LINE_NO, RAW_COLUMNS
from forecourt.tables import Tables, conform

# Columns that hold secrets are never kept.
DROPPED = {"users": ("password",)}


_BROKEN = "_broken_line"


def _read_lines(spark: SparkSession, path: str, kind: str, multi_line: bool) -> DataFrame:
    text = T.StructType([T.StructField(c, T.StringType()) for c in (*RAW_COLUMNS[kind], _BROKEN)])
    reader = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=False)
    return reader.option("columnNameOfCorruptRecord", _BROKEN).schema(text).csv(path)


def read_raw(
    spark: SparkSession, path: str, kind: str, *, staging: str | None = None, multi_line: bool = False
) -> DataFrame:
    """One kind of raw file with every column as text.

    The schema is declared: inferring it would read identifiers with leading zeros as numbers.  Quoted cells and doubled
    quotes are understood; `multi_line` also reads line breaks inside quotes, at the price that a file is not split.
    Lines with another number of cells are left out; `read_broken` gives them.

    With `staging` (a shared folder) the rows are stored there once and come with `line_no`, their place in file order.
    How Spark splits files can change from run to run, so a place is only given to a stored copy.
    """
    lines = _read_lines(spark, path, kind, multi_line).where(F.col(_BROKEN).isNull()).drop(_BROKEN)
    rows = lines.drop(*DROPPED.get(kind, ()))
    if staging is None:
        return rows
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return pin(rows.select("*", place.alias(LINE_NO)), staging)


def read_broken(spark: SparkSession, path: str, kind: str, *, multi_line: bool = False) -> DataFrame:
    """(file, line): the lines that `read_raw` leaves out because their number of cells is wrong."""
    lines = _read_lines(spark, path, kind, multi_line).select(
        F.col("_metadata.file_path").alias("file"), F.col(_BROKEN).alias("line"), *RAW_COLUMNS[kind]
    )
    # The second condition is always true; it makes Spark parse the cells, without which it cannot count them.
    parsed = F.length(F.concat_ws("", *RAW_COLUMNS[kind])) >= 0
    return lines.where(F.col("line").isNotNull() & parsed).select("file", "line")


def read_tables(spark: SparkSession, folder: str) -> Tables:
    """The stored tables, with their declared schemas; a folder is opened when its table is first used."""
    return Tables(**{name: partial(_read_table, spark, folder, name) for name in schema.TABLE_NAMES})


def _read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schema.SCHEMAS[name]).parquet(f"{folder}/{name}")


# What rows are looked for by: the column files are sorted by, then the others that get a Bloom filter.
LOOKUP_KEYS = {
    "vehicle": ("vin",),
    "vehicle_color": ("vin",),
    "parts_order": ("vin", "order_number"),
    "part": ("order_number",),
    "purchase": ("vin", "customer_id"),
    "sale": ("vin", "customer_id"),
    "customer": ("customer_id",),
    "individual_customer": ("customer_id", "social_security_number"),
    "business_customer": ("customer_id", "tax_identification_number"),
}


def write_clustered(frames: Mapping[str, DataFrame], folder: str, files: int, mode: str = "overwrite") -> None:
    """The named tables for lookups: `files` ranges of their first key, sorted by it, with Bloom filters on all keys.

    A filter on the first key reads the row groups whose range holds it; one on another key those whose Bloom filter does.
    Very hot keys are cut between files, because rows are ranged by all lookup columns.  Tables without keys are
    written plainly.
    """
    for name, rows in frames.items():
        keys, rows = LOOKUP_KEYS.get(name, ()), conform(rows, name)
        if keys:
            order = [*keys, *[c for c in rows.columns if c not in keys]]
            rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*keys)
        writer = rows.write.mode(mode)
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{folder}/{name}")


def write_tables(frames: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Full refresh (`overwrite`) or insert (`append`) of the named tables.

    Validate appended rows first (see `operators.batches`): Parquet enforces no keys.  Never overwrite a
    folder that one of the frames is read from; write the next snapshot to a new folder.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
    for name, rows in frames.items():
        conform(rows, name).write.mode(mode).parquet(f"{folder}/{name}")
