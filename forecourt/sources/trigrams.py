"""Keyword search that reads only the blocks of the vehicle table that may hold the keyword.

`write_searchable` stores the vehicles in blocks of similar rows (one folder each) and, beside them, which three-letter
sequences each block holds in the four searched texts.  A keyword is cut at its wildcards into literal pieces; only blocks
that hold all three-letter sequences of these are opened, and the search itself, by `vehicles.search_vehicles`, stays
exact.  A keyword without a piece of three letters opens all blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schema
from forecourt.functions.text import keyword_pattern
from forecourt.operators.vehicles import KEYWORD_TEXTS
from forecourt.tables import conform

BLOCK = "_block"


def _trigrams(text: Column) -> Column:
    """Distinct sequences of three characters, in small letters as `ilike` compares them."""
    small = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    n = F.char_length(small)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(small, i, F.lit(3)))
    return F.array_distinct(F.filter(each, lambda x: F.char_length(x) == 3))


def write_searchable(vehicle: DataFrame, folder: str, blocks: int) -> None:
    """The vehicle table and its sequences, replacing what `folder` has.

    Rows are dealt by manufacturer, model, year and VIN into `blocks` ranges of about equal size, so that a model's name is in
    few of them.  A block's entry is one row per sequence it holds; choose `blocks` so that a block is about one task's
    data.
    """
    rows = conform(vehicle, "vehicle").repartitionByRange(blocks, "manufacturer_name", "model_name", "year", "vin")
    rows.withColumn(BLOCK, F.spark_partition_id()).write.mode("overwrite").partitionBy(BLOCK).parquet(f"{folder}/vehicle")
    stored = _read(vehicle.sparkSession, folder)
    held = F.array_distinct(F.flatten(F.array(*[_trigrams(F.col(c)) for c in KEYWORD_TEXTS])))
    entries = stored.select(F.explode(held).alias("trigram"), BLOCK).distinct()
    sorted_ = entries.repartitionByRange("trigram").sortWithinPartitions("trigram", BLOCK)
    sorted_.write.mode("overwrite").option("parquet.bloom.filter.enabled#trigram", "true").parquet(f"{folder}/trigrams")


def _read(spark: SparkSession, folder: str) -> DataFrame:
    columns = T.StructType([*schema.SCHEMAS["vehicle"].fields, T.StructField(BLOCK, T.IntegerType())])
    return spark.read.schema(columns).parquet(f"{folder}/vehicle")


def literal_pieces(keyword: str) -> list[str]:
    """What lies between the wildcards of a keyword, escapes undone."""
    pieces = re.split(r"(?<!\\)(?:\\\\)*[%_]", keyword_pattern(keyword))
    return [re.sub(r"\\(.)", r"\1", p) for p in pieces if p]


def candidate_blocks(spark: SparkSession, folder: str, keyword: str) -> list[int] | None:
    """The blocks that hold every sequence of the keyword, at most as many as there are; None: any block may."""
    pieces = F.array(*[F.lit(p) for p in literal_pieces(keyword)] or [F.lit("")])
    wanted = spark.range(1).select(F.array_distinct(F.flatten(F.transform(pieces, _trigrams))).alias("t")).first()["t"]
    if not wanted:
        return None
    entries = spark.read.schema(f"trigram string, {BLOCK} int").parquet(f"{folder}/trigrams")
    found = entries.where(F.col("trigram").isin(wanted)).groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r[0] for r in found.where(F.col("n") == len(wanted)).select(BLOCK).collect())


def candidates(spark: SparkSession, folder: str, keyword: str) -> DataFrame:
    """The vehicles of the candidate blocks: give them to a search as `tables.with_tables(vehicle=...)`."""
    blocks, stored = candidate_blocks(spark, folder, keyword), _read(spark, folder)
    rows = stored if blocks is None else stored.where(F.col(BLOCK).isin(blocks))
    return rows.select(*schema.SCHEMAS["vehicle"].names)
