"""Catalog tables bucketed by their join key, so that large joins on it need no shuffle."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from forecourt import schema
from forecourt.tables import Tables, conform

# Per-vehicle tables share the VIN; part lines meet their orders on the order number.  The order table is
# kept by VIN, because per-vehicle cost is what most queries ask of it.
BUCKET_KEYS = {
    "vehicle": "vin",
    "vehicle_color": "vin",
    "parts_order": "vin",
    "purchase": "vin",
    "sale": "vin",
    "part": "order_number",
    "customer": "customer_id",
    "individual_customer": "customer_id",
    "business_customer": "customer_id",
}


def write_bucketed(
    frames: Mapping[str, DataFrame],
    database: str,
    buckets: int,
    *,
    plain: Collection[str] = (),
    location: str | None = None,
) -> None:
    """Replace the named tables of a catalog database, bucketed by BUCKET_KEYS but for the tables named in `plain`.

    A bucket is read by one task: name tables with a very hot key in `plain`.  Choose `buckets` so that one bucket fits
    a task comfortably (a few hundred MB) and use the same number for all tables.  `location` is a shared folder for
    the files; the warehouse is used without it.
    """
    for name, rows in frames.items():
        writer = conform(rows, name).write.mode("overwrite").format("parquet")
        key = BUCKET_KEYS.get(name)
        if key and name not in plain:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        if location:
            writer = writer.option("path", f"{location}/{name}")
        writer.saveAsTable(f"{database}.{name}")


def read_catalog(spark: SparkSession, database: str) -> Tables:
    return Tables(**{name: partial(spark.table, f"{database}.{name}") for name in schema.TABLE_NAMES})
