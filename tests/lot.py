"""Small hand-made dealerships."""

from __future__ import annotations

import time
from datetime import date
from decimal import Decimal

from forecourt import schema
from forecourt.tables import Tables, empty_tables

DAY = date(2024, 1, 10)


def money(text: str | int | float) -> Decimal:
    return Decimal(str(text)).quantize(Decimal("0.01"))


DEFAULTS = {
    "vehicle": {
        "vehicle_type": "SUV", "manufacturer_name": "Kia", "condition": "Good", "model_name": "Plain", "year": 2001,
        "fuel_type": "Gas", "horsepower": 100, "description": None,
    },
    "vendor": {"phone_number": "1", "street": "s", "city": "c", "state": "t", "postal_code": "0"},
    "parts_order": {"vendor_name": "Acme", "total_cost": money(0)},
    "part": {"vendor_parts_number": "P1", "description": "part", "quantity": 1, "status": "Installed", "unit_price": money(1)},
    "customer": {
        "email": "e@x", "phone_number": "1", "street": "1 Main", "city": "Town", "state": "ST", "postal_code": "00123",
    },
    "individual_customer": {"first_name": "Ann", "last_name": "Lee"},
    "business_customer": {
        "business_name": "Firm", "contact_first_name": "P", "contact_last_name": "Q", "contact_title": "R",
    },
    "user": {"first_name": "Sam", "last_name": "Clerk", "role": "Manager"},
    "purchase": {"customer_id": 1, "username": "u", "purchase_price": money(1000), "purchased_on": DAY},
    "sale": {"customer_id": 1, "username": "u", "sale_price": money(900), "sold_on": DAY},
}


def frame(spark, table: str, rows: list[dict]):
    columns = schema.SCHEMAS[table]
    full = [{**DEFAULTS.get(table, {}), **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in columns) for r in full], columns)


def lot(spark, **tables: list[dict]) -> Tables:
    return empty_tables(spark, **{name: frame(spark, name, rows) for name, rows in tables.items()})


def rows(df, *columns: str) -> list[tuple]:
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def shuffle_files(spark) -> set[str]:
    """Names of the shuffle files this session has on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def new_shuffle_files(spark, before: set[str], seconds: float = 20) -> set[str]:
    """Those that came since and stay: files are removed in the background."""
    until = time.time() + seconds
    while (new := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return new
