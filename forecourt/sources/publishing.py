"""Publishing a whole new snapshot of the tables: all of it or nothing, and a batch only once.

A snapshot is a folder named after its batch.  It is written and checked first; then one catalog command makes it the current
one, by a property of the database that names the folder.  Readers go by that property, so they see all tables of one
snapshot.  A batch that fails on the way changes nothing that anyone reads; run again, it replaces its own folder.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.lineage import delete_folder
from forecourt.operators import quality
from forecourt.sources.files import read_tables, write_tables
from forecourt.tables import Tables

CURRENT = "forecourt.snapshot"
SHOWN = 20


class RefusedSnapshot(ValueError):
    """The checks found something; `findings` has the first rows of each check."""

    def __init__(self, findings: dict[str, list]) -> None:
        super().__init__(f"snapshot refused: {findings}")
        self.findings = findings


def _property(spark: SparkSession, database: str) -> dict[str, list[str]]:
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED {database}").where("info_name = 'Properties'").collect()
    found = rows[0]["info_value"] if rows else ""
    at = found.find(f"({CURRENT},")
    if at < 0:
        return {"folder": [], "batches": []}
    text = found[at + len(CURRENT) + 2 :]
    return json.loads(bytes.fromhex(text[: text.index(")")]).decode())


def findings_of(tables: Tables) -> dict[str, list]:
    """The first rows of each check that finds something: keys, references, domains."""
    checks = {
        "primary_keys": quality.check_primary_keys(tables),
        "foreign_keys": quality.check_foreign_keys(tables),
        "domains": quality.check_domains(tables).where(F.col("violations") > 0),
    }
    found = {name: [tuple(r) for r in rows.take(SHOWN)] for name, rows in checks.items()}
    return {name: rows for name, rows in found.items() if rows}


def publish(tables: Tables, database: str, folder: str, batch_id: str) -> bool:
    """Make `tables` the current snapshot of `database`, as `folder`/`batch_id`; False if that batch was published before.

    `tables` may be built from the snapshot that is current now, which stays as it is.  Raises `RefusedSnapshot`, and leaves
    nothing behind, if a declared key, reference or domain does not hold.  One writer at a time: two batches built from the
    same snapshot would each lack the other's rows.
    """
    spark = tables.vehicle.sparkSession
    state = _property(spark, database)
    if batch_id in state["batches"]:
        return False
    path = f"{folder}/{batch_id}"
    write_tables({name: tables[name] for name in schema.TABLE_NAMES}, path)
    findings = findings_of(read_tables(spark, path))
    if findings:
        delete_folder(spark, path)
        raise RefusedSnapshot(findings)
    state = {"folder": [path], "batches": [*state["batches"], batch_id]}
    text = json.dumps(state).encode().hex()
    spark.sql(f"ALTER DATABASE {database} SET DBPROPERTIES ('{CURRENT}' = '{text}')")
    return True


def read_published(spark: SparkSession, database: str) -> Tables:
    """The tables of the current snapshot."""
    state = _property(spark, database)
    if not state["folder"]:
        raise ValueError(f"nothing has been published in {database}")
    return read_tables(spark, state["folder"][0])
