"""The fourteen tables as one bundle, and their Parquet form on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt import schema


Frame = DataFrame | Callable[[], DataFrame]


class Tables:
    """The tables as attributes, e.g. `tables.vehicle`.

    A table is given as a frame, or as a function that builds it; the function runs when the table is first
    asked for, so an operator only pays for planning the tables it reads.
    """

    def __init__(self, **frames: Frame) -> None:
        wrong = set(frames) ^ set(schema.TABLE_NAMES)
        if wrong:
            raise TypeError(f"missing or unknown tables: {sorted(wrong)}")
        self._frames: dict[str, Frame] = dict(frames)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._frames:
            raise AttributeError(name)
        return self[name]

    def with_tables(self, **changed: Frame) -> Tables:
        """The same bundle with some tables swapped."""
        return Tables(**{**self._frames, **changed})

    def appended(self, **new_rows: DataFrame) -> Tables:
        """The next snapshot: new rows added to the named tables."""
        return self.with_tables(**{name: self[name].unionByName(rows) for name, rows in new_rows.items()})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast a frame to the declared columns of `table` (other columns, such as passwords, are dropped)."""
    return df.selectExpr(*[f"cast({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.SCHEMAS[table]])


def seed_rows(spark: SparkSession, table: str) -> DataFrame:
    """The constant starting rows of a dimension table."""
    values = {"color": schema.COLORS, "vehicle_type": schema.VEHICLE_TYPES, "manufacturer": schema.MANUFACTURERS}[table]
    return constant_rows(spark, {schema.SCHEMAS[table].names[0]: values})


def constant_rows(spark: SparkSession, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """A small constant text table, planned inside the JVM with a known small size."""
    lists = [F.array(*[F.lit(v) for v in values]).alias(name) for name, values in columns.items()]
    rows = spark.range(1).select(F.inline(F.arrays_zip(*lists)))
    return rows.select(*[F.col(c).alias(name) for c, name in zip(rows.columns, columns, strict=True)])


def empty_tables(spark: SparkSession, **given: DataFrame) -> Tables:
    """A bundle with seeded dimensions and empty fact tables, except for the frames passed in."""
    built = {}
    for name, columns in schema.SCHEMAS.items():
        if name in given:
            built[name] = conform(given[name], name)
        elif name in ("color", "vehicle_type", "manufacturer"):
            built[name] = seed_rows(spark, name)
        else:
            built[name] = spark.createDataFrame([], columns)
    return Tables(**built)
