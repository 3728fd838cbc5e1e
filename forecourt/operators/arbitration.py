"""Which of several rows that claim one key may have it: one pass over all key domains of a load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.joins import keys_of, lookup
from forecourt.functions.lineage import pin
from forecourt.functions.numbering import number_rows_by_hash


def with_row(raw: DataFrame, line_no: str, into: str = "_row") -> DataFrame:
    """Add a sortable number per row: `line_no` where the rows have one, else a number fixed by the row's contents.

    The latter sorts whole rows, so those are stored once (`functions.lineage.pin`).
    """
    if line_no in raw.columns:
        return raw.withColumn(into, F.col(line_no))
    return pin(number_rows_by_hash(raw, raw.columns, into))


def reject_later_claims(rows: DataFrame, claims: Mapping[str, Column], row: str = "_row") -> DataFrame:
    """Add the names of lost claims to `reasons`: of the rows that claim one key, the first (by `row`) keeps it.

    `claims` gives the key of each domain by the reason that a loser gets; NULL claims nothing.  Only rows that are fine so
    far take part, so a broken row never costs a good one its key.  All domains go through one count per (domain, key)
    and one salted join of narrow rows; a key that very many rows claim is cut into pieces, and the verdicts come back by
    row.
    """
    each = F.array(*[F.struct(F.lit(name).alias("_reason"), key.cast("string").alias("_key")) for name, key in claims.items()])
    claimed = rows.where(F.size("reasons") == 0).select(row, F.inline(each)).where(F.col("_key").isNotNull())
    contested = claimed.groupBy("_reason", "_key").agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n"))
    contested = contested.where(F.col("_n") > 1).drop("_n")
    lost = lookup(claimed, contested, ["_reason", "_key"], row, how="inner").where(F.col(row) != F.col("_first"))
    verdicts = lost.groupBy(row).agg(F.sort_array(F.collect_set("_reason")).alias("_lost"))
    judged = rows.join(verdicts, row, "left")
    none = F.array().cast("array<string>")
    return judged.withColumn("reasons", F.concat("reasons", F.coalesce("_lost", none))).drop("_lost")


def mark_unknown(rows: DataFrame, known: DataFrame, key: str, column: str, flag: str) -> DataFrame:
    """Add boolean `flag`: `column` does not occur among `key` of the dimension table `known`.

    A plain join: Spark's own size check broadcasts a small dimension, and then a hot value costs nothing.
    """
    keys = keys_of(known, key).select(F.col(key).alias(column), F.lit(True).alias("_known"))
    return rows.join(keys, column, "left").withColumn(flag, F.col("_known").isNull()).drop("_known")
