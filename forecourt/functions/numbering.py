"""Row numbers without a window over an unbounded group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.lineage import pin

# Ids are read as digits of these widths, the lowest first; what is left on top has 16 bits.  No window below ever sees
# more than 2**13 distinct ids or 2**17 counts, however many rows the group has.
DIGIT_BITS = (13, 17, 17)
HASH_BUCKETS = 65536


def number_rows(df: DataFrame, order: str, group: Sequence[str] = (), name: str = "row_no") -> DataFrame:
    """Add `name` = 1, 2, 3, ... in ascending `order` within `group`.

    `order` must hold unique non-negative 64-bit integers.  Row number = position inside the block of ids with the
    same upper digits + rows in lower blocks, digit by digit; those come from counts, which combine before the
    shuffle, so even a single group of any size is numbered in parallel.
    """
    group = list(group)
    tagged = df.withColumn("_block", F.shiftright(F.col(order), DIGIT_BITS[0]))
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    ranked = tagged.withColumn("_inside", F.row_number().over(inside))
    counts = tagged.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    return (
        ranked.join(_rows_before(counts, group, DIGIT_BITS[1:]), [*group, "_block"])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_block", "_inside", "_before")
    )


def _rows_before(counts: DataFrame, group: list[str], digits: Sequence[int]) -> DataFrame:
    """(group, _block, _before): the rows in lower blocks, from `_n` per block."""
    if not digits:
        return _running_total(counts, group, "_block", "_before").drop("_n")
    within = counts.withColumn("_upper", F.shiftright("_block", digits[0]))
    lower = _running_total(within, [*group, "_upper"], "_block", "_lower").drop("_n")
    uppers = within.groupBy(*group, F.col("_upper").alias("_block")).agg(F.sum("_n").alias("_n"))
    higher = _rows_before(uppers, group, digits[1:]).withColumnRenamed("_block", "_upper")
    total = (F.col("_lower") + F.col("_before")).alias("_before")
    return lower.join(higher, [*group, "_upper"]).select(*group, "_block", total)


def number_rows_by_hash(df: DataFrame, keys: Sequence[str], name: str = "row_no") -> DataFrame:
    """Add dense `name` = 1, 2, 3, ... in an arbitrary but repeatable order fixed by the values of `keys`.

    Rows are spread by a hash of `keys`; each bucket is numbered on its own and shifted by the sizes of the
    buckets before it (at most 65,536 counts).  `keys` should identify a row.
    """
    bucketed = df.withColumn("_hash", F.xxhash64(*keys)).withColumn("_bucket", F.pmod("_hash", F.lit(HASH_BUCKETS)))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    ranked = bucketed.withColumn("_inside", F.row_number().over(inside))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _running_total(counts, [], "_bucket", "_before").drop("_n")
    return (
        ranked.join(offsets, "_bucket")
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_hash", "_bucket", "_inside", "_before")
    )


def number_in_order(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Add `name` = 1, 2, 3, ... in any order: rows are sorted in ranges, and a range starts after the rows before it.

    The sorted rows are stored once (`functions.lineage.pin`), so that numbers and rows belong together.  Equal rows of the
    order stay in one range: end it with columns that tell rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pin(ranged.withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits are the range, the lower 33 the place in it.
    placed = placed.withColumn("_block", F.shiftright("_at", 33))
    counts = placed.groupBy("_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = _running_total(counts, [], "_block", "_before").select("_block", (F.col("_before") - F.col("_first")).alias("_shift"))
    numbered = placed.join(starts, "_block").withColumn(name, (F.col("_at") + F.col("_shift") + 1).cast("bigint"))
    return numbered.drop("_at", "_block", "_shift")


def _running_total(counts: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """Sum of `_n` over the earlier rows of the group, excluding the row itself."""
    partition: list[str | Column] = list(group) or [F.lit(0)]
    earlier = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
