"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Session setting: upper bound on the pieces one hot key is cut into.  Keys with few rows are unaffected by its size, so
# raise it with the data: rows of the hottest key / rows that fit one task.
SALTS_SETTING = "spark.forecourt.salts"
DEFAULT_SALTS = 1024


def salts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SALTS_SETTING, str(DEFAULT_SALTS)))


def _salt(columns: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def _spread(one: DataFrame, salted: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """`one` repeated once per salt that occurs with its key in `salted` (at most `salts` rows per key).

    Distinct pairs combine by hash before the shuffle; a set collected per key would be an object per key, which Spark sorts.
    """
    return one.join(salted.select(*key, "_salt").distinct(), list(key), how)


def lookup(
    many: DataFrame,
    one: DataFrame,
    key: str | Sequence[str],
    row_id: str | Sequence[str],
    base: DataFrame | None = None,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """`many JOIN one USING (key)` where `one` has one row per key and `many` may have a very hot key.

    Adaptive execution splits a skewed side only when both sides come straight from a shuffle, which a side
    aggregated by the join key never does.  So the rows of `many` are cut by a hash of `row_id`, and each
    row of `one` is repeated once per salt that really occurs for its key: same result as the plain join.
    `base` is the frame the keys and row ids come from, if that is shorter to compute than `many`.
    `how` is "left", "inner" or "left_semi".  Without `salts` the session's SALTS_SETTING holds.
    """
    salts = salts or salts_of(many)
    key = [key] if isinstance(key, str) else list(key)
    row_id = [row_id] if isinstance(row_id, str) else list(row_id)
    source = many if base is None else base
    keys = source.select(*key, _salt(row_id, salts).alias("_salt"))
    spread = _spread(one, keys, key, "inner")
    return many.withColumn("_salt", _salt(row_id, salts)).join(spread, [*key, "_salt"], how).drop("_salt")


# Rows are counted in so many buckets of keys.  A bucket is cut above CUT_FROM rows, and above so many times the mean.
KEY_BUCKETS = 2**14
CUT_FROM = 256
CUT_ABOVE_MEAN = 4


def _bucket(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(KEY_BUCKETS)).cast("int")


def _pieces(rows: DataFrame, key: Sequence[str], salts: int) -> Column:
    """The pieces the rows of each bucket of keys are cut into, 0 where it has none: one array, in order of the buckets."""
    every = rows.sparkSession.range(KEY_BUCKETS).select(F.col("id").cast("int").alias("_bucket"), F.lit(0).alias("_n"))
    counted = rows.select(_bucket(key).alias("_bucket"), F.lit(1).alias("_n")).unionByName(every)
    counted = counted.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    whole = counted.agg(F.array_sort(F.collect_list(F.struct("_bucket", "_n"))).alias("_all"), F.sum("_n").alias("_total"))
    most = F.greatest(F.lit(CUT_FROM), F.ceil(F.col("_total") * CUT_ABOVE_MEAN / KEY_BUCKETS))
    return whole.select(F.transform("_all", lambda b: F.least(F.lit(salts), F.ceil(b["_n"] / most)).cast("int"))).scalar()


def lookup_by_counts(
    many: DataFrame,
    one: DataFrame,
    key: str | Sequence[str],
    row_id: str | Sequence[str],
    base: DataFrame | None = None,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """`lookup`, for a `one` that is about as long as `many`: each side moves once, and no keys beside them.

    The rows of `many` are counted in buckets of keys first, which moves numbers only.  A bucket with far more rows than
    others is cut by a hash of `row_id`, and the rows of `one` in it are repeated once per piece; all other rows move as in
    the plain join.  Rows of `one` in buckets without a row of `many` stay behind.  Keys have the same types on both sides.
    """
    salts = salts or salts_of(many)
    key = [key] if isinstance(key, str) else list(key)
    row_id = [row_id] if isinstance(row_id, str) else list(row_id)
    pieces = F.element_at(_pieces(many if base is None else base, key, salts), _bucket(key) + 1)
    return _cut_by(many, pieces, row_id).join(_spread_by(one, pieces), [*key, "_salt"], how).drop("_salt")


def _cut_by(rows: DataFrame, pieces: Column, row_id: Sequence[str]) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.greatest(pieces, F.lit(1))).cast("int"))


def _spread_by(one: DataFrame, pieces: Column) -> DataFrame:
    wanted = one.withColumn("_pieces", pieces).where("_pieces > 0")
    return wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")


def lookup_and_minima(
    many: DataFrame,
    one: DataFrame,
    key: Sequence[str],
    row_id: str,
    minima: Mapping[str, Column],
    salts: int | None = None,
) -> DataFrame:
    """`lookup_by_counts` (left), and by name the least value of each of `minima` among all rows of `many` with the row's key.

    A key that is not cut has its rows in one place after the join, so its minima cost no further shuffle; only of keys in
    cut buckets are they gathered apart and joined.  A row with a NULL in its key has no minima.
    """
    key, salts = list(key), salts or salts_of(many)
    pieces = F.element_at(_pieces(many, key, salts), _bucket(key) + 1)
    joined = _cut_by(many, pieces, [row_id]).join(_spread_by(one, pieces), [*key, "_salt"], "left")
    piece = Window.partitionBy(*key, "_salt")
    joined = joined.withColumns({name: F.min(value).over(piece) for name, value in minima.items()})
    whole = many.where(pieces > 1).groupBy(*key).agg(*[F.min(value).alias(f"_whole{name}") for name, value in minima.items()])
    joined = joined.join(_spread_by(whole, pieces), [*key, "_salt"], "left")
    named = reduce(and_, [F.col(c).isNotNull() for c in key])
    least = {name: F.when(named, F.least(F.col(name), F.col(f"_whole{name}"))) for name in minima}
    return joined.withColumns(least).drop("_salt", *[f"_whole{name}" for name in minima])


def attach_distinct(
    one: DataFrame, many: DataFrame, key: str, how: str = "left", salts: int | None = None
) -> DataFrame:
    """`one LEFT JOIN (SELECT DISTINCT * FROM many) USING (key)`, with hot keys of `many` spread over tasks.

    With `how="inner"`, rows of `one` without a match are left out.  `one` has one row per key; see `attach_many`.

    Adaptive execution can split a skewed partition on the left of a left outer join but never on the right,
    so the right side is cut here, by a hash of its other columns.  Equal rows of `many` collapse on the map
    side first, so copies never travel.  The result equals the plain join.
    """
    payload = [c for c in many.columns if c != key]
    salts = salts or salts_of(many)
    salted = many.withColumn("_salt", _salt(payload, salts))
    return _spread(one, salted, [key], how).join(salted.distinct(), [key, "_salt"], how).drop("_salt")


def attach_many(
    left: DataFrame, many: DataFrame, key: str, row_id: Sequence[str], base: DataFrame, salts: int | None = None
) -> DataFrame:
    """`left LEFT JOIN (SELECT DISTINCT * FROM many) USING (key)` where a key may be hot on both sides.

    `left` is cut by a hash of `row_id` into parts, `many` by a hash of its other columns into salts.  Per key, the
    parts and the salts that occur are known; each row of `left` is repeated once per salt and each row of `many` once
    per part, so every (key, part, salt) meets in one place.  The result equals the plain join.

    `base` has `key` and `row_id` of all rows of `left`, and may have more; it is shorter to compute than `left`.
    """
    salts = salts or salts_of(many)
    cut = left.withColumn("_part", _salt(row_id, salts))
    parts = base.select(key, _salt(row_id, salts).alias("_part")).groupBy(key).agg(F.collect_set("_part").alias("_parts"))
    salted = many.withColumn("_salt", _salt([c for c in many.columns if c != key], salts))
    occurring = salted.groupBy(key).agg(F.collect_set("_salt").alias("_salts"))
    grid = parts.join(occurring, key)
    repeated_left = (
        cut.join(grid.select(key, F.explode("_parts").alias("_part"), "_salts"), [key, "_part"], "left")
        .withColumn("_salt", F.explode_outer("_salts"))
        .drop("_salts")
    )
    repeated_many = (
        salted.distinct()
        .join(grid.select(key, F.explode("_salts").alias("_salt"), "_parts"), [key, "_salt"])
        .withColumn("_part", F.explode("_parts"))
        .drop("_parts")
    )
    return repeated_left.join(repeated_many, [key, "_part", "_salt"], "left").drop("_part", "_salt")


def keys_of(df: DataFrame, key: str, flag: str | None = None) -> DataFrame:
    """Distinct non-null keys, de-duplicated before the shuffle; optionally with a constant TRUE marker column."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.withColumn(flag, F.lit(True)) if flag else keys


def mark(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Add boolean `flag`: does the row's key occur in `keys`?  Both sides have one row per key."""
    marked = df.join(keys.select(on, F.lit(True).alias("_hit")), on, "left")
    return _flagged(marked, flag)


def mark_rows(
    df: DataFrame, keys: DataFrame, on: str | Sequence[str], flag: str, row_id: str, base: DataFrame | None = None
) -> DataFrame:
    """The same for rows whose key may be very hot; see `lookup` for `row_id` and `base`."""
    on = [on] if isinstance(on, str) else list(on)
    return _flagged(lookup(df, keys.select(*on, F.lit(True).alias("_hit")), on, row_id, base), flag)


def _flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def first_per_key(
    df: DataFrame, key: str, order: str, eligible: Column, flag: str, base: DataFrame | None = None
) -> DataFrame:
    """Add boolean `flag`: TRUE on the eligible row with the smallest `order` (unique) of its key.

    A minimum is a partial aggregate, so a key with very many rows is never gathered in one task.
    """
    firsts = df.where(eligible).groupBy(key).agg(F.min(order).alias("_first"))
    joined = lookup(df, firsts, key, order, base)
    return joined.withColumn(flag, eligible & F.coalesce(F.col("_first") == F.col(order), F.lit(False))).drop("_first")
