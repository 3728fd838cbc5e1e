"""Joins, numbering, reshaping and text rules against plain formulations."""

import random

import pytest
from lot import new_shuffle_files, rows, shuffle_files
from pyspark.sql import Window
from pyspark.sql import functions as F

from forecourt.functions.joins import attach_distinct, attach_many, first_per_key, lookup, lookup_and_minima, lookup_by_counts, mark_rows
from forecourt.functions.lineage import SHUFFLE_CLEANUP, pin
from forecourt.functions.numbering import number_rows, number_rows_by_hash
from forecourt.functions.reshape import attribute_rows
from forecourt.functions.text import capitalised, keyword_pattern, order_number


@pytest.fixture(scope="module")
def hot(spark):
    """Keys a (a third of the rows, with copies), b..; key z occurs on the left only."""
    many = [("a", i % 40, None if i % 7 == 0 else "x") for i in range(100)] + [(f"k{i}", i, "y") for i in range(200)]
    left = [("a", 1), ("z", 2)] + [(f"k{i}", i) for i in range(0, 200, 2)]
    return spark.createDataFrame(left, "key string, l int"), spark.createDataFrame(many, "key string, m int, t string")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("salts", [1, 3, 4096])
def test_attach_distinct_equals_plain_join(hot, how, salts):
    one, many = hot
    attached = attach_distinct(one, many, "key", how, salts)
    assert rows(attached, "key", "l", "m", "t") == rows(one.join(many.distinct(), "key", how), "key", "l", "m", "t")


@pytest.mark.parametrize("salts", [1, 3, 4096])
def test_attach_many_equals_plain_join(hot, salts):
    one, many = hot
    left = one.join(many.select("key", F.col("m").alias("n")).where("m < 20"), "key", "left")
    base = left.select("key", "n").unionByName(one.select("key", F.lit(99).alias("n")))
    attached = attach_many(left, many, "key", ["n"], base, salts)
    assert rows(attached, "key", "l", "n", "m", "t") == rows(left.join(many.distinct(), "key", "left"), "key", "l", "n", "m", "t")


def test_attach_distinct_spreads_a_hot_key(hot):
    one, many = hot
    salted = many.where("key = 'a'").withColumn("s", F.pmod(F.xxhash64("m", "t"), F.lit(4096)))
    assert salted.select("s").distinct().count() > 30


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("salts", [1, 5, 1024])
def test_lookup_equals_plain_join(spark, how, salts):
    many = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(300)], "id int, key string"
    )
    one = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(25)], ("unused", 9)], "key string, v int")
    found = lookup(many, one, "key", "id", many, how, salts)
    plain = many.join(one, "key", how)
    assert rows(found, *plain.columns) == rows(plain)


def test_lookup_collects_no_set_per_key(spark):
    many = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "c")], "id int, key string")
    one = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "key string, v int")
    found = lookup(many, one, "key", "id")
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.v) for r in found.collect()) == [(1, 10), (2, 10), (2, 10), (3, None), (4, None)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("salts", [1, 5, 1024])
def test_lookup_by_counts_equals_plain_join(spark, how, salts):
    many = spark.range(4000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 50))) AS key", "if(id % 5 = 0, null, 'x') AS other"
    )
    one = [("hot", "x", 1), ("hot", "x", 2), ("unused", "x", 9), ("k1", None, 8), *[(f"k{i}", "x", i) for i in range(25)]]
    one = spark.createDataFrame(one, "key string, other string, v int")
    found = lookup_by_counts(many, one, ["key", "other"], "id", how=how, salts=salts)
    plain = many.join(one, ["key", "other"], how)
    assert rows(found, *plain.columns) == rows(plain)
    assert lookup_by_counts(many.limit(0), one, ["key", "other"], "id", how=how, salts=salts).count() == 0


def test_lookup_by_counts_cuts_hot_keys_only(spark):
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(100_000).selectExpr("id", "if(id % 2 = 0, -1, id) AS key")
        one = spark.range(-1, 100_000).selectExpr("id AS key", "1 AS v")
        found = lookup_by_counts(many, one, "key", "id")
        shares = found.groupBy(F.spark_partition_id()).agg(F.count("v").alias("n")).collect()
        cut = [e.split("#")[0] for e in found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1:]]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in shares) == 100_000 and max(r.n for r in shares) <= 2 * 100_000 / 16
    assert cut.count("key") == 2  # each side moves once


@pytest.mark.parametrize("salts", [1, 5, 1024])
def test_lookup_and_minima_equals_joins_and_a_group(spark, salts):
    many = spark.range(4000).selectExpr(
        "7000 - id AS id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 50))) AS key", "if(id % 5 = 0, null, id % 11) AS m"
    )
    one = spark.createDataFrame([("hot", 1), ("hot", 2), ("unused", 9), *[(f"k{i}", i) for i in range(25)]], "key string, v int")
    minima = {"_a": F.col("id"), "_b": F.when(F.col("m") > 5, F.col("id"))}
    found = lookup_and_minima(many, one, ["key"], "id", minima, salts)
    least = many.groupBy("key").agg(*[F.min(value).alias(name) for name, value in minima.items()])
    plain = many.join(one, "key", "left").join(least, "key", "left")
    assert found.columns == plain.columns and rows(found) == rows(plain)


def test_mark_rows_on_two_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x")], "id int, p string, q string")
    keys = spark.createDataFrame([("a", "x")], "p string, q string")
    assert rows(mark_rows(df, keys, ["p", "q"], "hit", "id"), "id", "hit") == [(1, True), (2, False), (3, False)]


def test_number_rows_matches_a_window(spark):
    rng = random.Random(1)
    ids = rng.sample(range(300), 120) + [2**21 + i for i in range(50)] + [2**42 + 7, 2**42 + 2**21 + 1, 2**62]
    data = spark.createDataFrame([(i, "hot" if n % 3 else f"g{n % 5}") for n, i in enumerate(ids)], "id long, g string")
    expected = data.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("id")).cast("long"))
    assert rows(number_rows(data, "id", ["g"], "n"), "id", "g", "n") == rows(expected)
    whole = data.withColumn("n", F.row_number().over(Window.orderBy("id")).cast("long"))
    assert rows(number_rows(data, "id", name="n"), "id", "g", "n") == rows(whole)


def test_dense_ids_are_numbered_by_many_tasks(spark):
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        numbered = number_rows(spark.range(1_000_000).withColumn("wide", F.lit("x")), "id", name="n")
        shares = numbered.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.expr("n <> id + 1")).alias("wrong"))
        found = shares.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in found) == 1_000_000 and not any(r.wrong for r in found)
    assert max(r.n for r in found) <= 2 * 1_000_000 / 16


def test_number_rows_by_hash_is_dense_and_repeatable(spark):
    data = spark.range(500).select(F.concat(F.lit("id"), "id").alias("key"))
    once, again = number_rows_by_hash(data, ["key"]), number_rows_by_hash(data.repartition(7), ["key"])
    assert rows(once, "key", "row_no") == rows(again, "key", "row_no")
    assert sorted(r.row_no for r in once.collect()) == list(range(1, 501))


def test_first_per_key_skips_ineligible(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, "b", False)], "id long, k string, ok boolean")
    flagged = first_per_key(df, "k", "id", F.col("ok"), "first")
    assert rows(flagged, "id", "first") == [(1, False), (2, True), (3, False), (4, False)]


def test_attribute_rows_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([("v", 1, None)], "vin string, a int, b string")
    assert rows(attribute_rows(df, "vin", {"a": "A", "b": "B"})) == [("v", 1, "A", "1"), ("v", 2, "B", None)]


@pytest.mark.parametrize(
    ("typed", "text", "hit"),
    [
        ("a%c", "xabcx", True),
        ("a_c", "abc", True),
        (r"100\%", "100% wool", True),
        (r"100\%", "1000 wool", False),
        (r"c\d", "xcdx", True),
        ("\\\\", "back\\slash", True),
        ("ABC", "xabcx", True),
    ],
)
def test_keyword_pattern(spark, typed, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").ilike(keyword_pattern(typed))).first()[0] is hit


def test_text_rules(spark):
    df = spark.createDataFrame([("inventory CLERK", 7), ("x", 1000)], "t string, n int")
    made = df.select(capitalised(F.col("t")), order_number(F.lit("V"), F.col("n")))
    assert rows(made) == [("Inventory clerk", "V-007"), ("X", "V-1000")]


def test_pin_writes_parquet_to_the_given_folder(spark, tmp_path):
    pinned = pin(spark.range(5), str(tmp_path))
    assert pinned.count() == 5 and pinned.columns == ["id"]
    assert len(list(tmp_path.glob("pinned-*/*.parquet"))) > 0


def test_pin_leaves_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    pinned = pin(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path))
    assert not new_shuffle_files(spark, before) and pinned.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
