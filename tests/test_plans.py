"""Shape of the physical plans, and relations that must hold between results."""

import re

import pytest
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.operators import batches, inventory, quality, reports, vehicles
from forecourt.operators.inventory import parts_per_order
from forecourt.plans import dealership_view as view
from forecourt.plans.registry import queries
from forecourt.sources.bucketed import read_catalog, write_bucketed
from forecourt.sources.files import read_tables, write_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, testdata):
    return view.dealership(view.Source(spark, testdata))


@pytest.mark.parametrize("name", list(queries()))
def test_no_nested_loops_and_no_python(spark, testdata, name):
    shown = plan(queries()[name](spark, testdata))
    for unwanted in ("NestedLoop", "CartesianProduct", "PythonUDF", "BatchEval", "ArrowEval", "ExistingRDD"):
        assert unwanted not in shown


def test_hash_joins_are_never_forced(spark, testdata):
    """No broadcast hint anywhere: sizes decide, so plans without statistics-based broadcasts stay possible."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in queries().items():
            assert "BroadcastHashJoin" not in plan(query(spark, testdata)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    write_tables({name: tables[name] for name in ("sale", "user", "vehicle", "part", "parts_order", "vehicle_color", "purchase")}, folder)
    return read_tables(spark, folder)


def test_month_filter_reaches_the_scan(stored):
    shown = plan(reports.monthly_sales_drilldown(stored, 1997, 5))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(sold_on,1997-05-01\), LessThan\(sold_on,1997-06-01\)", shown)
    assert "customer_id" not in shown


def test_vin_filter_reaches_every_scan(stored):
    shown = plan(vehicles.search_vehicles(stored, "Manager", vin="VIN00000000000042"))
    scans = [line for line in shown.splitlines() if "FileScan" in line]
    assert len(scans) >= 4
    assert all("EqualTo(vin,VIN00000000000042)" in s or "In(vin" in s for s in scans)


def test_pending_reads_two_columns_of_parts(stored):
    shown = plan(inventory.count_pending_parts(stored))
    assert "struct<order_number:string,status:string>" in shown


def test_references_meet_each_parent_in_one_join(tables):
    parents = {(ref.parent, ref.parent_column) for ref in schema.FOREIGN_KEYS}
    assert len(re.findall(r"(?:BroadcastHash|SortMerge|ShuffledHash)Join", plan(quality.check_foreign_keys(tables)))) == len(parents)


def test_vehicles_with_several_deals_have_every_case(spark, testdata):
    several = view.several_deals(view.Source(spark, testdata))
    per_vin = several.sale.groupBy("vin").count().join(several.purchase.groupBy("vin").count().toDF("vin", "p"), "vin", "left")
    assert {(1, 1), (1, 2), (2, 3), (3, 3), (1, None), (2, None)} <= {(r["count"], r.p) for r in per_vin.collect()}
    assert "N/A" in {r.avg_inventory_time for r in reports.avg_inventory_time(several).collect()}
    assert reports.seller_history(several).where("seller_name IS NULL").count() > 0


@pytest.mark.parametrize("hot_purchases", [1, 30])
def test_a_vehicle_with_a_third_of_the_deals_is_spread(spark, tables, hot_purchases):
    vins = spark.range(6000).selectExpr("concat('V', id) AS vin")
    vehicle = vins.selectExpr(
        "vin", "'SUV' AS vehicle_type", "'Kia' AS manufacturer_name", "'Good' AS condition", "'m' AS model_name",
        "2001 AS year", "'Gas' AS fuel_type", "100 AS horsepower", "'' AS description",
    )
    deal = "1L AS customer_id", "'u' AS username"
    sale = vins.selectExpr("vin", *deal, "cast(5 AS decimal(12,2)) AS sale_price", "date'2024-01-02' AS sold_on").unionByName(
        spark.range(3000).selectExpr("'V7' AS vin", *deal, "cast(id AS decimal(12,2)) AS sale_price", "date'2024-01-03' AS sold_on")
    )
    purchase = vins.selectExpr(
        "vin", *deal, "cast(5 AS decimal(12,2)) AS purchase_price", "date'2024-01-01' AS purchased_on"
    ).unionByName(
        spark.range(hot_purchases - 1).selectExpr(
            "'V7' AS vin", *deal, "cast(id + 9 AS decimal(12,2)) AS purchase_price", "date'2023-01-03' AS purchased_on"
        )
    )
    lot = tables.with_tables(vehicle=vehicle, sale=sale, purchase=purchase)
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        shares = vehicles.vehicle_base(lot).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    total = sum(r["count"] for r in shares)
    assert total == 5999 + 3001 * hot_purchases
    assert max(r["count"] for r in shares) <= 2 * total / 16


def test_available_and_pending_make_up_the_unsold(tables):
    counts = inventory.vehicle_counts(tables).first()
    assert counts.available_count + counts.pending_parts_count == inventory.unsold_vehicles(tables).count()


def test_drilldown_adds_up_to_the_month(tables):
    monthly = {(r.year, r.month): r.gross_sales_income for r in reports.monthly_sales(tables).collect()}
    people = reports.sales_by_salesperson(tables).groupBy("year", "month").agg(F.sum("total_sales").alias("t"))
    assert {(r.year, r.month): r.t for r in people.collect()} == monthly


def test_vendor_spending_adds_up_to_the_part_lines(tables):
    spent = reports.parts_statistics(tables).agg(F.sum("total_amount_spent")).first()[0]
    assert spent == parts_per_order(tables).agg(F.sum("cost")).first()[0]


def test_roles_nest(tables):
    seen = [
        {r.vin for r in vehicles.search_vehicles(tables, role).select("vin").collect()}
        for role in ("Public", "Inventory clerk", "Manager")
    ]
    assert seen[0] < seen[1] < seen[2]


def test_accepted_and_rejected_make_up_the_batch(spark, testdata, tables):
    source = view.Source(spark, testdata)
    for apply, batch, table in (
        (batches.apply_sales, view.sale_submissions, "sale"),
        (batches.apply_parts_orders, view.parts_order_submissions, "parts_order"),
        (batches.apply_vendor_batch, view.vendor_submissions, "vendor"),
    ):
        submitted = batch(source)
        result = apply(tables, submitted)
        assert result.new_rows[table].count() + result.rejects.count() == submitted.count() > 0


def test_statuses_never_move_back(spark, testdata, tables):
    after = batches.apply_status_transitions(tables, view.status_updates(view.Source(spark, testdata)))
    rank = F.array_position(F.array(F.lit("Ordered"), F.lit("Received"), F.lit("Installed")), F.col("status"))
    keys = ["order_number", "vendor_parts_number"]
    before = tables.part.select(*keys, rank.alias("b"))
    assert before.join(after.select(*keys, rank.alias("a")), keys).where("a < b").count() == 0


def test_bucketed_tables_join_without_shuffling_the_vehicles(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("buckets"))
    names = ("vehicle", "vehicle_color", "sale", "purchase", "parts_order", "part")
    spark.sql("CREATE DATABASE IF NOT EXISTS lot_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed({name: tables[name] for name in names}, "lot_test", 4, location=folder)
        stored = read_catalog(spark, "lot_test")
        cost = stored.vehicle.join(inventory.parts_cost_per_vehicle(stored), "vin", "left").join(
            inventory.vehicle_colors(stored), "vin", "left"
        )
        assert "Exchange" not in plan(cost)
        assert "Exchange" not in plan(inventory.unsold_vehicles(stored))
        assert inventory.unsold_vehicles(stored).count() == inventory.unsold_vehicles(tables).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS lot_test.{name}")


def test_the_caller_says_which_tables_stay_plain(spark, tables, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS plain_test")
    try:
        frames = {name: tables[name] for name in ("sale", "purchase")}
        write_bucketed(frames, "plain_test", 4, plain=["sale"], location=str(tmp_path))
        described = {n: spark.sql(f"DESCRIBE EXTENDED plain_test.{n}").collect() for n in frames}
        assert {n: any(r[0] == "Num Buckets" for r in d) for n, d in described.items()} == {"sale": False, "purchase": True}
    finally:
        for name in ("sale", "purchase"):
            spark.sql(f"DROP TABLE IF EXISTS plain_test.{name}")
