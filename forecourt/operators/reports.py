"""The management reports.

Vehicles may have several purchases and several sales.  A report over "every purchase x every sale of a
vehicle" is computed from per-vehicle counts and sums, which gives the same totals as the multiplied rows
without producing them.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.joins import lookup
from forecourt.functions.money import exact_mean
from forecourt.operators.inventory import parts_cost_per_vehicle, parts_per_order
from forecourt.tables import Tables

# A seller is flagged from these averages per vehicle upwards.
FLAG_PARTS_QUANTITY = 5
FLAG_PARTS_COST = 500


def _times(count: str) -> Column:
    """A row count as an exact multiplier, wide enough for products of counts, days and cents."""
    return F.col(count).cast("decimal(12,0)")


def _ratio(total: Column, count: Column) -> Column:
    return total.cast("double") / count


def seller_history(tables: Tables) -> DataFrame:
    """Per seller: vehicles bought from them, average price, average parts quantity and cost per vehicle, flag."""
    per_order = parts_per_order(tables)
    per_vin = (
        tables.parts_order.join(per_order, "order_number")
        .groupBy("vin")
        .agg(F.sum("quantity").alias("_quantity"), F.sum("cost").alias("_cost"))
    )
    bought = tables.purchase.groupBy("customer_id", "vin").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("purchase_price").alias("_paid")
    )
    no_cost = F.lit(Decimal("0.00"))
    sellers = (
        lookup(bought, per_vin, "vin", "customer_id", tables.purchase)
        .groupBy("customer_id")
        .agg(
            F.sum("_n").alias("total_vehicles_sold"),
            F.sum("_paid").alias("_paid"),
            F.sum(F.col("_n") * F.coalesce("_quantity", F.lit(0))).alias("_quantity"),
            F.sum(F.coalesce("_cost", no_cost).cast("decimal(24,2)") * _times("_n")).alias("_cost"),
        )
    )
    firms = tables.business_customer.select("customer_id", "business_name")
    people = tables.individual_customer.select(
        "customer_id", F.concat("first_name", F.lit(" "), "last_name").alias("_person")
    )
    n = F.col("total_vehicles_sold")
    quantity, cost = _ratio(F.col("_quantity"), n), _ratio(F.col("_cost"), n)
    return (
        sellers.join(firms, "customer_id", "left")
        .join(people, "customer_id", "left")
        .select(
            "customer_id",
            F.coalesce("business_name", "_person").alias("seller_name"),
            "total_vehicles_sold",
            exact_mean(F.col("_paid"), n).alias("avg_purchase_price"),
            quantity.alias("avg_parts_quantity"),
            cost.alias("avg_parts_cost"),
            ((quantity >= FLAG_PARTS_QUANTITY) | (cost >= FLAG_PARTS_COST)).alias("flagged"),
        )
    )


def avg_inventory_time(tables: Tables) -> DataFrame:
    """Per vehicle type: average days from purchase to sale, both days counted; "N/A" without any sale.

    A sale dated before the purchase counts negative.
    """
    day = F.lit(date(1970, 1, 1))
    bought = tables.purchase.groupBy("vin").agg(
        F.count("purchased_on").alias("_p"), F.sum(F.datediff("purchased_on", day)).alias("_p_days")
    )
    sold = tables.sale.groupBy("vin").agg(
        F.count("sold_on").alias("_s"), F.sum(F.datediff("sold_on", day)).alias("_s_days")
    )
    pairs = _times("_p") * _times("_s")
    days = _times("_p") * F.col("_s_days") - _times("_s") * F.col("_p_days") + pairs
    per_type = (
        tables.vehicle.select("vin", "vehicle_type")
        .join(bought, "vin", "left")
        .join(sold, "vin", "left")
        .groupBy("vehicle_type")
        .agg(F.sum(days).alias("_days"), F.sum(pairs).alias("_pairs"), F.sum("_s").alias("_sales"))
    )
    avg_days = exact_mean(F.col("_days"), F.col("_pairs"))
    text = F.when(F.coalesce("_sales", F.lit(0)) == 0, F.lit("N/A")).otherwise(avg_days.cast("string"))
    # Declared types only; joined after the aggregate, when there is one row per type.
    return per_type.join(tables.vehicle_type, "vehicle_type", "left_semi").select("vehicle_type", avg_days.alias("avg_days"), text.alias("avg_inventory_time"))


def price_per_condition(tables: Tables) -> DataFrame:
    """Per vehicle type: average purchase price in each of the four conditions, 0 where there is none."""
    bought = tables.purchase.groupBy("vin").agg(
        F.count("purchase_price").alias("_n"), F.sum("purchase_price").alias("_paid")
    )
    priced = tables.vehicle.select("vin", "vehicle_type", "condition").join(bought, "vin", "left")
    cells = (
        priced.groupBy("vehicle_type")
        .pivot("condition", list(schema.CONDITIONS))
        .agg(F.sum("_paid").alias("paid"), F.sum("_n").alias("n"))
    )

    def mean(condition: str) -> Column:
        ratio = F.try_divide(F.col(f"{condition}_paid").cast("double"), F.col(f"{condition}_n"))
        return F.coalesce(ratio, F.lit(0.0)).alias(condition.lower().replace(" ", "_"))

    return cells.select("vehicle_type", *[mean(c) for c in schema.CONDITIONS])


def parts_statistics(tables: Tables) -> DataFrame:
    """Per vendor with orders: parts quantity and money spent."""
    spent = (
        tables.parts_order.join(parts_per_order(tables), "order_number")
        .groupBy(F.col("vendor_name").alias("name"))
        .agg(F.sum("quantity").alias("total_parts_quantity"), F.sum("cost").alias("total_amount_spent"))
    )
    vendors = tables.vendor.select("name")
    return vendors.join(spent, "name").withColumnRenamed("name", "vendor_name")


def monthly_sales(tables: Tables) -> DataFrame:
    """Per year and month: vehicles sold, gross income, and income net of purchase price and parts.

    Sales of vehicles we never bought are left out; a vehicle bought twice counts its sale twice.
    """
    sold = tables.sale.groupBy("vin", F.year("sold_on").alias("year"), F.month("sold_on").alias("month")).agg(
        F.count(F.lit(1)).alias("_s"), F.sum("sale_price").alias("_earned")
    )
    bought = tables.purchase.groupBy("vin").agg(
        F.count(F.lit(1)).alias("_p"), F.sum("purchase_price").alias("_paid")
    )
    joined = sold.join(bought, "vin").join(parts_cost_per_vehicle(tables), "vin", "left")
    pairs = (F.col("_s") * F.col("_p")).cast("decimal(16,0)")
    gross = F.col("_earned") * _times("_p")
    paid = F.col("_paid") * _times("_s")
    parts = F.coalesce("parts_cost", F.lit(Decimal("0.00"))).cast("decimal(22,2)") * pairs
    return (
        joined.groupBy("year", "month")
        .agg(
            F.sum(F.col("_s") * F.col("_p")).alias("vehicles_sold"),
            F.sum(gross).alias("gross_sales_income"),
            F.sum(gross - paid - parts).alias("net_income"),
        )
        .where(F.col("vehicles_sold") > 0)
    )


def sales_by_salesperson(tables: Tables) -> DataFrame:
    """Per year, month and salesperson: vehicles sold and sales total."""
    sold = tables.sale.groupBy(
        F.year("sold_on").alias("year"), F.month("sold_on").alias("month"), "username"
    ).agg(F.count(F.lit(1)).alias("vehicles_sold"), F.sum("sale_price").alias("total_sales"))
    return _with_names(tables, sold)


def monthly_sales_drilldown(tables: Tables, year: int | str, month: int | str) -> DataFrame:
    """The same for one month; the month is a date range, so it reaches the scan as a pushed filter."""
    year, month = int(year), int(month)
    first = date(year, month, 1)
    following = date(year + month // 12, month % 12 + 1, 1)
    in_month = tables.sale.where((F.col("sold_on") >= F.lit(first)) & (F.col("sold_on") < F.lit(following)))
    sold = in_month.groupBy("username").agg(
        F.count(F.lit(1)).alias("vehicles_sold"), F.sum("sale_price").alias("total_sales")
    )
    return _with_names(tables, sold)


def _with_names(tables: Tables, sold: DataFrame) -> DataFrame:
    """Names are joined after the aggregate, so a busy salesperson is one row per group by then."""
    people = tables.user.select("username", "first_name", "last_name")
    kept = [c for c in ("year", "month") if c in sold.columns]
    return sold.join(people, "username").select(
        *kept, "username", "first_name", "last_name", "vehicles_sold", "total_sales"
    )
