"""Raw wide rows, all text, to the normalized tables.

Blank cells mean "absent".  Rows that cannot be stored whole go to a rejects frame instead of stopping the load.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.joins import lookup
from forecourt.functions.lineage import pin
from forecourt.functions.numbering import number_rows, number_rows_by_hash
from forecourt.functions.text import blank_to_null, capitalised, is_blank
from forecourt.operators.arbitration import mark_unknown, reject_later_claims, with_row
from forecourt.operators.lookups import first_customer_per_identifier
from forecourt.tables import Tables, conform

# The columns of the raw files.
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "customers": (
        "customer_type", "email", "phone", "street", "city", "state", "postal", "biz_tax_id", "biz_name",
        "biz_contact_first", "biz_contact_last", "biz_contact_title", "person_ssn", "person_first", "person_last",
    ),
    "users": ("username", "password", "first_name", "last_name", "role"),
    "vendors": ("vendor_name", "phone", "street", "city", "state", "postal_code"),
    "vehicles": (
        "VIN", "vehicle_type", "condition", "manufacturer_name", "model_name", "year", "fuel_type", "horsepower",
        "description", "purchase_clerk", "purchased_from_customer", "price", "purchase_date", "colors", "sale_date",
        "sold_to_customer", "salesperson",
    ),
    "parts": ("VIN", "order_num", "vendor_name", "part_number", "price", "qty", "status", "description"),
}


# A raw row's place in its file, where it is known; never part of what identifies a row.
LINE_NO = "line_no"


@dataclass(frozen=True)
class Ingested:
    """Rows per target table, and the raw rows that were not loaded, with reasons."""

    rows: Mapping[str, DataFrame]
    rejects: DataFrame | None = None


def assign_customer_ids(raw: DataFrame, *, order_by: str | None = None, start: int | Column = 0) -> DataFrame:
    """Add dense `customer_id` = start + 1, start + 2, ...

    In ascending `order_by` (unique non-negative integers stored with the rows) if given, else in an order fixed by a
    hash of the row's contents, `line_no` left out.  So ids do not depend on how Spark split the files, and frames
    computed apart agree; rows equal in all columns share their ids among themselves in any order, which no table shows.
    Neither form sorts all rows in one task.
    """
    if order_by:
        numbered = number_rows(raw, order_by, name="_n")
    else:
        numbered = number_rows_by_hash(raw, [c for c in raw.columns if c != LINE_NO], "_n")
    return numbered.withColumn("customer_id", (F.col("_n") + start).cast("bigint")).drop("_n")


def _split(rows: DataFrame, *shown: str | Column) -> tuple[DataFrame, DataFrame]:
    """Rows without reasons, and the others as `shown` columns with their reasons."""
    return rows.where(F.size("reasons") == 0), rows.where(F.size("reasons") > 0).select(*shown, "reasons")


def _reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def ingest_customers(raw: DataFrame, *, order_by: str | None = None, start: int | Column = 0) -> Ingested:
    """Customers with their individual or business row; any other kind gets a plain customer row only.

    A person without SSN, a firm without tax id, and all but the first row of one SSN or tax id are rejected: accepted and
    rejected rows add up to the raw ones.  Ids are given to all raw rows, so those of rejected rows stay unused.  Rejects:
    customer_id, customer_type, identifier, reasons.
    """
    rows = assign_customer_ids(raw, order_by=order_by, start=start)
    person, firm = F.col("customer_type") == "person", F.col("customer_type") == "business"
    ssn = F.when(person, blank_to_null(F.col("person_ssn")))
    tax_id = F.when(firm, blank_to_null(F.col("biz_tax_id")))
    missing = [("missing_ssn", person & ssn.isNull()), ("missing_tax_id", firm & tax_id.isNull())]
    judged = reject_later_claims(
        rows.withColumn("reasons", _reasons(missing)), {"repeated_ssn": ssn, "repeated_tax_id": tax_id}, "customer_id"
    )
    rows, rejects = _split(judged, "customer_id", "customer_type", F.coalesce(ssn, tax_id).alias("identifier"))
    customer = rows.select(
        "customer_id",
        blank_to_null(F.col("email")).alias("email"),
        F.col("phone").alias("phone_number"),
        "street",
        "city",
        "state",
        F.col("postal").alias("postal_code"),
    )
    individual = rows.where(F.col("customer_type") == "person").select(
        "customer_id",
        F.col("person_first").alias("first_name"),
        F.col("person_last").alias("last_name"),
        F.col("person_ssn").alias("social_security_number"),
    )
    business = rows.where(F.col("customer_type") == "business").select(
        "customer_id",
        F.col("biz_name").alias("business_name"),
        F.col("biz_tax_id").alias("tax_identification_number"),
        F.col("biz_contact_first").alias("contact_first_name"),
        F.col("biz_contact_last").alias("contact_last_name"),
        F.col("biz_contact_title").alias("contact_title"),
    )
    return Ingested({"customer": customer, "individual_customer": individual, "business_customer": business}, rejects)


def _first_of_key(raw: DataFrame, key: str, line_no: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key that no earlier row has, and the others: `key`, reasons."""
    rows = with_row(raw, line_no)
    judged = rows.withColumn("reasons", _reasons([(f"missing_{key}", is_blank(F.col(key)))]))
    return _split(reject_later_claims(judged, {f"repeated_{key}": F.col(key)}), key)


def ingest_users(raw: DataFrame, *, line_no: str = LINE_NO) -> Ingested:
    """Staff without passwords; the account `owner` always has the role Owner.

    Of rows with one user name the first stays (by `line_no`, else by contents); rejects: username, reasons.
    """
    rows, rejects = _first_of_key(raw.drop("password"), "username", line_no)
    role = F.when(F.col("username") == "owner", F.lit("Owner")).otherwise(capitalised(F.col("role")))
    return Ingested({"user": conform(rows.withColumn("role", role), "user")}, rejects)


def ingest_vendors(raw: DataFrame, *, line_no: str = LINE_NO) -> Ingested:
    """Of rows with one name the first stays (by `line_no`, else by contents); rejects: vendor_name, reasons."""
    rows, rejects = _first_of_key(raw, "vendor_name", line_no)
    named = rows.withColumnsRenamed({"vendor_name": "name", "phone": "phone_number"})
    return Ingested({"vendor": conform(named, "vendor")}, rejects)


def split_colors(df: DataFrame, key: Column, colors: Column) -> DataFrame:
    """(vin, color_name): one row per color of a comma-separated list, trimmed, without repeats or blanks."""
    names = F.array_distinct(F.transform(F.split(colors, ","), lambda c: F.trim(c)))
    exploded = df.select(key.alias("vin"), F.explode(names).alias("color_name"))
    return exploded.where(F.col("color_name") != "").distinct()


def resolve_customer_id(
    tables: Tables,
    df: DataFrame,
    identifier: str,
    row_id: str | Sequence[str],
    into: str = "customer_id",
    base: DataFrame | None = None,
) -> DataFrame:
    """Add `into`: the customer id behind an SSN or tax id, NULL when unknown.

    One party may be behind very many rows; `row_id` tells the rows apart, and `base` may give a shorter
    plan of the same rows (see `functions.joins.lookup`).
    """
    known = first_customer_per_identifier(tables).select(
        F.col("identifier").alias(identifier), F.col("customer_id").alias(into)
    )
    return lookup(df, known, identifier, row_id, base)


def ingest_vehicles(
    tables: Tables, raw: DataFrame, *, sale_price_col: str = "price", line_no: str = LINE_NO, pinned: bool = True
) -> Ingested:
    """One wide row to a vehicle, a purchase, its colors and, when it has a sale date, a sale.

    The sale price is read from the purchase price cell unless `sale_price_col` names another.  A row is rejected whole for
    an unknown seller, buyer, clerk, salesperson, vehicle type or manufacturer, a number or date that does not parse, or a
    VIN that an earlier row has (by `line_no`, else by contents; rows rejected for another reason claim no VIN).
    The judged rows are stored once (`functions.lineage.pin`); with `pinned=False` everything stays lazy.
    """
    is_sale = ~is_blank(F.col("sale_date"))
    raw = with_row(raw, line_no)
    rows = resolve_customer_id(tables, raw, "purchased_from_customer", "_row", "seller_id")
    rows = resolve_customer_id(tables, rows, "sold_to_customer", "_row", "buyer_id", raw)
    rows = rows.withColumns(
        {
            "_year": F.col("year").try_cast("int"),
            "_horsepower": F.col("horsepower").try_cast("int"),
            "_paid": F.col("price").try_cast(schema.MONEY),
            "_bought": F.col("purchase_date").try_cast("date"),
            "_earned": F.col(sale_price_col).try_cast(schema.MONEY),
            "_sold": F.col("sale_date").try_cast("date"),
        }
    )
    rules = [
        ("unknown_seller", F.col("seller_id").isNull()),
        ("unknown_buyer", is_sale & F.col("buyer_id").isNull()),
        ("bad_year", F.col("_year").isNull()),
        ("bad_horsepower", F.col("_horsepower").isNull()),
        ("bad_price", F.col("_paid").isNull()),
        ("bad_purchase_date", F.col("_bought").isNull()),
        ("bad_sale_price", is_sale & F.col("_earned").isNull()),
        ("bad_sale_date", is_sale & F.col("_sold").isNull()),
    ]
    rules.append(("missing_vin", is_blank(F.col("VIN"))))
    for parent, key, column, reason in (
        ("vehicle_type", "vehicle_type", "vehicle_type", "unknown_vehicle_type"),
        ("manufacturer", "manufacturer_name", "manufacturer_name", "unknown_manufacturer"),
        ("user", "username", "purchase_clerk", "unknown_clerk"),
        ("user", "username", "salesperson", "unknown_salesperson"),
    ):
        rows = mark_unknown(rows, tables[parent], key, column, f"_{reason}")
        unknown = F.col(f"_{reason}")
        rules.append((reason, is_sale & unknown if column == "salesperson" else unknown))
    # The reasons are built once: each step that added to them would be written out again in every filter on them.  The judged
    # rows are stored once: the claims read them four times, each of which would look up both parties anew.
    rows = rows.withColumn("reasons", _reasons(rules)).select(
        "_row", "VIN", "vehicle_type", "manufacturer_name", "condition", "model_name", "_year", "fuel_type", "_horsepower",
        "description", "seller_id", "purchase_clerk", "_paid", "_bought", "colors", "sale_date", "buyer_id", "salesperson",
        "_earned", "_sold", "reasons",
    )
    rows = pin(rows) if pinned else rows
    fine, rejects = _split(reject_later_claims(rows, {"repeated_vin": F.col("VIN")}), F.col("VIN").alias("vin"))
    vehicle = fine.select(
        F.col("VIN").alias("vin"), "vehicle_type", "manufacturer_name", "condition", "model_name",
        F.col("_year").alias("year"), "fuel_type", F.col("_horsepower").alias("horsepower"), "description",
    )
    purchase = fine.select(
        F.col("VIN").alias("vin"), F.col("seller_id").alias("customer_id"), F.col("purchase_clerk").alias("username"),
        F.col("_paid").alias("purchase_price"), F.col("_bought").alias("purchased_on"),
    )
    sale = fine.where(is_sale).select(
        F.col("VIN").alias("vin"), F.col("buyer_id").alias("customer_id"), F.col("salesperson").alias("username"),
        F.col("_earned").alias("sale_price"), F.col("_sold").alias("sold_on"),
    )
    color = split_colors(fine, F.col("VIN"), F.col("colors"))
    return Ingested({"vehicle": vehicle, "purchase": purchase, "vehicle_color": color, "sale": sale}, rejects)


def order_total_cost(parts: DataFrame) -> DataFrame:
    """(order_number, total_cost) from part lines with unit_price and quantity."""
    return parts.groupBy("order_number").agg(F.sum(F.col("unit_price") * F.col("quantity")).alias("total_cost"))


def ingest_parts(raw: DataFrame, *, line_no: str = LINE_NO) -> Ingested:
    """Wide part rows to orders and part lines; the first line of an order names its vendor.

    First by `line_no`, else, where the rows have none, by their contents.  An order is stored whole or not at all: an
    unreadable number, a part number that repeats in the order, or a total that does not fit rejects all its lines.
    """
    place = F.col(line_no) if line_no in raw.columns else F.struct(*raw.columns)
    lines = raw.select(
        F.col("VIN").alias("vin"),
        "vendor_name",
        place.alias("_place"),
        F.concat_ws("-", "VIN", "order_num").alias("order_number"),
        F.col("part_number").alias("vendor_parts_number"),
        "description",
        F.col("qty").try_cast("int").alias("quantity"),
        capitalised(F.col("status")).alias("status"),
        F.col("price").try_cast(schema.MONEY).alias("unit_price"),
    )
    unreadable = F.col("quantity").isNull() | F.col("unit_price").isNull()
    amount = F.col("unit_price") * F.col("quantity")
    # Two levels of counts, so that an order of any size combines before the shuffle.
    by_part = lines.groupBy("order_number", "vendor_parts_number").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(unreadable).alias("_unreadable"),
        F.sum(amount.cast("decimal(38,2)")).alias("_amount"),
        F.min(F.struct("_place", "vin", "vendor_name")).alias("_first"),
    )
    total = F.sum("_amount").try_cast(schema.MONEY)
    facts = by_part.groupBy("order_number").agg(
        F.min("_first").alias("_first"),
        total.alias("total_cost"),
        F.array_compact(
            F.array(
                F.when(F.max("_unreadable"), F.lit("bad_number")),
                F.when(F.max("_n") > 1, F.lit("repeated_part_number")),
                F.when(~F.max("_unreadable") & total.isNull(), F.lit("total_out_of_range")),
            )
        ).alias("reasons"),
    )
    judged = lookup(lines, facts.select("order_number", "reasons"), "order_number", ["vendor_parts_number", "_place"])
    orders = facts.where(F.size("reasons") == 0).select("order_number", "_first.vin", "_first.vendor_name", "total_cost")
    parts = judged.where(F.size("reasons") == 0)
    rejects = judged.where(F.size("reasons") > 0).select("order_number", "vendor_parts_number", "reasons")
    return Ingested({"parts_order": conform(orders, "parts_order"), "part": conform(parts, "part")}, rejects)
