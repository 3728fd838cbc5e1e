"""Parts lists, contact details, identifier lookups and pick lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.reshape import attribute_rows
from forecourt.operators.vehicles import restrict_to_vins
from forecourt.tables import Tables, constant_rows

PURCHASE_CONTACT_LABELS = {
    "seller_email": "External Seller Email",
    "seller_phone": "External Seller Phone",
    "seller_address": "External Seller Address",
    "clerk_first_name": "Inventory Clerk First Name",
    "clerk_last_name": "Inventory Clerk Last Name",
    "clerk_username": "Inventory Clerk Username",
}
SALE_CONTACT_LABELS = {
    "customer_email": "Customer Email",
    "customer_phone": "Customer Phone",
    "customer_address": "Customer Address",
    "seller_first_name": "Seller First Name",
    "seller_last_name": "Seller Last Name",
    "seller_username": "Seller Username",
}


DEAL_KEY = ("customer_id", "username")


def vehicle_parts(tables: Tables, vins: str | DataFrame | None = None) -> DataFrame:
    """Part lines with their order and vendor, for one, some or all vehicles."""
    orders = restrict_to_vins(tables.parts_order, vins, "order_number")
    vendors = tables.vendor.select(F.col("name").alias("vendor_name"))
    return (
        tables.part.join(orders, "order_number")
        .join(vendors, "vendor_name")
        .select(
            "vin",
            "order_number",
            "vendor_parts_number",
            F.col("description").alias("part_description"),
            "quantity",
            F.col("status").alias("part_status"),
            "unit_price",
            "vendor_name",
        )
    )


def _full_address() -> Column:
    return F.concat("street", F.lit(", "), "city", F.lit(", "), "state", F.lit(" "), "postal_code")


def _contacts(tables: Tables, deals: DataFrame, day: str, person: str, staff: str, one_per_vin: bool) -> DataFrame:
    if one_per_vin:
        # A minimum of the ordering struct picks the earliest deal without gathering a VIN's deals in one task.
        first = F.min(F.struct(day, "username", "customer_id")).alias("_deal")
        deals = deals.groupBy("vin").agg(first).select("vin", "_deal.username", "_deal.customer_id")
    customers = tables.customer.select(
        "customer_id",
        F.col("email").alias(f"{person}_email"),
        F.col("phone_number").alias(f"{person}_phone"),
        _full_address().alias(f"{person}_address"),
    )
    users = tables.user.select(
        "username", F.col("first_name").alias(f"{staff}_first_name"), F.col("last_name").alias(f"{staff}_last_name")
    )
    return (
        deals.select("vin", "customer_id", "username")
        .join(customers, "customer_id")
        .join(users, "username")
        .select(
            "vin",
            f"{person}_email",
            f"{person}_phone",
            f"{person}_address",
            f"{staff}_first_name",
            f"{staff}_last_name",
            F.col("username").alias(f"{staff}_username"),
        )
    )


def purchase_details(tables: Tables, vins: str | DataFrame | None = None, *, one_per_vin: bool = False) -> DataFrame:
    """Who sold us the vehicle and which clerk bought it; deals lacking either person are left out."""
    deals = restrict_to_vins(tables.purchase, vins, DEAL_KEY)
    return _contacts(tables, deals, "purchased_on", "seller", "clerk", one_per_vin)


def sale_details(tables: Tables, vins: str | DataFrame | None = None, *, one_per_vin: bool = False) -> DataFrame:
    """Who bought the vehicle and which salesperson sold it."""
    deals = restrict_to_vins(tables.sale, vins, DEAL_KEY)
    return _contacts(tables, deals, "sold_on", "customer", "seller", one_per_vin)


def purchase_attributes(tables: Tables, vins: str | DataFrame | None = None) -> DataFrame:
    return attribute_rows(purchase_details(tables, vins), "vin", PURCHASE_CONTACT_LABELS)


def sale_attributes(tables: Tables, vins: str | DataFrame | None = None) -> DataFrame:
    return attribute_rows(sale_details(tables, vins), "vin", SALE_CONTACT_LABELS)


def _identifier_rows(tables: Tables) -> DataFrame:
    people = tables.individual_customer.select(F.col("social_security_number").alias("identifier"), "customer_id")
    firms = tables.business_customer.select(F.col("tax_identification_number").alias("identifier"), "customer_id")
    return people.unionByName(firms).where(F.col("identifier").isNotNull())


def identifier_map(tables: Tables) -> DataFrame:
    """(identifier, customer_id) over both customer kinds: SSN or tax id.

    A union of two key columns lets every lookup be an equi-join; an OR over two joined columns could not be.
    """
    return _identifier_rows(tables).distinct()


def first_customer_per_identifier(tables: Tables) -> DataFrame:
    """The identifier map with one (the lowest) customer id per identifier."""
    return _identifier_rows(tables).groupBy("identifier").agg(F.min("customer_id").alias("customer_id"))


def customer_identifiers(tables: Tables) -> DataFrame:
    return _identifier_rows(tables).select("identifier").distinct()


def customer_lookup(tables: Tables, identifiers: str | DataFrame) -> DataFrame:
    """(identifier, customer_id) for one identifier or a frame with an `identifier` column; unknown ones are absent."""
    known = identifier_map(tables)
    if isinstance(identifiers, str):
        return known.where(F.col("identifier") == identifiers)
    return known.join(identifiers.select("identifier").distinct(), "identifier", "left_semi")


def list_vendors(tables: Tables) -> DataFrame:
    return tables.vendor.select("name")


def distinct_values(tables: Tables, table: str, column: str) -> DataFrame:
    """Distinct values of a declared column.  Not sorted: a global sort belongs to the display."""
    if column not in schema.SCHEMAS[table].names:
        raise ValueError(f"{table} has no column {column!r}")
    return tables[table].select(column).distinct()


def list_dimension_values(tables: Tables) -> DataFrame:
    """(dimension, value): the pick lists of vehicle types, manufacturers and colors."""
    lists = [
        tables[table].select(F.lit(table).alias("dimension"), F.col(column).alias("value"))
        for table, column in (
            ("vehicle_type", "vehicle_type"),
            ("manufacturer", "manufacturer_name"),
            ("color", "color_name"),
        )
    ]
    return reduce(DataFrame.unionByName, lists)


def dimension_usage(tables: Tables) -> DataFrame:
    """(dimension, value, vehicles): every dimension row with the number of vehicles that use it."""
    used = {
        "vehicle_type": tables.vehicle.select(F.col("vehicle_type").alias("value")),
        "manufacturer": tables.vehicle.select(F.col("manufacturer_name").alias("value")),
        "color": tables.vehicle_color.select(F.col("color_name").alias("value")),
    }
    tagged = [rows.select(F.lit(name).alias("dimension"), "value") for name, rows in used.items()]
    counts = reduce(DataFrame.unionByName, tagged).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("_n"))
    joined = list_dimension_values(tables).join(counts, ["dimension", "value"], "left")
    return joined.select("dimension", "value", F.coalesce("_n", F.lit(0)).alias("vehicles"))


def filter_options(tables: Tables, as_of_year: int) -> DataFrame:
    """(option, value): what the search form offers, "Any" first in each list."""
    spark = tables.color.sparkSession
    years = range(schema.FIRST_MODEL_YEAR, as_of_year + 2)
    fixed = [("fuel_type", f) for f in ("Any", *schema.FUEL_TYPES)]
    fixed += [("year", y) for y in ("Any", *map(str, years))]
    fixed += [(option, "Any") for option in ("vehicle_type", "manufacturer", "color")]
    options, values = zip(*fixed, strict=True)
    constants = constant_rows(spark, {"option": options, "value": values})
    return constants.unionByName(list_dimension_values(tables).distinct().withColumnRenamed("dimension", "option"))

