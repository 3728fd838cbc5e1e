"""Declared shape of the dealership model: column types, keys, references and value domains.

Nothing is inferred from data.  Money is exact decimal, identifiers are text (leading zeros matter),
and surrogate customer ids are 64-bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

# The rows every fresh database starts with.
COLORS = (
    "Aluminum", "Beige", "Black", "Blue", "Brown", "Bronze", "Claret", "Copper", "Cream", "Gold", "Gray", "Green",
    "Maroon", "Metallic", "Navy", "Orange", "Pink", "Purple", "Red", "Rose", "Rust", "Silver", "Tan", "Turquoise",
    "White", "Yellow",
)
MANUFACTURERS = (
    "Acura", "Alfa Romeo", "Aston Martin", "Audi", "Bentley", "BMW", "Buick", "Cadillac", "Chevrolet", "Chrysler",
    "Dodge", "Ferrari", "FIAT", "Ford", "Geeley", "Genesis", "GMC", "Honda", "Hyundai", "INFINITI", "Jaguar", "Jeep",
    "Karma", "Kia", "Lamborghini", "Land Rover", "Lexus", "Lincoln", "Lotus", "Maserati", "MAZDA", "McLaren",
    "Mercedes-Benz", "MINI", "Mitsubishi", "Nio", "Nissan", "Porsche", "Ram", "Rivian", "Rolls-Royce", "smart",
    "Subaru", "Tesla", "Toyota", "Volkswagen", "Volvo", "XPeng",
)
VEHICLE_TYPES = ("Convertible", "Coupe", "CUV", "Minivan", "Other", "Sedan", "SUV", "Truck", "Van")

# Enumerated columns, in declared order.
CONDITIONS = ("Excellent", "Very Good", "Good", "Fair")
FUEL_TYPES = ("Gas", "Diesel", "Natural Gas", "Hybrid", "Plugin Hybrid", "Battery", "Fuel Cell")
PART_STATUSES = ("Ordered", "Received", "Installed")
ROLES = ("Public", "Salesperson", "Inventory clerk", "Manager", "Owner")

# Limits the entry forms enforce.
FIRST_MODEL_YEAR = 1980
MAX_VIN_LENGTH = 17
MAX_DESCRIPTION_LENGTH = 2054
MAX_PARTS_PER_ORDER = 100


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


def _text(*names: str) -> list[tuple[str, T.DataType, bool]]:
    return [(name, T.StringType(), False) for name in names]


_ADDRESS = _text("phone_number", "street", "city", "state", "postal_code")

SCHEMAS: dict[str, T.StructType] = {
    "color": _struct(*_text("color_name")),
    "vehicle_type": _struct(*_text("vehicle_type")),
    "manufacturer": _struct(*_text("manufacturer_name")),
    "vehicle": _struct(
        *_text("vin", "vehicle_type", "manufacturer_name", "condition", "model_name"),
        ("year", T.IntegerType(), False),
        *_text("fuel_type"),
        ("horsepower", T.IntegerType(), False),
        ("description", T.StringType(), True),
    ),
    "vehicle_color": _struct(*_text("vin", "color_name")),
    "vendor": _struct(*_text("name"), *_ADDRESS),
    "parts_order": _struct(*_text("vin", "vendor_name", "order_number"), ("total_cost", MONEY, False)),
    "part": _struct(
        *_text("order_number", "vendor_parts_number", "description"),
        ("quantity", T.IntegerType(), False),
        *_text("status"),
        ("unit_price", MONEY, False),
    ),
    "customer": _struct(("customer_id", T.LongType(), False), ("email", T.StringType(), True), *_ADDRESS),
    "individual_customer": _struct(
        ("customer_id", T.LongType(), False), *_text("first_name", "last_name", "social_security_number")
    ),
    "business_customer": _struct(
        ("customer_id", T.LongType(), False),
        *_text("business_name", "tax_identification_number", "contact_first_name", "contact_last_name", "contact_title"),
    ),
    "user": _struct(*_text("username", "first_name", "last_name", "role")),
    "purchase": _struct(
        *_text("vin"),
        ("customer_id", T.LongType(), False),
        *_text("username"),
        ("purchase_price", MONEY, False),
        ("purchased_on", T.DateType(), False),
    ),
    "sale": _struct(
        *_text("vin"),
        ("customer_id", T.LongType(), False),
        *_text("username"),
        ("sale_price", MONEY, False),
        ("sold_on", T.DateType(), False),
    ),
}

TABLE_NAMES = tuple(SCHEMAS)

# constraint name -> (table, columns that identify a row)
UNIQUE_KEYS: dict[str, tuple[str, tuple[str, ...]]] = {
    "color_pk": ("color", ("color_name",)),
    "vehicle_type_pk": ("vehicle_type", ("vehicle_type",)),
    "manufacturer_pk": ("manufacturer", ("manufacturer_name",)),
    "vehicle_pk": ("vehicle", ("vin",)),
    "vehicle_color_pk": ("vehicle_color", ("color_name", "vin")),
    "vendor_pk": ("vendor", ("name",)),
    "parts_order_pk": ("parts_order", ("order_number", "vendor_name", "vin")),
    "parts_order_number_uq": ("parts_order", ("order_number",)),
    "part_pk": ("part", ("vendor_parts_number", "order_number")),
    "customer_pk": ("customer", ("customer_id",)),
    "individual_customer_pk": ("individual_customer", ("social_security_number",)),
    "individual_customer_id_uq": ("individual_customer", ("customer_id",)),
    "business_customer_pk": ("business_customer", ("tax_identification_number",)),
    "business_customer_id_uq": ("business_customer", ("customer_id",)),
    "user_pk": ("user", ("username",)),
    "purchase_pk": ("purchase", ("vin", "username", "customer_id")),
    "sale_pk": ("sale", ("vin", "username", "customer_id")),
}


@dataclass(frozen=True)
class Reference:
    """A column whose values must all occur in another table's key column."""

    table: str
    column: str
    parent: str
    parent_column: str

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}"


FOREIGN_KEYS: tuple[Reference, ...] = (
    Reference("vehicle", "vehicle_type", "vehicle_type", "vehicle_type"),
    Reference("vehicle", "manufacturer_name", "manufacturer", "manufacturer_name"),
    Reference("vehicle_color", "color_name", "color", "color_name"),
    Reference("vehicle_color", "vin", "vehicle", "vin"),
    Reference("parts_order", "vin", "vehicle", "vin"),
    Reference("parts_order", "vendor_name", "vendor", "name"),
    Reference("part", "order_number", "parts_order", "order_number"),
    Reference("individual_customer", "customer_id", "customer", "customer_id"),
    Reference("business_customer", "customer_id", "customer", "customer_id"),
    Reference("purchase", "vin", "vehicle", "vin"),
    Reference("purchase", "customer_id", "customer", "customer_id"),
    Reference("purchase", "username", "user", "username"),
    Reference("sale", "vin", "vehicle", "vin"),
    Reference("sale", "customer_id", "customer", "customer_id"),
    Reference("sale", "username", "user", "username"),
)

# (table, column) -> allowed values
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("vehicle", "condition"): CONDITIONS,
    ("vehicle", "fuel_type"): FUEL_TYPES,
    ("part", "status"): PART_STATUSES,
}
