"""Checks of declared keys, references and domains, and of submissions before they are applied."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.joins import keys_of, mark
from forecourt.functions.text import is_blank
from forecourt.tables import Tables


def check_primary_keys(tables: Tables, constraints: Iterable[str] | None = None) -> DataFrame:
    """(constraint_name, key, n): every key value that occurs more than once.

    Parts of a key are joined by "|"; inside a part "|" and the backslash get a backslash, and NULL reads as \\N.
    """
    found = []
    for name in constraints or schema.UNIQUE_KEYS:
        table, columns = schema.UNIQUE_KEYS[name]
        counts = tables[table].groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        parts = [F.regexp_replace(F.col(c).cast("string"), r"([|\\])", r"\\$1") for c in columns]
        key = F.concat_ws("|", *[F.coalesce(part, F.lit("\\N")) for part in parts])
        found.append(counts.select(F.lit(name).alias("constraint_name"), key.alias("key"), "n"))
    return reduce(DataFrame.unionByName, found)


def check_foreign_keys(tables: Tables) -> DataFrame:
    """(constraint_name, value, n): referenced values that do not exist, with the rows that use them.

    All references to one parent are counted together and meet its keys in one join.  It is a marking join, because an
    anti join would be pushed below the count and the union, and read the parent once per reference.
    """
    by_parent: dict[tuple[str, str], list[schema.Reference]] = {}
    for ref in schema.FOREIGN_KEYS:
        by_parent.setdefault((ref.parent, ref.parent_column), []).append(ref)
    found = []
    for (parent, column), refs in by_parent.items():
        used = [
            tables[ref.table].select(F.lit(ref.name).alias("constraint_name"), F.col(ref.column).alias("_value"))
            for ref in refs
        ]
        counts = (
            reduce(DataFrame.unionByName, used)
            .where(F.col("_value").isNotNull())
            .groupBy("constraint_name", "_value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        known = keys_of(tables[parent], column).withColumnRenamed(column, "_value")
        orphans = mark(counts, known, "_value", "_known").where(~F.col("_known"))
        found.append(orphans.select("constraint_name", F.col("_value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, found)


def check_domains(tables: Tables) -> DataFrame:
    """(table_name, column_name, rule, violations): NOT NULL and enumerated columns, one pass per table."""
    found = []
    for table, columns in schema.SCHEMAS.items():
        rules = [(f.name, "not_null", f"{f.name} IS NULL") for f in columns if not f.nullable]
        for (owner, column), allowed in schema.DOMAINS.items():
            if owner == table:
                values = ", ".join(f"'{v}'" for v in allowed)
                rules.append((column, "domain", f"{column} NOT IN ({values})"))
        counts = tables[table].selectExpr(*[f"count_if({broken}) AS n{i}" for i, (_, _, broken) in enumerate(rules)])
        rows = [
            f"named_struct('table_name', '{table}', 'column_name', '{column}', 'rule', '{rule}', 'violations', n{i})"
            for i, (column, rule, _) in enumerate(rules)
        ]
        found.append(counts.selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionByName, found)


Rules = list[tuple[str, Column]]


def reasons(rules: Rules) -> Column:
    """Names of the broken rules as a text array; an unknown (NULL) condition counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules]))


def required(*columns: str) -> Rules:
    return [(f"missing_{c}", is_blank(F.col(c))) for c in columns]


def _at_most(name: str, size: Column, limit: int | None) -> Rules:
    return [] if limit is None else [(name, size > limit)]


def vehicle_rules(
    as_of_year: int, *, max_vin_length: int | None = None, max_description_length: int | None = None
) -> Rules:
    """Form rules of a new vehicle.  Horsepower 0 and price 0 count as "not filled in".

    The entry form's limits on lengths (`schema.MAX_...`) hold only where they are passed.
    """
    year = F.col("year")
    return [
        *required("vin", "vehicle_type", "manufacturer_name", "model_name", "condition", "fuel_type"),
        *_at_most("vin_too_long", F.length("vin"), max_vin_length),
        ("year_out_of_range", (year < schema.FIRST_MODEL_YEAR) | (year > as_of_year + 1)),
        ("missing_horsepower", F.col("horsepower") <= 0),
        ("missing_colors", F.size("colors") < 1),
        ("missing_purchase_price", F.col("purchase_price") <= 0),
        ("missing_purchased_on", F.col("purchased_on").isNull()),
        *required("seller_identifier"),
        *_at_most("description_too_long", F.length(F.coalesce("description", F.lit(""))), max_description_length),
        ("bad_condition", ~F.col("condition").isin(*schema.CONDITIONS)),
        ("bad_fuel_type", ~F.col("fuel_type").isin(*schema.FUEL_TYPES)),
    ]


def customer_rules() -> Rules:
    """Form rules of a new customer: every field of its kind is filled in."""
    individual = F.col("customer_type") == "Individual"
    business = F.col("customer_type") == "Business"
    rules = [
        ("bad_customer_type", ~F.col("customer_type").isin("Individual", "Business")),
        *required("email", "phone_number", "street", "city", "state", "postal_code"),
    ]
    for column in ("first_name", "last_name", "social_security_number"):
        rules.append((f"missing_{column}", individual & is_blank(F.col(column))))
    for column in (
        "business_name", "tax_identification_number", "contact_first_name", "contact_last_name", "contact_title",
    ):
        rules.append((f"missing_{column}", business & is_blank(F.col(column))))
    return rules


def vendor_rules() -> Rules:
    return required("name", "phone_number", "street", "city", "state", "postal_code")


def parts_order_rules(*, max_vin_length: int | None = None, max_parts: int | None = None) -> Rules:
    """Form rules of a parts order; the vendor's part number may be empty but not repeat within the order.

    The entry form's limits (`schema.MAX_...`) hold only where they are passed.
    """
    parts = F.col("parts")

    def some(broken) -> Column:
        return F.exists(parts, lambda p: F.coalesce(broken(p), F.lit(True)))

    numbers = F.transform(parts, lambda p: F.coalesce(F.trim(p["vendor_part_number"]), F.lit("")))
    return [
        *required("vin", "vendor_name"),
        *_at_most("vin_too_long", F.length("vin"), max_vin_length),
        ("part_count", (F.size(parts) < 1) | (F.size(parts) > max_parts if max_parts else F.lit(False))),
        ("missing_part_description", some(lambda p: is_blank(p["part_description"]))),
        ("bad_unit_price", some(lambda p: p["unit_price"] <= 0)),
        ("bad_quantity", some(lambda p: p["quantity"] < 1)),
        ("bad_status", some(lambda p: ~p["part_status"].isin(*schema.PART_STATUSES))),
        ("repeated_part_number", F.size(F.array_distinct(numbers)) < F.size(numbers)),
    ]


def validate_submissions(submissions: DataFrame, rules: Rules) -> DataFrame:
    """Add `reasons` (names of broken rules, empty when fine); judged row by row, without a shuffle."""
    return submissions.withColumn("reasons", reasons(rules))
