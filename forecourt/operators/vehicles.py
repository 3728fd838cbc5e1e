"""Vehicle search and detail views, scoped by role."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.joins import attach_distinct, attach_many, keys_of, lookup
from forecourt.functions.money import asking_price, total_parts_cost
from forecourt.functions.reshape import attribute_rows
from forecourt.functions.text import keyword_pattern, same_text
from forecourt.operators.inventory import parts_cost_per_vehicle, pending_vins, vehicle_colors
from forecourt.operators.roles import may_filter_by_status, may_filter_by_vin, resolve_role, sees_only_sellable
from forecourt.tables import Tables

PUBLIC_COLUMNS = (
    "vin", "vehicle_type", "manufacturer", "model", "year", "fuel_type", "colors", "horsepower", "sale_price",
)
CLERK_COLUMNS = (*PUBLIC_COLUMNS[:-1], "purchase_price", "total_parts_cost")
MANAGER_COLUMNS = (*PUBLIC_COLUMNS, "purchase_price", "purchase_date", "total_parts_cost", "description")

# Attribute labels of the detail views, in display order.
PUBLIC_ATTRIBUTES = {
    "vin": "VIN", "vehicle_type": "VehicleType", "manufacturer": "Manufacturer", "model": "Model", "year": "Year",
    "fuel_type": "FuelType", "colors": "Colors", "horsepower": "Horsepower", "description": "Description",
    "sale_price": "SalePrice",
}
STAFF_ATTRIBUTES = {
    **{c: label for c, label in PUBLIC_ATTRIBUTES.items() if c != "sale_price"},
    "total_parts_cost": "TotalPartsCost", "purchase_price": "PurchasePrice", "purchase_date": "PurchaseDate",
    "sale_price": "SalePrice", "sale_date": "SaleDate",
}


def restrict_to_vins(
    df: DataFrame, vins: str | DataFrame | None, row_id: str | Sequence[str] | None = None
) -> DataFrame:
    """Keep one VIN (pushed to the scan), the VINs of a frame, or everything.

    `row_id` tells apart the rows of one VIN, where there may be very many.
    """
    if vins is None or (isinstance(vins, str) and not vins):
        return df
    if isinstance(vins, str):
        return df.where(F.col("vin").isin(sorted({vins, vins.upper(), vins.lower()})))
    wanted = keys_of(vins, "vin")
    return lookup(df, wanted, "vin", row_id, how="left_semi") if row_id else df.join(wanted, "vin", "left_semi")


def _deals_of(tables: Tables, vins: str | DataFrame | None) -> Tables:
    """One VIN reaches the scans of the deals as a pushed filter; Spark infers it only through some of the joins."""
    if not isinstance(vins, str):
        return tables
    return tables.with_tables(
        sale=restrict_to_vins(tables.sale, vins), purchase=restrict_to_vins(tables.purchase, vins)
    )


def vehicle_base(
    tables: Tables,
    vehicles: DataFrame | None = None,
    *,
    status: str = "all",
    sellable_only: bool = False,
    color: str | None = None,
    all_colors: bool = False,
) -> DataFrame:
    """Vehicles with colors, parts cost, purchase, sale and price.

    One row per vehicle and distinct (purchase price, purchase date, sale price, sale date).  `status` is
    "all", "sold" or "unsold".  Sold-ness and pending parts are decided by anti joins before anything wide
    is joined; the one-row-per-VIN parts share one partitioning by VIN.  A `color` keeps vehicles of that
    color and lists only the matching color, unless `all_colors` is set.
    """
    wanted = tables.vehicle if vehicles is None else vehicles
    base = wanted.where(F.col("vin").isNotNull())
    if status == "unsold":
        base = base.join(keys_of(tables.sale, "vin"), "vin", "left_anti")
    if sellable_only:
        base = base.join(pending_vins(tables), "vin", "left_anti")
    if color and all_colors:
        base = base.join(vehicle_colors(tables, color), "vin", "left_semi").join(vehicle_colors(tables), "vin", "left")
    elif color:
        base = base.join(vehicle_colors(tables, color), "vin")
    else:
        base = base.join(vehicle_colors(tables), "vin", "left")
    base = base.join(parts_cost_per_vehicle(tables), "vin", "left")

    purchases = tables.purchase.select("vin", "purchase_price", F.col("purchased_on").alias("purchase_date"))
    unsold = {"_sold_for": F.lit(None).cast("decimal(12,2)"), "sale_date": F.lit(None).cast("date")}
    if status == "unsold":
        base = attach_distinct(base.withColumns(unsold), purchases, "vin")
    else:
        sales = tables.sale.select("vin", F.col("sale_price").alias("_sold_for"), F.col("sold_on").alias("sale_date"))
        base = attach_distinct(base, sales, "vin", "inner" if status == "sold" else "left")
        # From here on a VIN has a row per sale, so both sides of the next join may be hot.
        every = sales.unionByName(wanted.select("vin").withColumns(unsold))
        base = attach_many(base, purchases, "vin", ["_sold_for", "sale_date"], every)

    parts_cost = F.col("parts_cost")
    price = F.coalesce("_sold_for", asking_price(F.col("purchase_price"), parts_cost))
    return base.select(
        "vin",
        "vehicle_type",
        F.col("manufacturer_name").alias("manufacturer"),
        F.col("model_name").alias("model"),
        "year",
        "fuel_type",
        "colors",
        "horsepower",
        price.alias("sale_price"),
        "sale_date",
        "purchase_price",
        "purchase_date",
        total_parts_cost(parts_cost).alias("total_parts_cost"),
        "description",
        "condition",
    )


def asking_prices(tables: Tables) -> DataFrame:
    """(vin, purchase_price, total_parts_cost, sale_price) of every vehicle."""
    return vehicle_base(tables).select("vin", "purchase_price", "total_parts_cost", "sale_price")


# The columns a keyword is looked for in.
KEYWORD_TEXTS = ("manufacturer_name", "model_name", "year", "description")


def _given(value: object) -> bool:
    return value is not None and value != "" and value != "Any"


def matching_vehicles(
    tables: Tables,
    *,
    vehicle_type: str | None = None,
    manufacturer: str | None = None,
    year: int | str | None = None,
    fuel_type: str | None = None,
    keyword: str | None = None,
    vins: str | DataFrame | None = None,
    accent_insensitive: bool = False,
) -> DataFrame:
    """Vehicle rows passing the optional filters; None, "" and "Any" mean "do not filter"."""
    found = restrict_to_vins(tables.vehicle, vins)
    for column, value, domain in (
        ("vehicle_type", vehicle_type, schema.VEHICLE_TYPES),
        ("manufacturer_name", manufacturer, schema.MANUFACTURERS),
        ("fuel_type", fuel_type, schema.FUEL_TYPES),
    ):
        if _given(value):
            found = found.where(same_text(F.col(column), value, domain))
    if _given(year):
        if not str(year).strip().isdigit():
            raise ValueError(f"year must be a whole number, not {year!r}")
        found = found.where(F.col("year") == int(year))
    if keyword:
        texts = [F.col(c).cast("string") for c in KEYWORD_TEXTS]
        if accent_insensitive:
            # Plain substring search: LIKE wildcards are not available under this collation.
            wanted = F.collate(F.lit(keyword), "UNICODE_CI_AI")
            hits = [F.contains(F.collate(t, "UNICODE_CI_AI"), wanted) for t in texts]
        else:
            hits = [t.ilike(keyword_pattern(keyword)) for t in texts]
        hit = hits[0]
        for other in hits[1:]:
            hit = hit | other
        found = found.where(hit)
    return found


def search_vehicles(
    tables: Tables,
    role: str = "Public",
    *,
    vehicle_type: str | None = None,
    manufacturer: str | None = None,
    year: int | str | None = None,
    fuel_type: str | None = None,
    color: str | None = None,
    keyword: str | None = None,
    vin: str | DataFrame | None = None,
    vehicle_status: str | None = None,
    all_colors: bool = False,
    accent_insensitive: bool = False,
) -> DataFrame:
    """Inventory search as the given role sees it; a VIN filter by a role that may not use it is an error."""
    role = resolve_role(role)
    if not (vin is None or isinstance(vin, str) and not vin) and not may_filter_by_vin(role):
        raise ValueError(f"{role} may not filter by VIN")
    vehicles = matching_vehicles(
        tables,
        vehicle_type=vehicle_type,
        manufacturer=manufacturer,
        year=year,
        fuel_type=fuel_type,
        keyword=keyword,
        vins=vin,
        accent_insensitive=accent_insensitive,
    )
    status, columns = "unsold", PUBLIC_COLUMNS
    if may_filter_by_status(role):
        status, columns = {"sold": "sold", "unsold": "unsold"}.get((vehicle_status or "").lower(), "all"), MANAGER_COLUMNS
    elif not sees_only_sellable(role):
        columns = CLERK_COLUMNS
    dealt = _deals_of(tables, vin)
    found = vehicle_base(
        # The search view has no sale date: sales at one price on several days are one row.
        dealt.with_tables(sale=dealt.sale.withColumn("sold_on", F.lit(None).cast("date"))),
        vehicles,
        status=status,
        sellable_only=sees_only_sellable(role),
        color=color if _given(color) else None,
        all_colors=all_colors,
    )
    return found.select(*columns)


def vehicle_details(
    tables: Tables, role: str = "Public", *, vins: str | DataFrame | None = None, unsold_only: bool = False
) -> DataFrame:
    """(vin, ord, attribute, value): the detail view of one, some or all vehicles.

    Public and salespeople see sellable vehicles; managers and owners see all (only unsold ones with
    `unsold_only`); clerks see unsold ones.
    """
    role = resolve_role(role)
    everything = may_filter_by_status(role) and not unsold_only
    base = vehicle_base(
        _deals_of(tables, vins),
        restrict_to_vins(tables.vehicle, vins),
        status="all" if everything else "unsold",
        sellable_only=sees_only_sellable(role),
    )
    return attribute_rows(base, "vin", PUBLIC_ATTRIBUTES if sees_only_sellable(role) else STAFF_ATTRIBUTES)


def sellable_vehicle(tables: Tables, vins: str | DataFrame | None = None) -> DataFrame:
    """Unsold vehicles with condition, purchase and asking price; pending parts are not looked at."""
    return vehicle_base(tables, restrict_to_vins(tables.vehicle, vins), status="unsold").select(
        "vin", "vehicle_type", "manufacturer", "model", "year", "fuel_type", "horsepower", "colors", "condition",
        "description", "purchase_price", "purchase_date", "sale_price",
    )
