"""Presentation: column titles, row order and currency text.  Everything here is optional and last in a plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.money import currency
from forecourt.functions.numbering import number_in_order
from forecourt.operators.lookups import PURCHASE_CONTACT_LABELS, SALE_CONTACT_LABELS


@dataclass(frozen=True)
class View:
    """Titles of the shown columns, the sort (a leading "-" means descending) and the money columns."""

    titles: Mapping[str, str]
    order: tuple[str, ...] = ()
    money: frozenset[str] = field(default_factory=frozenset)
    text: frozenset[str] = field(default_factory=frozenset)


# Column titles as the screens show them.
SEARCH_TITLES = {
    "vin": "VIN", "vehicle_type": "VehicleType", "manufacturer": "Manufacturer", "model": "Model", "year": "Year",
    "fuel_type": "FuelType", "colors": "Colors", "horsepower": "Horsepower", "sale_price": "SalePrice",
    "purchase_price": "PurchasePrice", "purchase_date": "PurchaseDate", "total_parts_cost": "TotalPartsCost",
    "description": "Description",
}
SELLABLE_TITLES = {
    "vin": "VIN", "vehicle_type": "VehicleType", "manufacturer": "Manufacturer", "model": "Model", "year": "Year",
    "fuel_type": "FuelType", "horsepower": "Horsepower", "colors": "Colors", "condition": "Condition",
    "description": "Description", "purchase_price": "PurchasePrice", "purchase_date": "PurchaseDate",
    "sale_price": "SalePrice",
}

VIEWS: dict[str, View] = {
    "search": View(SEARCH_TITLES, order=("vin",)),
    "details": View({"vin": "VIN", "attribute": "Attribute", "value": "Value"}, order=("vin", "ord")),
    "vehicle_parts": View(
        {
            "order_number": "OrderNumber",
            "vendor_parts_number": "VendorPartNumber",
            "part_description": "PartDescription",
            "quantity": "Quantity",
            "part_status": "PartStatus",
            "unit_price": "UnitPrice",
            "vendor_name": "VendorName",
        }
    ),
    "sellable_vehicle": View(SELLABLE_TITLES, order=("vin",)),
    "purchase_details": View({"vin": "VIN", **PURCHASE_CONTACT_LABELS}, order=("vin",)),
    "sale_details": View({"vin": "VIN", **SALE_CONTACT_LABELS}, order=("vin",)),
    "seller_history": View(
        {
            "seller_name": "Seller Name",
            "total_vehicles_sold": "Total Vehicles Sold",
            "avg_purchase_price": "Avg Purchase Price",
            "avg_parts_quantity": "Avg Parts Quantity Per Vehicle",
            "avg_parts_cost": "Avg Parts Cost Per Vehicle",
            "flagged": "Flagged",
        },
        order=("-total_vehicles_sold", "avg_purchase_price"),
        money=frozenset({"avg_purchase_price", "avg_parts_cost"}),
    ),
    "avg_inventory_time": View(
        {"vehicle_type": "Vehicle Type", "avg_inventory_time": "Avg Inventory Time"}, order=("vehicle_type",)
    ),
    "price_per_condition": View(
        {
            "vehicle_type": "Vehicle Type",
            "excellent": "Excellent",
            "very_good": "Very Good",
            "good": "Good",
            "fair": "Fair",
        },
        order=("vehicle_type",),
        money=frozenset({"excellent", "very_good", "good", "fair"}),
    ),
    "parts_statistics": View(
        {
            "vendor_name": "Vendor Name",
            "total_parts_quantity": "Total Parts Quantity",
            "total_amount_spent": "Total Amount Spent",
        },
        order=("-total_amount_spent",),
        money=frozenset({"total_amount_spent"}),
    ),
    "monthly_sales": View(
        {
            "year": "Year",
            "month": "Month",
            "vehicles_sold": "Vehicles Sold",
            "gross_sales_income": "Gross Sales Income",
            "net_income": "Net Income",
        },
        order=("-year", "-month"),
        money=frozenset({"gross_sales_income", "net_income"}),
        text=frozenset({"year"}),
    ),
    "monthly_sales_drilldown": View(
        {
            "first_name": "First Name",
            "last_name": "Last Name",
            "vehicles_sold": "Vehicles Sold",
            "total_sales": "Total Sales",
        },
        order=("-vehicles_sold", "-total_sales"),
        money=frozenset({"total_sales"}),
    ),
}


def display(df: DataFrame, view: str, limit: int | None = None, place: str | None = None) -> DataFrame:
    """Sort, title and format an operator's result for people; `limit` shows only the first rows of the sort.

    `place` names a first column with each row's place in the sort; rows that the sort leaves equal are ordered by their
    other columns.  Rows are numbered in ranges, whatever their number.
    """
    spec = VIEWS[view]
    order = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in spec.order]
    shown = []
    if place:
        named = {c.removeprefix("-") for c in spec.order}
        df = number_in_order(df, [*order, *[F.col(c).asc() for c in df.columns if c not in named]], "_place")
        shown.append(F.col("_place").alias(place))
        order = [F.col("_place")]
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    for column, title in spec.titles.items():
        if column not in df.columns:
            continue
        value = F.col(column)
        if column in spec.money:
            value = currency(value)
        elif column in spec.text:
            value = value.cast("string")
        shown.append(value.alias(title))
    return df.select(*shown)
