"""Per-vehicle facts: what was spent on parts, what is pending, sold or available, and the two counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions.joins import keys_of, mark
from forecourt.functions.text import same_text
from forecourt.operators.roles import resolve_role
from forecourt.tables import Tables


def parts_cost_per_vehicle(tables: Tables) -> DataFrame:
    """(vin, parts_cost): total of all parts orders of a vehicle; vehicles without orders are absent."""
    return tables.parts_order.groupBy("vin").agg(F.sum("total_cost").alias("parts_cost"))


def vehicle_colors(tables: Tables, color: str | None = None) -> DataFrame:
    """(vin, colors): distinct color names, ascending, comma separated; uncolored vehicles are absent.

    The set per vehicle is bounded by the color dimension and combines before the shuffle.
    """
    rows = tables.vehicle_color
    if color:
        rows = rows.where(same_text(F.col("color_name"), color, schema.COLORS))
    names = F.array_sort(F.collect_set("color_name"))
    return rows.groupBy("vin").agg(F.array_join(names, ", ").alias("colors"))


def pending_vins(tables: Tables) -> DataFrame:
    """Distinct VINs with at least one part that is not installed yet."""
    open_orders = keys_of(tables.part.where(F.col("status") != "Installed"), "order_number")
    return keys_of(tables.parts_order.join(open_orders, "order_number"), "vin")


def vehicles_without_pending_parts(tables: Tables) -> DataFrame:
    return tables.vehicle.join(pending_vins(tables), "vin", "left_anti")


def unsold_vehicles(tables: Tables) -> DataFrame:
    return tables.vehicle.join(keys_of(tables.sale, "vin"), "vin", "left_anti")


def sold_vehicles(tables: Tables) -> DataFrame:
    return tables.vehicle.join(keys_of(tables.sale, "vin"), "vin", "left_semi")


def parts_per_order(tables: Tables) -> DataFrame:
    """(order_number, quantity, cost) over the part lines of an order, so later joins see one row per order."""
    return tables.part.groupBy("order_number").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("unit_price")).alias("cost")
    )


def all_parts_installed(tables: Tables) -> DataFrame:
    """(vin, all_installed) for every vehicle; TRUE when it has no parts at all."""
    waiting = mark(tables.vehicle.select("vin"), pending_vins(tables), "vin", "_waiting")
    return waiting.select("vin", (~F.col("_waiting")).alias("all_installed"))


def sale_eligibility(tables: Tables) -> DataFrame:
    """(vin, unsold, all_installed, can_sell) for every vehicle."""
    flagged = mark(all_parts_installed(tables), keys_of(tables.sale, "vin"), "vin", "_sold")
    unsold = ~F.col("_sold")
    return flagged.select(
        "vin", unsold.alias("unsold"), "all_installed", (unsold & F.col("all_installed")).alias("can_sell")
    )


def _unsold_vins(tables: Tables) -> DataFrame:
    return keys_of(tables.vehicle, "vin").join(keys_of(tables.sale, "vin"), "vin", "left_anti")


def count_pending_parts(tables: Tables) -> DataFrame:
    """One row: unsold vehicles that wait for parts."""
    waiting = _unsold_vins(tables).join(pending_vins(tables), "vin", "left_semi")
    return waiting.agg(F.count(F.lit(1)).alias("pending_parts_count"))


def count_available(tables: Tables) -> DataFrame:
    """One row: unsold vehicles with nothing pending."""
    ready = _unsold_vins(tables).join(pending_vins(tables), "vin", "left_anti")
    return ready.agg(F.count(F.lit(1)).alias("available_count"))


def vehicle_counts(tables: Tables, role: str = "Manager") -> DataFrame:
    """Both counts in one pass; public and salespeople see only the available count."""
    flagged = mark(_unsold_vins(tables), pending_vins(tables), "vin", "_waiting")
    counts = [F.count_if(~F.col("_waiting")).alias("available_count")]
    if resolve_role(role) not in ("Public", "Salesperson"):
        counts.append(F.count_if(F.col("_waiting")).alias("pending_parts_count"))
    return flagged.agg(*counts)
