"""Exact-decimal price arithmetic and currency text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup on the purchase price and on the parts cost.
PURCHASE_MARKUP = Decimal("1.25")
PARTS_MARKUP = Decimal("1.1")


def asking_price(purchase_price: Column, parts_cost: Column) -> Column:
    """Marked-up price of an unsold vehicle, rounded half-up to cents; NULL when it was never purchased."""
    parts = F.coalesce(parts_cost, F.lit(Decimal("0.00")))
    return F.round(F.lit(PURCHASE_MARKUP) * purchase_price + F.lit(PARTS_MARKUP) * parts, 2)


def total_parts_cost(parts_cost: Column) -> Column:
    return F.round(F.coalesce(parts_cost, F.lit(Decimal("0.00"))), 2)


def exact_mean(total: Column, count: Column, scale: int = 2) -> Column:
    """Decimal quotient rounded half-up; NULL for an empty group."""
    return F.round(F.try_divide(total.cast("decimal(28,2)"), count.cast("decimal(19,0)")), scale)


def currency(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))
