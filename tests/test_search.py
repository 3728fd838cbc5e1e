"""Search, detail views, counts and eligibility on hand-made rows."""

from datetime import date

import pytest
from lot import lot, money, rows

from forecourt.operators import inventory, lookups, vehicles
from forecourt.operators.display import display
from forecourt.operators.roles import may_filter_by_status, may_filter_by_vin, resolve_role


def test_missing_color_is_null(spark):
    found = vehicles.search_vehicles(lot(spark, vehicle=[{"vin": "A"}]), "Manager")
    assert rows(found, "vin", "colors", "sale_price", "total_parts_cost") == [("A", None, None, money(0))]


def test_color_filter_shows_only_the_matching_color(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}, {"vin": "B"}],
        vehicle_color=[{"vin": "A", "color_name": "Red"}, {"vin": "A", "color_name": "Blue"}, {"vin": "B", "color_name": "Blue"}],
    )
    assert rows(vehicles.search_vehicles(t, "Manager", color="red"), "vin", "colors") == [("A", "Red")]
    every = vehicles.search_vehicles(t, "Manager", color="Red", all_colors=True)
    assert rows(every, "vin", "colors") == [("A", "Blue, Red")]
    assert rows(vehicles.search_vehicles(t, "Manager", color="Any"), "vin", "colors") == [("A", "Blue, Red"), ("B", "Blue")]


def test_asking_price_and_sold_price(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}, {"vin": "B"}],
        purchase=[{"vin": "A"}, {"vin": "B"}],
        parts_order=[{"vin": "A", "order_number": "A-001", "total_cost": money(60)}, {"vin": "A", "order_number": "A-002", "total_cost": money(40)}],
        sale=[{"vin": "B"}],
    )
    assert rows(vehicles.asking_prices(t), "vin", "sale_price") == [("A", money(1360)), ("B", money(900))]


def test_half_cents_round_up(spark):
    t = lot(spark, vehicle=[{"vin": "A"}], purchase=[{"vin": "A", "purchase_price": money("0.02")}])
    assert rows(vehicles.asking_prices(t), "sale_price") == [(money("0.03"),)]


def test_two_different_purchases_are_two_rows_and_equal_ones_collapse(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}, {"vin": "B"}],
        purchase=[
            {"vin": "A", "username": "u"},
            {"vin": "A", "username": "w", "purchase_price": money(2000)},
            {"vin": "B", "username": "u"},
            {"vin": "B", "username": "w"},
        ],
    )
    found = vehicles.search_vehicles(t, "Inventory clerk")
    assert rows(found, "vin", "purchase_price") == [("A", money(1000)), ("A", money(2000)), ("B", money(1000))]


@pytest.fixture(scope="module")
def mixed(spark):
    """Free: nothing ordered; Ready: parts installed; Waiting: a part ordered; Gone: sold with a part ordered."""
    return lot(
        spark,
        vehicle=[{"vin": v} for v in ("Free", "Ready", "Waiting", "Gone")],
        parts_order=[{"vin": v, "order_number": f"{v}-001"} for v in ("Ready", "Waiting", "Gone")],
        part=[
            {"order_number": "Ready-001"},
            {"order_number": "Waiting-001", "vendor_parts_number": "P1"},
            {"order_number": "Waiting-001", "vendor_parts_number": "P2", "status": "Ordered"},
            {"order_number": "Gone-001", "status": "Ordered"},
        ],
        sale=[{"vin": "Gone"}],
        purchase=[{"vin": v} for v in ("Free", "Ready", "Waiting", "Gone")],
        vendor=[{"name": "Acme"}],
    )


@pytest.mark.parametrize(
    ("role", "status", "vins"),
    [
        ("Public", None, {"Free", "Ready"}),
        ("salesperson", "Sold", {"Free", "Ready"}),
        ("Inventory Clerk", None, {"Free", "Ready", "Waiting"}),
        ("Manager", None, {"Free", "Ready", "Waiting", "Gone"}),
        ("Owner", "Sold", {"Gone"}),
        ("Owner", "Unsold", {"Free", "Ready", "Waiting"}),
        ("Owner", "All Vehicles", {"Free", "Ready", "Waiting", "Gone"}),
    ],
)
def test_roles_see_their_vehicles(mixed, role, status, vins):
    found = vehicles.search_vehicles(mixed, role, vehicle_status=status)
    assert {r.vin for r in found.collect()} == vins


def test_roles_see_their_columns(mixed):
    assert vehicles.search_vehicles(mixed, "Public").columns[-1] == "sale_price"
    clerk = vehicles.search_vehicles(mixed, "Inventory clerk").columns
    assert "sale_price" not in clerk and "purchase_price" in clerk
    assert len(vehicles.search_vehicles(mixed, "Owner").columns) == 13


def test_unknown_role_is_an_error(mixed):
    with pytest.raises(ValueError):
        vehicles.search_vehicles(mixed, "Guest")
    with pytest.raises(ValueError):
        resolve_role("")
    assert may_filter_by_vin("Inventory Clerk") and not may_filter_by_vin("Public")
    assert may_filter_by_status("owner") and not may_filter_by_status("Salesperson")


def test_counts(mixed):
    assert rows(inventory.vehicle_counts(mixed, "Owner")) == [(2, 1)]
    assert inventory.vehicle_counts(mixed, "Public").columns == ["available_count"]
    assert rows(inventory.count_available(mixed)) == [(2,)]
    assert rows(inventory.count_pending_parts(mixed)) == [(1,)]


def test_eligibility(mixed):
    assert rows(inventory.sale_eligibility(mixed)) == [
        ("Free", True, True, True),
        ("Gone", False, False, False),
        ("Ready", True, True, True),
        ("Waiting", True, False, False),
    ]


def test_keyword(spark):
    t = lot(
        spark,
        vehicle=[
            {"vin": "A", "model_name": "abc"},
            {"vin": "B", "description": "Citroën Räder", "year": 1995},
            {"vin": "C", "manufacturer_name": "BMW", "description": "a.c"},
        ],
    )

    def hits(keyword, **options):
        return [v for (v,) in rows(vehicles.search_vehicles(t, "Owner", keyword=keyword, **options), "vin")]

    assert hits("a%c") == ["A", "C"]
    assert hits("ABC") == ["A"]
    assert hits("199") == ["B"]
    assert hits("bmw") == ["C"]
    assert hits("citroen") == []
    assert hits("CITROEN RADER", accent_insensitive=True) == ["B"]


def test_filters_combine_and_any_means_no_filter(spark):
    t = lot(spark, vehicle=[{"vin": "A"}, {"vin": "B", "year": 1990}, {"vin": "C", "fuel_type": "Diesel"}])
    found = vehicles.search_vehicles(t, "Owner", vehicle_type="suv", manufacturer="", year="2001", fuel_type="Any")
    assert [v for (v,) in rows(found, "vin")] == ["A", "C"]
    assert rows(vehicles.search_vehicles(t, "Owner", vin="b"), "vin") == [("B",)]
    assert rows(vehicles.search_vehicles(t, "Owner", vin=t.vehicle.where("year = 2001")), "vin") == [("A",), ("C",)]


def test_details_by_role(mixed):
    public = vehicles.vehicle_details(mixed, "Public")
    assert {r.vin for r in public.collect()} == {"Free", "Ready"}
    assert public.where("vin = 'Free'").count() == 10
    owner = vehicles.vehicle_details(mixed, "Owner", vins="Gone")
    shown = {r.attribute: r.value for r in owner.collect()}
    assert shown["SalePrice"] == "900.00" and shown["SaleDate"] == "2024-01-10" and len(shown) == 14
    assert vehicles.vehicle_details(mixed, "Owner", vins="Gone", unsold_only=True).count() == 0
    assert vehicles.vehicle_details(mixed, "Inventory clerk").count() == 3 * 14


def test_sellable_vehicle_ignores_pending_parts(mixed):
    assert [v for (v,) in rows(vehicles.sellable_vehicle(mixed), "vin")] == ["Free", "Ready", "Waiting"]
    assert rows(vehicles.sellable_vehicle(mixed, "Gone")) == []


def test_vehicle_parts(mixed):
    assert rows(lookups.vehicle_parts(mixed, "Waiting"), "vendor_parts_number", "part_status") == [
        ("P1", "Installed"),
        ("P2", "Ordered"),
    ]


def test_contacts(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}],
        customer=[{"customer_id": 1}, {"customer_id": 2}],
        user=[{"username": "u"}],
        purchase=[
            {"vin": "A", "customer_id": 2, "purchased_on": date(2024, 2, 1)},
            {"vin": "A", "customer_id": 1},
            {"vin": "A", "customer_id": 9},
        ],
        sale=[{"vin": "A", "username": "nobody"}],
    )
    assert lookups.purchase_details(t).count() == 2
    first = lookups.purchase_details(t, one_per_vin=True)
    assert rows(first, "seller_address", "clerk_username") == [("1 Main, Town, ST 00123", "u")]
    assert lookups.sale_details(t).count() == 0
    assert lookups.purchase_attributes(t, "A").count() == 12


def test_identifiers(spark):
    t = lot(
        spark,
        individual_customer=[{"customer_id": 1, "social_security_number": "012"}],
        business_customer=[{"customer_id": 2, "tax_identification_number": "80-1"}],
    )
    assert rows(lookups.customer_identifiers(t)) == [("012",), ("80-1",)]
    assert rows(lookups.customer_lookup(t, "80-1")) == [("80-1", 2)]
    wanted = spark.createDataFrame([("012",), ("none",), ("012",)], "identifier string")
    assert rows(lookups.customer_lookup(t, wanted)) == [("012", 1)]


def test_pick_lists(spark):
    t = lot(spark, vendor=[{"name": "Acme"}])
    assert rows(lookups.list_vendors(t)) == [("Acme",)]
    assert lookups.list_dimension_values(t).count() == 26 + 48 + 9
    options = lookups.filter_options(t, 2024)
    assert options.where("option = 'year'").count() == 1 + 46
    assert options.where("value = 'Any'").count() == 5
    assert options.where("value = 'Battery'").count() == 1
    with pytest.raises(ValueError):
        lookups.distinct_values(t, "vehicle", "1; drop")


def test_display(mixed):
    shown = display(vehicles.search_vehicles(mixed, "Public"), "search")
    assert shown.columns[0] == "VIN" and [r.VIN for r in shown.collect()] == ["Free", "Ready"]
    assert display(vehicles.search_vehicles(mixed, "Public"), "search", limit=1).count() == 1
