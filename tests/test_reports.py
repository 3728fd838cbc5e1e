"""Reports on hand-made rows, including several purchases and sales of one vehicle."""

from datetime import date, timedelta

from lot import DAY, lot, money, rows

from forecourt.operators import reports
from forecourt.operators.display import display


def _part(order, quantity, price, number="P1"):
    return {"order_number": order, "vendor_parts_number": number, "quantity": quantity, "unit_price": money(price)}


def test_seller_history_names_averages_and_flags(spark):
    t = lot(
        spark,
        purchase=[
            {"vin": "A", "customer_id": 1, "purchase_price": money("10.01")},
            {"vin": "B", "customer_id": 1, "purchase_price": money("10.02")},
            {"vin": "C", "customer_id": 2},
            {"vin": "D", "customer_id": 3},
            {"vin": "E", "customer_id": 4},
        ],
        individual_customer=[{"customer_id": 1, "social_security_number": "1"}, {"customer_id": 4, "social_security_number": "4"}],
        business_customer=[{"customer_id": 2, "tax_identification_number": "2"}],
        parts_order=[{"vin": v, "order_number": f"{v}-001"} for v in "ACDE"],
        part=[
            _part("A-001", 10, 1),
            _part("C-001", 1, 500),
            _part("D-001", 4, "0.01"),
            _part("E-001", 1, "499.99"),
        ],
    )
    assert rows(reports.seller_history(t)) == [
        (1, "Ann Lee", 2, money("10.02"), 5.0, 5.0, True),
        (2, "Firm", 1, money(1000), 1.0, 500.0, True),
        (3, None, 1, money(1000), 4.0, 0.04, False),
        (4, "Ann Lee", 1, money(1000), 1.0, 499.99, False),
    ]
    shown = display(reports.seller_history(t), "seller_history").collect()
    assert shown[0]["Total Vehicles Sold"] == 2 and shown[0]["Avg Purchase Price"] == "$10.02"
    assert shown[0]["Avg Parts Quantity Per Vehicle"] == 5.0


def test_vehicle_without_parts_counts_as_zero(spark):
    t = lot(spark, purchase=[{"vin": "A"}])
    assert rows(reports.seller_history(t), "avg_parts_quantity", "avg_parts_cost", "flagged") == [(0.0, 0.0, False)]


def test_inventory_time(spark):
    def typed(vin, kind):
        return {"vin": vin, "vehicle_type": kind}

    t = lot(
        spark,
        vehicle=[typed("A", "SUV"), typed("B", "Van"), typed("C", "Truck"), typed("D", "Coupe"), typed("E", "Spaceship"), typed("F", "Sedan")],
        purchase=[{"vin": v} for v in "ABCDE"],
        sale=[
            {"vin": "A"},
            {"vin": "C", "sold_on": DAY - timedelta(days=3)},
            {"vin": "D", "sold_on": DAY + timedelta(days=1)},
            {"vin": "D", "sold_on": DAY + timedelta(days=2), "username": "w"},
            {"vin": "E"},
            {"vin": "F"},
        ],
    )
    assert rows(reports.avg_inventory_time(t), "vehicle_type", "avg_inventory_time") == [
        ("Coupe", "2.50"),
        ("SUV", "1.00"),
        ("Sedan", None),  # sold but never bought: there is nothing to average
        ("Truck", "-2.00"),
        ("Van", "N/A"),
    ]


def test_price_per_condition(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}, {"vin": "B"}, {"vin": "C", "condition": "Very Good"}, {"vin": "D", "vehicle_type": "Van"}],
        purchase=[{"vin": "A"}, {"vin": "A", "username": "w", "purchase_price": money(4000)}, {"vin": "B"}, {"vin": "C"}],
    )
    assert rows(reports.price_per_condition(t)) == [("SUV", 0.0, 1000.0, 2000.0, 0.0), ("Van", 0.0, 0.0, 0.0, 0.0)]


def test_parts_statistics(spark):
    t = lot(
        spark,
        vendor=[{"name": "Acme"}, {"name": "Idle"}],
        parts_order=[{"vin": "A", "order_number": "1"}, {"vin": "B", "order_number": "2"}],
        part=[_part("1", 2, "1.50"), _part("1", 1, 2, "P2"), _part("2", 3, 1)],
    )
    assert rows(reports.parts_statistics(t)) == [("Acme", 6, money(8))]
    assert display(reports.parts_statistics(t), "parts_statistics").first()["Total Amount Spent"] == "$8.00"


def test_monthly_sales_counts_every_purchase_of_a_sold_vehicle(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}, {"vin": "B"}],
        purchase=[{"vin": "A"}, {"vin": "A", "username": "w", "purchase_price": money(500)}],
        sale=[{"vin": "A", "sale_price": money(1500)}, {"vin": "B"}],
        parts_order=[{"vin": "A", "order_number": "A-001", "total_cost": money(10)}],
    )
    # (1500 - 1000 - 10) + (1500 - 500 - 10); the sale of B, never bought, drops out.
    assert rows(reports.monthly_sales(t)) == [(2024, 1, 2, money(3000), money(1480))]
    shown = display(reports.monthly_sales(t), "monthly_sales").first()
    assert (shown["Year"], shown["Net Income"]) == ("2024", "$1,480.00")


def test_fan_out_totals_equal_the_multiplied_rows(spark):
    """Closed formulas against joining every purchase with every sale."""
    purchases = [{"vin": f"V{i % 3}", "customer_id": i, "purchase_price": money(100 + i), "purchased_on": DAY + timedelta(days=i)} for i in range(9)]
    sales = [{"vin": f"V{i % 4}", "customer_id": i, "sale_price": money(300 + i), "sold_on": DAY + timedelta(days=9 * i)} for i in range(10)]
    t = lot(
        spark,
        vehicle=[{"vin": f"V{i}"} for i in range(4)],
        purchase=purchases,
        sale=sales,
        parts_order=[{"vin": f"V{i}", "order_number": str(i), "total_cost": money(7 * i)} for i in range(3)],
    )
    pairs = [(p, s) for p in purchases for s in sales if p["vin"] == s["vin"]]
    by_month: dict = {}
    for p, s in pairs:
        cell = by_month.setdefault((s["sold_on"].year, s["sold_on"].month), [0, money(0), money(0)])
        cell[0] += 1
        cell[1] += s["sale_price"]
        cell[2] += s["sale_price"] - p["purchase_price"] - money(7 * int(p["vin"][1:]))
    assert rows(reports.monthly_sales(t)) == sorted(
        ((*k, *v) for k, v in by_month.items()), key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    days = [(s["sold_on"] - p["purchased_on"]).days + 1 for p, s in pairs]
    assert rows(reports.avg_inventory_time(t), "avg_days") == [(money(round(sum(days) / len(days) + 1e-9, 2)),)]


def test_drilldown(spark):
    t = lot(
        spark,
        user=[{"username": "u"}, {"username": "w"}],
        sale=[
            {"vin": "A"},
            {"vin": "B", "username": "w"},
            {"vin": "C", "username": "w"},
            {"vin": "D", "username": "ghost"},
            {"vin": "E", "sold_on": date(2024, 2, 1)},
            {"vin": "F", "sold_on": date(2023, 12, 31)},
        ],
    )
    assert rows(reports.monthly_sales_drilldown(t, "2024", "01"), "username", "vehicles_sold", "total_sales") == [
        ("u", 1, money(900)),
        ("w", 2, money(1800)),
    ]
    assert rows(reports.monthly_sales_drilldown(t, 2023, 12), "vehicles_sold") == [(1,)]
    assert reports.sales_by_salesperson(t).count() == 4
    shown = display(reports.monthly_sales_drilldown(t, 2024, 1), "monthly_sales_drilldown").collect()
    assert [r["Vehicles Sold"] for r in shown] == [2, 1]
