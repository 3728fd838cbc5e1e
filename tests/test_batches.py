"""Write batches: rules, competition inside a batch, numbering, status moves, next snapshots."""

import random
from datetime import date

import pytest
from lot import DAY, frame, lot, money, rows

from forecourt.operators import batches, quality

VEHICLE = (
    "submission_id long, vin string, vehicle_type string, manufacturer_name string, condition string, "
    "model_name string, year int, fuel_type string, horsepower int, description string, colors array<string>, "
    "username string, seller_identifier string, purchase_price decimal(12,2), purchased_on date"
)


def offer(id_, vin, **changes):
    row = {
        "submission_id": id_, "vin": vin, "vehicle_type": "SUV", "manufacturer_name": "Kia", "condition": "Good",
        "model_name": "M", "year": 2000, "fuel_type": "Gas", "horsepower": 90, "description": None, "colors": ["Red", "Red", "Blue"],
        "username": "u", "seller_identifier": "111", "purchase_price": money(10), "purchased_on": DAY,
    }
    row.update(changes)
    return tuple(row.values())


@pytest.fixture(scope="module")
def base(spark):
    return lot(
        spark,
        vehicle=[{"vin": "OLD"}, {"vin": "GONE"}, {"vin": "BUSY"}],
        purchase=[{"vin": v} for v in ("OLD", "GONE", "BUSY")],
        sale=[{"vin": "GONE"}],
        vendor=[{"name": "Acme"}],
        parts_order=[{"vin": "BUSY", "order_number": "BUSY-001"}, {"vin": "BUSY", "order_number": "BUSY-003"}],
        part=[{"order_number": "BUSY-001", "status": "Received"}, {"order_number": "BUSY-003"}],
        customer=[{"customer_id": 7}, {"customer_id": 8}],
        individual_customer=[{"customer_id": 7, "social_security_number": "111"}],
        business_customer=[{"customer_id": 8, "tax_identification_number": "22-2"}],
        user=[{"username": "u"}],
    )


@pytest.mark.parametrize("pinned", [False, True])
def test_vehicle_batch(spark, base, pinned):
    offers = spark.createDataFrame(
        [
            offer(1, "N1"),
            offer(2, "N1"),
            offer(3, "OLD"),
            offer(4, "N4", horsepower=0, year=1979),
            offer(5, "N5", colors=["Red", "Plaid"]),
            offer(6, "N6", seller_identifier="999", username="who"),
            offer(7, "N7", description="x" * 2055, vehicle_type="Boat"),
            offer(8, "N8", colors=[]),
            offer(9, "N4"),
            offer(10, "N" * 18, purchase_price=None),
        ],
        VEHICLE,
    )
    result = batches.apply_vehicle_batch(base, offers, 2024, pinned=pinned)
    assert rows(result.new_rows["vehicle"], "vin") == [("N1",), ("N4",)]
    assert rows(result.new_rows["vehicle_color"]) == [("N1", "Blue"), ("N1", "Red"), ("N4", "Blue"), ("N4", "Red")]
    assert rows(result.new_rows["purchase"], "vin", "customer_id") == [("N1", 7), ("N4", 7)]
    refused = {r.submission_id: set(r.reasons) for r in result.rejects.collect()}
    assert refused == {
        2: {"vin_repeated_in_batch"},
        3: {"vin_exists"},
        4: {"missing_horsepower", "year_out_of_range"},
        5: {"unknown_color"},
        6: {"unknown_seller", "unknown_user"},
        7: {"unknown_vehicle_type"},
        8: {"missing_colors"},
        10: {"missing_purchase_price"},
    }
    after = result.next_tables(base)
    assert after.vehicle.count() == 5 and quality.check_primary_keys(after).count() == 0


CUSTOMER = (
    "submission_id long, customer_type string, email string, phone_number string, street string, city string, "
    "state string, postal_code string, first_name string, last_name string, social_security_number string, "
    "business_name string, tax_identification_number string, contact_first_name string, contact_last_name string, "
    "contact_title string"
)


def test_customer_batch(spark, base):
    contact = ("e", "1", "s", "c", "t", "0")
    no_person, no_firm = (None,) * 3, (None,) * 5
    firm = ("F", "33-3", "a", "b", "boss")
    batch = spark.createDataFrame(
        [
            (1, "Individual", *contact, "A", "B", "333", *no_firm),
            (2, "Individual", *contact, "A", "B", "111", *no_firm),
            (3, "Business", *contact, *no_person, *firm),
            (4, "Business", *contact, *no_person, *firm),
            (5, "Individual", None, *contact[1:], "A", " ", "444", *no_firm),
            (6, "Robot", *contact, "A", "B", "555", *no_firm),
        ],
        CUSTOMER,
    )
    result = batches.apply_customer_batch(base, batch)
    assert rows(result.new_rows["customer"], "customer_id") == [(10,), (9,)]
    assert rows(result.new_rows["individual_customer"], "customer_id", "social_security_number") == [(9, "333")]
    assert rows(result.new_rows["business_customer"], "customer_id", "contact_first_name") == [(10, "a")]
    assert {r.submission_id: set(r.reasons) for r in result.rejects.collect()} == {
        2: {"identifier_exists"},
        4: {"identifier_repeated_in_batch"},
        5: {"missing_email", "missing_last_name"},
        6: {"bad_customer_type"},
    }


def test_vendor_batch(spark, base):
    batch = spark.createDataFrame(
        [
            (4, " New ", "1", "s", "c", "t", "0"),
            (2, "New", "2", "s", "c", "t", "0"),
            (3, "Acme", "1", "s", "c", "t", "0"),
            (1, "New", " ", "s", "c", "t", "0"),
        ],
        "submission_id long, name string, phone_number string, street string, city string, state string, postal_code string",
    )
    result = batches.apply_vendor_batch(base, batch)
    assert rows(result.new_rows["vendor"], "name", "phone_number") == [("New", "2")]
    assert {r.submission_id: r.reasons for r in result.rejects.collect()} == {
        1: ["missing_phone_number"],
        3: ["name_exists"],
        4: ["name_repeated_in_batch"],
    }


ORDER = (
    "submission_id long, vin string, vendor_name string, parts array<struct<part_description: string, "
    "vendor_part_number: string, unit_price: decimal(12,2), quantity: int, part_status: string>>"
)


def item(number="P", price="2.50", quantity=2, status="Ordered", text="bolt"):
    return (text, number, money(price), quantity, status)


@pytest.mark.parametrize("pinned", [False, True])
def test_parts_orders(spark, base, pinned):
    batch = spark.createDataFrame(
        [
            (5, " OLD ", "Acme", [item(), item("Q", "0.99", 1)]),
            (9, "OLD", "Acme", [item("")]),
            (1, "GONE", "Acme", [item()]),
            (2, "NONE", "Acme", [item()]),
            (3, "OLD", "Nobody", [item()]),
            (4, "OLD", "Acme", [item(price="0"), item("Q", text=" ")]),
            (6, "OLD", "Acme", []),
            (7, "OLD", "Acme", [item(), item(" P ")]),
            (10, "OLD", "Acme", [item(quantity=0, status="Lost")]),
            (11, "OLD", "Acme", [item(str(i)) for i in range(101)]),
            (12, "OLD", "Acme", [item("A", price="9999999999.00"), item("B", price="9999999999.00")]),
            (None, "OLD", "Acme", [item()]),
            (13, "OLD", "Acme", [item()]),
            (13, "OLD", "Acme", [item()]),
        ],
        ORDER,
    )
    result = batches.apply_parts_orders(base, batch, pinned=pinned)
    assert rows(result.new_rows["parts_order"]) == [
        ("OLD", "Acme", "OLD-001", money("5.99")),
        ("OLD", "Acme", "OLD-002", money("5.00")),
        ("OLD", "Acme", "OLD-003", money("505.00")),
    ]
    small = result.new_rows["part"].where("order_number <> 'OLD-003'")
    assert rows(small, "order_number", "vendor_parts_number", "quantity", "unit_price") == [
        ("OLD-001", "P", 2, money("2.50")),
        ("OLD-001", "Q", 1, money("0.99")),
        ("OLD-002", "", 2, money("2.50")),
    ]
    assert {r.submission_id: set(r.reasons) for r in result.rejects.collect()} == {
        1: {"sold_or_unknown_vehicle"},
        2: {"sold_or_unknown_vehicle"},
        3: {"unknown_vendor"},
        4: {"bad_unit_price", "missing_part_description"},
        6: {"part_count"},
        7: {"repeated_part_number"},
        10: {"bad_quantity", "bad_status"},
        12: {"total_out_of_range"},
        None: {"missing_submission_id"},
        13: {"repeated_submission_id"},
    }
    assert result.rejects.count() + 3 == batch.count()


def _joins_with(df, column: str) -> int:
    """Joins one of whose sides brings a column."""
    def count(node) -> int:
        below = [node.children().apply(i) for i in range(node.children().size())]
        here = node.nodeName() == "Join" and any(f"{column}#" in child.output().toString() for child in below)
        return here + sum(count(child) for child in below)

    return count(df._jdf.queryExecution().optimizedPlan())


def test_parts_move_only_to_their_order(spark, base):
    batch = spark.createDataFrame([(i, "OLD", "Acme", [item(), item(f"Q{i}")]) for i in range(3)], ORDER)
    result = batches.apply_parts_orders(base, batch, pinned=False)
    assert _joins_with(result.rejects, "parts") == _joins_with(result.new_rows["parts_order"], "parts") == 0
    assert _joins_with(result.new_rows["part"], "parts") == 1
    assert result.new_rows["part"].count() == 6


def test_a_taken_order_number_stops_the_rest_of_the_batch(spark, base):
    batch = spark.createDataFrame([(i, "BUSY", "Acme", [item()]) for i in (1, 2)], ORDER)
    result = batches.apply_parts_orders(base, batch)  # two orders exist, so the next is number 3, which is taken
    assert result.new_rows["parts_order"].count() == 0
    assert [r.reasons for r in result.rejects.collect()] == [["order_number_exists"]] * 2


def test_a_number_used_by_another_vehicle_counts_as_taken(spark, base):
    t = base.appended(parts_order=frame(spark, "parts_order", [{"vin": "BUSY", "order_number": "OLD-002"}]))
    batch = spark.createDataFrame([(i, "OLD", "Acme", [item()]) for i in (1, 2, 3)], ORDER)
    result = batches.apply_parts_orders(t, batch)
    assert rows(result.new_rows["parts_order"], "order_number") == [("OLD-001",)]
    assert rows(result.rejects, "submission_id") == [(2,), (3,)]


def test_order_numbers_grow_past_999(spark):
    many = [{"vin": "A", "order_number": f"A-{i:03d}"} for i in range(1, 1000)]
    t = lot(spark, vehicle=[{"vin": "A"}], vendor=[{"name": "Acme"}], parts_order=many)
    batch = spark.createDataFrame([(i, "A", "Acme", [item()]) for i in (3, 8)], ORDER)
    made = batches.apply_parts_orders(t, batch).new_rows["parts_order"]
    assert rows(made, "order_number") == [("A-1000",), ("A-1001",)]


UPDATE = "order_number string, vendor_parts_number string, new_status string, seq int"


@pytest.mark.parametrize("seq", ["int", "bigint", "decimal(9,1)", "string"])
def test_updates_are_dealt_out_before_they_are_sorted(spark, base, seq):
    many = spark.range(20_000).selectExpr(
        "'BUSY-003' AS order_number", "'P1' AS vendor_parts_number",
        "if(id = 17001, 'Received', 'Installed') AS new_status", f"cast(10000 + (id + 2998) % 20000 AS {seq}) AS seq",
    )
    nameless = [(None, "P1", "Installed", 1), ("BUSY-001", None, "Installed", 1), ("BUSY-003", "P1", "Installed", None)]
    updates = many.union(spark.createDataFrame(nameless, UPDATE))
    after = batches.apply_status_updates(base, updates)
    assert rows(after, "order_number", "status") == [("BUSY-001", "Received"), ("BUSY-003", "Received")]
    # A plan is printed from its result to its scans.
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("REPARTITION_BY_NUM") > plan.rfind("SortAggregate") > 0


def test_status_updates_last_one_wins(spark, base):
    updates = spark.createDataFrame(
        [
            ("BUSY-003", "P1", "Ordered", 2),
            ("BUSY-003", "P1", "Received", 1),
            ("BUSY-001", "P1", "Lost", 9),
            ("NONE", "P1", "Installed", 1),
        ],
        UPDATE,
    )
    assert rows(batches.apply_status_updates(base, updates), "order_number", "status") == [
        ("BUSY-001", "Received"),
        ("BUSY-003", "Ordered"),
    ]
    assert rows(batches.status_update_results(base, updates), "order_number", "seq", "matched") == [
        ("BUSY-001", 9, False),
        ("BUSY-003", 1, True),
        ("BUSY-003", 2, True),
        ("NONE", 1, False),
    ]


def _moves_by_part(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(order_number")


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_update_results_move_each_update_once(spark, base, no_broadcast):
    updates = spark.createDataFrame([("BUSY-003", f"P{i % 2}", "Received", i) for i in range(10)], UPDATE)
    results = batches.status_update_results(base, updates)
    assert _moves_by_part(results) == 3  # the updates, the parts made distinct, and these to the updates
    assert results.where("matched").count() == 5


LEGAL = {("Ordered", "Received"), ("Ordered", "Installed"), ("Received", "Installed")}


def test_status_transitions_equal_a_replay(spark):
    rng = random.Random(3)
    statuses = ["Ordered", "Received", "Installed"]
    parts = {f"O{i}": rng.choice(statuses) for i in range(60)}
    moves = [(f"O{i}", "P1", rng.choice(statuses), seq) for i in range(62) for seq in range(rng.randint(0, 6))]
    t = lot(spark, part=[{"order_number": o, "status": s} for o, s in parts.items()])

    final, applied = dict(parts), {}
    for order, _, new, seq in sorted(moves, key=lambda m: m[3]):
        applied[order, seq] = (final.get(order), new) in LEGAL
        if applied[order, seq]:
            final[order] = new
    updates = spark.createDataFrame(moves, UPDATE)
    assert dict(rows(batches.apply_status_transitions(t, updates), "order_number", "status")) == final
    results = batches.status_transition_results(t, updates)
    assert {(r.order_number, r.seq): r.applied for r in results.collect()} == applied


def test_transition_results_move_updates_and_parts_once(spark, base, no_broadcast):
    # A part with more updates than meet in one place: the first that installs it and the one before that receives it.
    many = spark.range(3000).selectExpr("'BUSY-003' AS order_number", "'P1' AS vendor_parts_number", "id", "3000 - id AS seq")
    many = many.selectExpr("* except (id)", "if(id = 2999, 'Ordered', if(id = 2998, 'Received', 'Installed')) AS new_status")
    other = spark.createDataFrame([("BUSY-001", "P1", 7, "Installed"), (None, "P1", 1, "Installed")], "a string, b string, c long, d string")
    parts = [{"order_number": "BUSY-003", "status": "Ordered"}, {"order_number": "BUSY-001", "status": "Installed"}]
    tables = base.with_tables(part=frame(spark, "part", parts))
    results = batches.status_transition_results(tables, many.union(other))
    assert _moves_by_part(results) <= 4  # the updates, the parts, and of parts with many updates the firsts, to and fro
    assert rows(results.where("applied"), "seq", "new_status") == [(2, "Received"), (3, "Installed")]
    assert results.count() == 3002


def test_sales(spark, base):
    batch = spark.createDataFrame(
        [
            (5, "OLD", "22-2", "u", date(2024, 3, 1)),
            (6, "OLD", "111", "u", date(2024, 3, 1)),
            (4, "OLD", "nobody", "u", date(2024, 3, 1)),
            (1, "GONE", "111", "u", date(2024, 3, 1)),
            (2, "BUSY", "111", "u", date(2024, 3, 1)),
            (3, "NONE", "111", "who", None),
        ],
        "submission_id long, vin string, buyer_identifier string, username string, sold_on date",
    )
    result = batches.apply_sales(base, batch)
    assert rows(result.new_rows["sale"]) == [("OLD", 8, "u", money(1250), date(2024, 3, 1))]
    assert {r.submission_id: set(r.reasons) for r in result.rejects.collect()} == {
        1: {"already_sold"},
        2: {"parts_pending"},
        3: {"unknown_vehicle", "unknown_user", "missing_sold_on"},
        4: {"unknown_buyer"},
        6: {"vin_repeated_in_batch"},
    }


def test_a_vehicle_never_bought_has_no_price(spark, base):
    t = base.with_tables(purchase=base.purchase.limit(0))
    batch = spark.createDataFrame(
        [(1, "OLD", "111", "u", DAY)],
        "submission_id long, vin string, buyer_identifier string, username string, sold_on date",
    )
    assert [r.reasons for r in batches.apply_sales(t, batch).rejects.collect()] == [["no_price"]]


def test_sale_price_comes_from_the_earliest_purchase(spark):
    t = lot(
        spark,
        purchase=[{"vin": "A", "purchase_price": money(200), "purchased_on": date(2024, 2, 2)}, {"vin": "A", "username": "w"}],
        parts_order=[{"vin": "A", "order_number": "A-001", "total_cost": money(100)}],
    )
    assert rows(batches.sale_prices(t)) == [("A", money(1360))]
