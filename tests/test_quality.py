"""Planted faults are all found, and nothing else."""

from lot import lot, rows

from forecourt.operators import quality


def test_primary_keys(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A"}, {"vin": "A"}, {"vin": "B"}],
        parts_order=[{"vin": "A", "order_number": "1"}, {"vin": "B", "order_number": "1"}],
        purchase=[{"vin": "A"}, {"vin": "A", "username": "w"}],
        individual_customer=[{"customer_id": 1, "social_security_number": "1"}, {"customer_id": 1, "social_security_number": "2"}],
    )
    assert rows(quality.check_primary_keys(t)) == [
        ("individual_customer_id_uq", "1", 2),
        ("parts_order_number_uq", "1", 2),
        ("vehicle_pk", "A", 2),
    ]
    assert rows(quality.check_primary_keys(t, ["purchase_pk"])) == []


def test_keys_never_read_alike(spark):
    keys = [("a|b", "c"), ("a", "b|c"), ("a\\", "c"), ("", "c")]
    t = lot(spark, vehicle_color=[{"color_name": c, "vin": v} for c, v in keys for _ in range(2)])
    found = [r.key for r in quality.check_primary_keys(t, ["vehicle_color_pk"]).collect()]
    assert set(found) == {"a\\|b|c", "a|b\\|c", "a\\\\|c", "|c"}


def test_foreign_keys(spark):
    t = lot(
        spark,
        vehicle=[{"vin": "A", "vehicle_type": "Boat"}, {"vin": "B", "vehicle_type": "Boat"}],
        vehicle_color=[{"vin": "A", "color_name": "Plaid"}, {"vin": "Z", "color_name": "Red"}],
        sale=[{"vin": "A", "customer_id": 5}],
        user=[{"username": "u"}],
        part=[{"order_number": "lost"}],
    )
    assert rows(quality.check_foreign_keys(t)) == [
        ("part.order_number", "lost", 1),
        ("sale.customer_id", "5", 1),
        ("vehicle.vehicle_type", "Boat", 2),
        ("vehicle_color.color_name", "Plaid", 1),
        ("vehicle_color.vin", "Z", 1),
    ]


def test_domains(spark):
    t = lot(spark, vehicle=[{"vin": "A", "condition": "Poor"}, {"vin": "B", "fuel_type": "Coal"}], part=[{"order_number": "1"}])
    lost = t.part.selectExpr("order_number", "vendor_parts_number", "nullif(1, 1) AS quantity", "description", "status", "unit_price")
    found = quality.check_domains(t.with_tables(part=lost)).where("violations > 0")
    assert rows(found) == [
        ("part", "quantity", "not_null", 1),
        ("vehicle", "condition", "domain", 1),
        ("vehicle", "fuel_type", "domain", 1),
    ]


def test_null_counts_as_a_broken_rule(spark):
    df = spark.createDataFrame([(1, None, None)], "submission_id long, name string, phone_number string")
    checked = quality.validate_submissions(df, quality.required("name", "phone_number"))
    assert checked.first().reasons == ["missing_name", "missing_phone_number"]
