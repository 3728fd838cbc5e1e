"""Keys in several spellings, and raw rows that claim one key."""

import pytest
from lot import lot, rows
from pyspark.sql import functions as F

from forecourt.functions.text import same_text
from forecourt.operators import batches, ingest, quality, reports, vehicles
from forecourt.operators.arbitration import reject_later_claims
from forecourt.operators.collation import KEY_DOMAINS, collated, other_spellings, respelled


@pytest.fixture(scope="module")
def shop(spark):
    return respelled(
        lot(
            spark,
            vehicle=[
                {"vin": "v1", "manufacturer_name": "KIA"}, {"vin": "V2", "manufacturer_name": "Kía"},
                {"vin": "V3", "manufacturer_name": "Kia"}, {"vin": "V4", "manufacturer_name": "Ghöst"},
                {"vin": "V5", "manufacturer_name": "GHOST"},
            ],
            vendor=[{"name": "Acme"}, {"name": "ÁCME"}],
            parts_order=[{"vin": "V1", "vendor_name": "acme", "order_number": "V1-001"}],
            part=[{"order_number": "v1-001"}],
            user=[{"username": "ann"}],
            sale=[{"vin": "V1", "username": "ANN"}, {"vin": "V2", "username": "Ánn"}],
        )
    )


def test_every_text_key_has_a_domain():
    columns = {c for domain in KEY_DOMAINS for c in domain}
    assert {("vehicle", "vin"), ("sale", "vin"), ("part", "order_number"), ("individual_customer", "social_security_number")} <= columns
    assert ("customer", "customer_id") not in columns


def test_one_spelling_per_key(shop):
    assert rows(shop.vehicle, "vin", "manufacturer_name") == [
        ("V2", "Kia"), ("V3", "Kia"), ("V4", "GHOST"), ("V5", "GHOST"), ("v1", "Kia")
    ]
    assert rows(shop.parts_order, "vin", "vendor_name") == [("v1", "Acme")]
    assert rows(shop.sale, "vin", "username") == [("V2", "ann"), ("v1", "ann")]
    assert rows(shop.part, "order_number") == [("V1-001",)]


def test_checks_fold_case_and_accents(shop):
    assert ("vendor_pk", "Acme", 2) in rows(quality.check_primary_keys(shop, ["vendor_pk"]))
    lost = [r for r in rows(quality.check_foreign_keys(shop)) if not r[0].endswith("customer_id")]
    assert lost == [("vehicle.manufacturer_name", "GHOST", 2)]


def test_search_and_reports_fold_case_and_accents(spark, shop):
    assert len(rows(vehicles.matching_vehicles(shop, manufacturer="kÍA"))) == 3
    assert len(rows(vehicles.matching_vehicles(shop, manufacturer="ghost"))) == 2
    assert set(rows(reports.parts_statistics(shop), "vendor_name")) == {("Acme",)}
    names = spark.createDataFrame([("Zoë",), ("ZOE",), ("Zoé x",), (None,)], "n string")
    assert names.where(same_text(F.col("n"), "zoe")).count() == 2


def test_vehicle_batch_finds_respelled_keys(spark, shop):
    offer = {
        "submission_id": 1, "vin": "V2", "vehicle_type": "SUV", "manufacturer_name": "Kia", "condition": "Good",
        "model_name": "m", "year": 2001, "fuel_type": "Gas", "horsepower": 1, "description": "", "colors": ["Red"],
        "username": "ann", "seller_identifier": "1", "purchase_price": 1.0, "purchased_on": "2024-01-01",
    }
    result = batches.apply_vehicle_batch(shop, spark.createDataFrame([offer]), 2024)
    assert {r for s in result.rejects.collect() for r in s.reasons} == {"vin_exists", "unknown_seller"}


def test_claims_of_several_domains(spark):
    made = [(1, "a", "x", []), (2, "a", "y", []), (3, None, "x", []), (4, "b", None, []), (5, "c", "z", ["bad"]), (6, "c", "z", [])]
    frame = spark.createDataFrame(made, "_row int, k string, l string, reasons array<string>")
    judged = reject_later_claims(frame, {"again_k": F.col("k"), "again_l": F.col("l")})
    assert {r["_row"]: r.reasons for r in judged.collect()} == {
        1: [], 2: ["again_k"], 3: ["again_l"], 4: [], 5: ["bad"], 6: []
    }


def test_a_key_that_a_third_of_the_rows_claims(spark):
    frame = spark.range(30_000).selectExpr("id AS _row", "if(id % 3 = 0, 'hot', string(id)) AS k", "array() AS reasons")
    frame = frame.withColumn("reasons", F.col("reasons").cast("array<string>"))
    judged = reject_later_claims(frame, {"again": F.col("k")})
    assert judged.where("size(reasons) > 0").count() == 9_999
    assert judged.where("_row = 0 AND size(reasons) = 0").count() == 1


def test_accepted_and_rejected_are_all(spark):
    raw = spark.createDataFrame([("n", "1")] * 3 + [("m", "2"), (None, "3"), (" ", "4")], "vendor_name string, phone string")
    raw = raw.withColumns({c: F.lit("x") for c in ("street", "city", "state", "postal_code")})
    result = ingest.ingest_vendors(raw)
    assert rows(result.rows["vendor"], "name") == [("m",), ("n",)]
    assert sorted((r.vendor_name or "", r.reasons) for r in result.rejects.collect()) == [
        ("", ["missing_vendor_name"]), (" ", ["missing_vendor_name"]), ("n", ["repeated_vendor_name"]), ("n", ["repeated_vendor_name"])
    ]


def test_classes_are_those_of_the_collation(spark):
    """Letters outside ASCII, ligatures, signs without weight and control characters link what the collation links."""
    texts = ["Strasse", "STRASSE", "straße", "Kia", "ｋia", "KÍA", "Ki­a", "a\tb", "A\tb", "a b", "①", "1", "", "\u0001", "ж", "Ж", "é", "É", "[", "{"]
    makers = [{"vin": f"V{n}", "manufacturer_name": text} for n, text in enumerate(texts)]
    tables = lot(spark, vehicle=makers, manufacturer=[{"manufacturer_name": "Kia"}])
    domain = next(d for d in KEY_DOMAINS if d[0][0] == "manufacturer")
    changes = dict(rows(other_spellings(tables, domain)))
    values = spark.createDataFrame([(t,) for t in texts], "value string")
    a, b = values.toDF("a"), values.toDF("b")
    alike = {tuple(r) for r in a.join(b, collated(F.col("a")) == collated(F.col("b"))).collect()}
    assert {(x, y) for x in texts for y in texts if changes.get(x, x) == changes.get(y, y)} == alike
    assert changes["KÍA"] == "Kia" and "Kia" not in changes


def test_printable_keys_are_grouped_without_the_collation(spark):
    tables = lot(spark, vehicle=[{"vin": "V1"}, {"vin": "v1"}, {"vin": "V2"}])
    found = other_spellings(tables, next(d for d in KEY_DOMAINS if d[0] == ("vehicle", "vin")))
    assert "collat" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert rows(found) == [("V1", "v1")]
