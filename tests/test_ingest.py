"""Raw files and wide rows to normalized tables, and storage round trips."""

import csv
import io
from datetime import date

import pytest
from lot import lot, money, rows
from pyspark.sql import functions as F

from forecourt.operators import ingest
from forecourt.sources.files import read_broken, read_raw, read_tables, write_tables
from forecourt.tables import empty_tables, seed_rows


def _tsv(path, header, lines):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join("\t".join(cells) for cells in [header, *lines]) + "\n")
    return str(path)


@pytest.fixture
def customer_file(tmp_path):
    lines = []
    for i in range(200):
        email = "" if i % 10 == 0 else f"c{i}@x"
        contact = [email, f"{i:010d}", f"{i} Street", "Town", "ST", f"{i:05d}"]
        if i < 158:
            lines.append(["person", *contact, "", "", "", "", "", f"{i:09d}", "First", f"Last{i}"])
        else:
            lines.append(["business", *contact, f"80-{i:07d}", f"Firm {i}", "A", "B", "Boss", "", "", ""])
    return _tsv(tmp_path / "customers.tsv", ingest.RAW_COLUMNS["customers"], lines)


@pytest.mark.parametrize("order_by", [None, "number"])
def test_customers_file(spark, customer_file, order_by):
    raw = read_raw(spark, customer_file, "customers").withColumn("number", F.col("phone").cast("bigint"))
    result = ingest.ingest_customers(raw, order_by=order_by, start=100)
    customer, person, firm = (result.rows[t] for t in ("customer", "individual_customer", "business_customer"))
    assert (customer.count(), person.count(), firm.count()) == (200, 158, 42)
    assert sorted(r.customer_id for r in customer.collect()) == list(range(101, 301))
    assert customer.where("email IS NULL").count() == 20
    assert person.where("social_security_number = '000000007'").count() == 1
    assert customer.where("postal_code = '00007'").count() == 1
    assert customer.join(person.unionByName(firm, allowMissingColumns=True), "customer_id").count() == 200


def test_users_file_has_no_password(spark, tmp_path):
    path = _tsv(
        tmp_path / "users.tsv",
        ingest.RAW_COLUMNS["users"],
        [["owner", "x", "O", "O", "inventory clerk,salesperson,manager"], ["u1", "y", "A", "B", "inventory clerk"], ["u2", "z", "C", "D", "SALESPERSON"]],
    )
    raw = read_raw(spark, path, "users")
    assert "password" not in raw.columns
    result = ingest.ingest_users(raw).rows["user"]
    assert rows(result, "username", "role") == [("owner", "Owner"), ("u1", "Inventory clerk"), ("u2", "Salesperson")]


def test_vendors_file(spark, tmp_path):
    path = _tsv(tmp_path / "vendors.tsv", ingest.RAW_COLUMNS["vendors"], [["Acme", "01", "s", "c", "t", "00501"]])
    result = ingest.ingest_vendors(read_raw(spark, path, "vendors")).rows["vendor"]
    assert rows(result) == [("Acme", "01", "s", "c", "t", "00501")]


def test_a_wrong_header_is_an_error(spark, tmp_path):
    path = _tsv(tmp_path / "v.tsv", ["phone", "vendor_name", "street", "city", "state", "postal_code"], [["1", "A", "s", "c", "t", "0"]])
    with pytest.raises(Exception, match="(?i)header"):
        read_raw(spark, path, "vendors").collect()


def test_vehicles_file(spark, tmp_path):
    def wide(vin, **changes):
        cells = {
            "VIN": vin, "vehicle_type": "SUV", "condition": "Good", "manufacturer_name": "Kia", "model_name": "M",
            "year": "2001", "fuel_type": "Gas", "horsepower": "100", "description": "", "purchase_clerk": "u",
            "purchased_from_customer": "012", "price": "1000.50", "purchase_date": "2024-01-02", "colors": "Red, Blue,Red",
            "sale_date": "", "sold_to_customer": "", "salesperson": "",
        }
        cells.update(changes)
        return list(cells.values())

    sold = {"sale_date": "2024-02-01", "sold_to_customer": "80-1", "salesperson": "w"}
    path = _tsv(
        tmp_path / "vehicles.tsv",
        ingest.RAW_COLUMNS["vehicles"],
        [
            wide("A"),
            wide("B", **sold),
            wide("C", purchased_from_customer="nobody", year="old"),
            wide("D", **{**sold, "sold_to_customer": "nobody", "sale_date": "soon"}),
        ],
    )
    t = lot(
        spark,
        individual_customer=[{"customer_id": 1, "social_security_number": "012"}],
        business_customer=[{"customer_id": 2, "tax_identification_number": "80-1"}],
        user=[{"username": "u"}, {"username": "w"}],
    )
    result = ingest.ingest_vehicles(t, read_raw(spark, path, "vehicles"))
    assert rows(result.rows["vehicle"], "vin", "year", "description") == [("A", 2001, None), ("B", 2001, None)]
    assert rows(result.rows["purchase"]) == [
        ("A", 1, "u", money("1000.50"), date(2024, 1, 2)),
        ("B", 1, "u", money("1000.50"), date(2024, 1, 2)),
    ]
    assert rows(result.rows["vehicle_color"]) == [("A", "Blue"), ("A", "Red"), ("B", "Blue"), ("B", "Red")]
    assert rows(result.rows["sale"]) == [("B", 2, "w", money("1000.50"), date(2024, 2, 1))]
    assert {r.vin: set(r.reasons) for r in result.rejects.collect()} == {
        "C": {"unknown_seller", "bad_year"},
        "D": {"unknown_buyer", "bad_sale_date"},
    }


def test_vehicles_look_up_their_parties_once(spark):
    cells = {c: "x" for c in ingest.RAW_COLUMNS["vehicles"]} | {
        "VIN": "A", "vehicle_type": "SUV", "manufacturer_name": "Kia", "year": "2001", "horsepower": "100", "purchase_clerk": "u",
        "purchased_from_customer": "012", "price": "1.50", "purchase_date": "2024-01-02", "colors": "Red", "sale_date": "",
    }
    # Repeated rows share their line number; a row without one claims its VIN, too, but nothing takes it from it.
    raw = spark.createDataFrame(
        [{**cells, "line_no": 2}, {**cells, "line_no": 2}, {**cells, "line_no": 3}, {**cells, "line_no": None, "VIN": "B"}],
        ", ".join(f"{c} string" for c in cells) + ", line_no long",
    )
    t = lot(spark, individual_customer=[{"customer_id": 1, "social_security_number": "012"}], user=[{"username": "u"}])
    result = ingest.ingest_vehicles(t, raw)
    for frame in (*result.rows.values(), result.rejects):
        assert "social_security_number" not in frame._jdf.queryExecution().optimizedPlan().toString()
    lazy = ingest.ingest_vehicles(t, raw, pinned=False)
    for found in (result, lazy):
        assert rows(found.rows["vehicle"], "vin") == [("A",), ("A",), ("B",)]
        assert rows(found.rejects) == [("A", ["repeated_vin"])]



def test_parts_file_first_line_names_the_vendor(spark, tmp_path):
    path = _tsv(
        tmp_path / "parts.tsv",
        ingest.RAW_COLUMNS["parts"],
        [
            ["A", "001", "Zed", "P1", "1.50", "2", "installed", "x"],
            ["A", "001", "Acme", "P2", "2", "1", "ORDERED", "y"],
            ["B", "001", "Acme", "P1", "free", "1", "ordered", "z"],
        ],
    )
    result = ingest.ingest_parts(read_raw(spark, path, "parts", staging=str(tmp_path / "staging")))
    assert rows(result.rows["parts_order"]) == [("A", "Zed", "A-001", money(5))]
    assert rows(result.rows["part"], "vendor_parts_number", "status") == [("P1", "Installed"), ("P2", "Ordered")]
    assert rows(ingest.order_total_cost(result.rows["part"])) == [("A-001", money(5))]
    assert rows(result.rejects, "order_number") == [("B-001",)]


def test_an_order_is_stored_whole_or_not_at_all(spark):
    lines = [
        ("V1", "1", "Ven1", "P1", "no price", "1", "ordered", "x"),
        ("V1", "1", "Ven2", "P2", "5", "1", "ordered", "x"),
        ("V2", "1", "Ven2", "P1", "5", "1", "ordered", "x"),
        ("V2", "1", "Ven2", "P1", "6", "1", "ordered", "x"),
        ("V3", "1", "Ven2", "P1", "9999999999.00", "2", "ordered", "x"),
        ("V4", "1", "Ven2", "P1", "1", "2", "ordered", "x"),
    ]
    raw = spark.createDataFrame(lines, ingest.RAW_COLUMNS["parts"])
    result = ingest.ingest_parts(raw)
    assert rows(result.rows["part"], "order_number") == [("V4-1",)]
    assert rows(result.rows["parts_order"], "order_number", "total_cost") == [("V4-1", money(2))]
    assert sorted((r.order_number, r.reasons[0]) for r in result.rejects.collect()) == [
        ("V1-1", "bad_number"), ("V1-1", "bad_number"), ("V2-1", "repeated_part_number"),
        ("V2-1", "repeated_part_number"), ("V3-1", "total_out_of_range"),
    ]


def test_customer_ids_do_not_depend_on_file_splits(spark, tmp_path):
    columns = ingest.RAW_COLUMNS["customers"]
    people = [["person", f"m{i}@x", *["1"] * 5, *[""] * 5, f"{i:09d}", f"F{i}", f"L{i}"] for i in range(900)]
    for part in range(3):
        _tsv(tmp_path / f"raw/{part}.tsv", columns, people[part * 300 : part * 300 + 300])
    key, old = "spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None)
    seen = []
    try:
        for splits, limit in (("1", "128m"), ("7", "4096")):
            spark.conf.set(key, splits)
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            done = ingest.ingest_customers(read_raw(spark, str(tmp_path / "raw"), "customers")).rows
            both = done["customer"].join(done["individual_customer"], "customer_id")
            seen.append({(r.customer_id, r.email, r.last_name) for r in both.collect()})
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert seen[0] == seen[1] and len(seen[0]) == 900
    assert all(email[1:-2] == last[1:] for _, email, last in seen[0])


def test_cells_as_the_csv_module_reads_them(spark, tmp_path):
    text = 'vendor_name\tphone\tstreet\tcity\tstate\tpostal_code\n"Bob ""The"" Parts"\t1\t"a\nb"\tc\ts\t01\nshort\t1\n'
    path = tmp_path / "vendors.tsv"
    path.write_text(text)
    expected = [r for r in csv.reader(io.StringIO(text), delimiter="\t")][1:]
    read = read_raw(spark, str(path), "vendors", multi_line=True).collect()
    assert [list(r) for r in read] == [expected[0]]
    assert read_broken(spark, str(path), "vendors", multi_line=True).count() == 1


def test_store_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "store")
    t = lot(spark, vehicle=[{"vin": "A"}], purchase=[{"vin": "A"}])
    write_tables({name: t[name] for name in ("vehicle", "purchase", "color", "sale")}, folder)
    write_tables({"vehicle": lot(spark, vehicle=[{"vin": "B"}]).vehicle}, folder, mode="append")
    stored = read_tables(spark, folder)
    assert rows(stored.vehicle, "vin") == [("A",), ("B",)]
    assert rows(stored.purchase) == rows(t.purchase) and stored.sale.count() == 0
    assert stored.color.count() == 26
    write_tables({"vehicle": t.vehicle}, folder)
    assert rows(read_tables(spark, folder).vehicle, "vin") == [("A",)]
    with pytest.raises(ValueError):
        write_tables({}, folder, mode="merge")


def test_tables_bundle(spark):
    t = empty_tables(spark)
    assert (t.color.count(), t.vehicle_type.count(), t.manufacturer.count()) == (26, 9, 48)
    assert rows(t.manufacturer) == rows(seed_rows(spark, "manufacturer"))
    with pytest.raises(AttributeError):
        t.boat
    with pytest.raises(TypeError):
        t.with_tables(boat=t.color)
