"""Stored layouts: touched partitions, blocks of the keyword search, clustered files, published snapshots, shared folders."""

import os

import pytest
from lot import DAY, frame, lot, money, new_shuffle_files, rows, shuffle_files
from pyspark.sql import functions as F

from forecourt import schema
from forecourt.functions import lineage
from forecourt.operators import batches, vehicles
from forecourt.plans import dealership_view as view
from forecourt.sources import partitioned, publishing, trigrams
from forecourt.sources.files import read_tables, write_clustered
from forecourt.tables import empty_tables


@pytest.fixture(scope="module")
def tables(spark, testdata):
    return view.dealership(view.Source(spark, testdata))


def _files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def _scan(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "FileScan parquet" in line)


PARTITIONS = 32


@pytest.fixture
def stored_parts(tables, tmp_path):
    folder = str(tmp_path / "part")
    partitioned.write_parts(tables.part, folder, PARTITIONS)
    return folder


def _updates(spark, tables, n):
    orders = [r[0] for r in tables.part.select("order_number").distinct().orderBy("order_number").limit(n).collect()]
    lines = tables.part.where(F.col("order_number").isin(orders)).select("order_number", "vendor_parts_number").collect()
    found = [(r[0], r[1], s, i) for r in lines for i, s in enumerate(("Received", "Installed", "Ordered"))]
    return spark.createDataFrame(found + [("nobody's", "P", "Installed", 1), (None, "P", "Installed", 1)], "order_number string, vendor_parts_number string, new_status string, seq int")


@pytest.mark.parametrize("store, apply", [
    (partitioned.store_status_updates, batches.apply_status_updates),
    (partitioned.store_status_transitions, batches.apply_status_transitions),
])
def test_a_status_batch_replaces_only_what_it_touches(spark, tables, stored_parts, store, apply):
    updates = _updates(spark, tables, 3)
    before = _files(stored_parts)
    numbers = store(tables, updates, stored_parts, PARTITIONS)
    after = _files(stored_parts)
    touched = {f"{partitioned.PARTITION}={n}" for n in numbers}
    assert 1 <= len(numbers) <= 4
    changed = {os.path.basename(os.path.dirname(p)) for p in before.keys() ^ after.keys()}
    assert changed <= touched and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert rows(partitioned.read_parts(spark, stored_parts)) == rows(apply(tables, updates))
    # Run again, as after a failure, the batch changes nothing.
    store(tables, updates, stored_parts, PARTITIONS)
    assert rows(partitioned.read_parts(spark, stored_parts)) == rows(apply(tables, updates))


def test_a_status_batch_reads_only_its_partitions(spark, tables, stored_parts):
    numbers = partitioned.touched_partitions(_updates(spark, tables, 2), PARTITIONS)
    scan = _scan(partitioned.read_parts(spark, stored_parts, numbers))
    assert "PartitionFilters: [" in scan and partitioned.PARTITION in scan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("store", [partitioned.store_status_updates, partitioned.store_status_transitions])
def test_a_status_batch_leaves_no_files_behind(spark, tables, testdata, tmp_path, store):
    before, shared = shuffle_files(spark), set(os.listdir(lineage.shared_folder(spark)))
    partitioned.write_parts(tables.part, str(tmp_path / "part"), PARTITIONS)
    store(tables, view.status_updates(view.Source(spark, testdata)), str(tmp_path / "part"), PARTITIONS)
    assert not new_shuffle_files(spark, before)
    assert set(os.listdir(lineage.shared_folder(spark))) == shared


def test_facts_meet_parts_in_their_partition(spark):
    keys = [("A-1", "P"), ("A-1", "P"), ("A-1", "Q"), ("B-1", "P"), (None, "P"), ("C-1", None)]
    parts = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "order_number string, vendor_parts_number string, n int")
    facts = [("A-1", "P", "x", 1), ("B-1", "P", None, 2), ("Z", "P", "y", 3), (None, "P", "z", 4), ("C-1", None, "z", 5)]
    facts = spark.createDataFrame(facts, "order_number string, vendor_parts_number string, a string, b int")
    met = partitioned._beside(parts, facts, 4)
    assert rows(met.drop("_is_part", partitioned.PARTITION)) == rows(parts.join(facts, batches.PART_KEY, "left"))
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_new_parts_are_appended(spark, tables, stored_parts):
    new = frame(spark, "part", [{"order_number": "N-001"}, {"order_number": "N-002"}])
    partitioned.append_parts(new, stored_parts, PARTITIONS)
    assert rows(partitioned.read_parts(spark, stored_parts)) == rows(tables.part.unionByName(new))
    with pytest.raises(Exception, match="exist"):
        partitioned.write_parts(tables.part, stored_parts, PARTITIONS)


def test_an_empty_status_batch_touches_nothing(spark, tables, stored_parts):
    before = _files(stored_parts)
    assert partitioned.store_status_updates(tables, _updates(spark, tables, 1).where("false"), stored_parts, PARTITIONS) == []
    assert _files(stored_parts) == before


KEYWORDS = ["harbor 3", "5-low%summit", "HARBOR", "Kia", "199", "zzz nothing", "a_b", "\\%", "ra", "%", "trade-in, comet"]


@pytest.fixture(scope="module")
def searchable(tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("searchable"))
    trigrams.write_searchable(tables.vehicle, folder, 24)
    return folder


@pytest.mark.parametrize("keyword", KEYWORDS)
def test_blocks_lose_no_hit(spark, tables, searchable, keyword):
    found = trigrams.candidates(spark, searchable, keyword)
    wanted = vehicles.matching_vehicles(tables, keyword=keyword)
    assert rows(vehicles.matching_vehicles(tables.with_tables(vehicle=found), keyword=keyword)) == rows(wanted)


def test_a_selective_keyword_opens_few_blocks(spark, searchable):
    assert trigrams.candidate_blocks(spark, searchable, "zzz nothing") == []
    assert len(trigrams.candidate_blocks(spark, searchable, "Kia")) <= 4
    assert trigrams.candidate_blocks(spark, searchable, "ra") is None
    assert trigrams.literal_pieces("5-low%sum_mit") == ["5-low", "sum", "mit"]
    assert "PartitionFilters: [" in _scan(trigrams.candidates(spark, searchable, "Kia"))


def _rows_read(df) -> int:
    """Rows that the scans gave, after row groups were left out."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    plan, total = [execution.executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            plan.append(node.executedPlan())
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_lookups_read_few_row_groups(spark, tables, tmp_path):
    write_clustered({n: tables[n] for n in ("vehicle", "parts_order", "sale", "color")}, str(tmp_path), files=8)
    stored = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("vehicle", "parts_order", "sale", "color")}
    assert all(rows(stored[n].select(*tables[n].columns)) == rows(tables[n]) for n in stored)
    vin = rows(tables.vehicle, "vin")[700][0]
    assert _rows_read(stored["vehicle"].where(F.col("vin") == vin)) <= tables.vehicle.count() / 4
    order = rows(tables.parts_order, "order_number")[900][0]
    assert _rows_read(stored["parts_order"].where(F.col("order_number") == order)) <= tables.parts_order.count() / 4
    # The customer of a sale is in no order; the Bloom filters of all files but one or two say no.
    lone = stored["sale"].groupBy("customer_id").count().where("count = 1").first()["customer_id"]
    assert _rows_read(stored["sale"].where(F.col("customer_id") == lone)) <= tables.sale.count() / 2


@pytest.fixture
def database(spark, tmp_path):
    name = f"shop_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def _shop(spark, **more):
    base = {
        "vehicle": [{"vin": "V1"}], "customer": [{"customer_id": 1}], "user": [{"username": "u"}], "purchase": [{"vin": "V1"}],
    }
    return lot(spark, **(base | more))


def test_a_batch_is_published_once_and_whole(spark, database, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        publishing.read_published(spark, database)
    assert publishing.publish(_shop(spark), database, str(tmp_path / "s"), "b1")
    now = publishing.read_published(spark, database)
    sale = frame(spark, "sale", [{"vin": "V1"}])
    assert publishing.publish(now.appended(sale=sale), database, str(tmp_path / "s"), "b2")
    again = publishing.read_published(spark, database)
    assert not publishing.publish(again.appended(sale=sale), database, str(tmp_path / "s"), "b2")
    assert publishing.read_published(spark, database).sale.count() == 1
    assert now.sale.count() == 0


def test_a_refused_batch_leaves_no_row(spark, database, tmp_path):
    publishing.publish(_shop(spark), database, str(tmp_path / "s"), "b1")
    now = publishing.read_published(spark, database)
    bad = frame(spark, "sale", [{"vin": "V1"}, {"vin": "V1"}, {"vin": "V2"}])
    with pytest.raises(publishing.RefusedSnapshot) as refused:
        publishing.publish(now.appended(sale=bad), database, str(tmp_path / "s"), "b2")
    assert set(refused.value.findings) == {"primary_keys", "foreign_keys"}
    assert publishing.read_published(spark, database).sale.count() == 0 and os.listdir(tmp_path / "s") == ["b1"]
    good = frame(spark, "sale", [{"vin": "V1", "sold_on": DAY, "sale_price": money(5)}])
    assert publishing.publish(now.appended(sale=good), database, str(tmp_path / "s"), "b2")
    assert publishing.read_published(spark, database).sale.count() == 1


def test_storage_must_be_shared():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            values = {"spark.sql.warehouse.dir": "file:/var/warehouse"}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        lineage.shared_folder(Session)
    Session.conf.values["spark.sql.warehouse.dir"] = "s3a://lake/warehouse"
    assert lineage.shared_folder(Session) == "s3a://lake/warehouse/pinned"
    Session.conf.values["spark.checkpoint.dir"] = "hdfs://x/c"
    assert lineage.shared_folder(Session) == "hdfs://x/c"


def test_every_table_has_its_schema_still(spark, stored_parts):
    partitioned.read_parts(spark, stored_parts, [1])
    assert [f.name for f in schema.SCHEMAS["part"]] == empty_tables(spark).part.columns
    assert read_tables  # the reader of published snapshots
