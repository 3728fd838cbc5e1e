"""A dealership derived from the order/lineitem style test tables (mapping: FIXTURES.md, section 3).

Every order is a vehicle we bought, every line item a part ordered for it, every supplier a parts vendor,
every nation a member of staff.  All rows of the source tables are used.  Apart from the part lines, which
collapse exact copies, each table is a row-by-row projection: no shuffle, and filters reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from forecourt import schema
from forecourt.tables import Tables, conform, seed_rows

MODEL_NAMES = ("Comet", "Ranger", "Vista", "Pioneer", "Breeze", "Summit", "Orbit", "Harbor", "Falcon", "Meadow")


class Source:
    """A folder of source tables; each is opened once per instance."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._opened: dict[str, DataFrame] = {}

    def read(self, table: str) -> DataFrame:
        if table not in self._opened:
            self._opened[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._opened[table]


# SQL expressions over the source columns.


def pick(values: Sequence[str], index: str) -> str:
    """The value at a zero-based index."""
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({index} + 1 AS int))"


def padded(number: str, width: int) -> str:
    return f"lpad(cast({number} AS string), {width}, '0')"


def vin_of(order_key: str) -> str:
    return f"concat('VIN', {padded(order_key, 14)})"


def vendor_of(supplier_key: str) -> str:
    return f"concat('Vendor ', {supplier_key})"


def username_of(nation_key: str) -> str:
    return f"concat('user', {nation_key})"


def ssn_of(customer_key: str) -> str:
    return padded(customer_key, 12)


def tax_id_of(customer_key: str) -> str:
    return f"concat({padded(f'({customer_key}) % 100', 2)}, '-', {padded(customer_key, 12)})"


def identifier_of(customer_key: str) -> str:
    return f"CASE WHEN ({customer_key}) % 5 = 0 THEN {tax_id_of(customer_key)} ELSE {ssn_of(customer_key)} END"


def columns(**expressions: str) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in expressions.items()]


VIN = vin_of("o_orderkey")
CLERK = username_of("o_orderkey % 9 * 3")
SALESPERSON = username_of("(o_orderkey % 8 * 3 + 1)")
BUYER = "(o_custkey ^ 1)"  # the neighbour of the seller
IS_SOLD = "o_orderstatus = 'F'"
COLOR_LIST = (
    "CASE WHEN o_orderkey % 11 <> 0 THEN transform(sequence(0, cast(o_orderkey % 3 AS int)), "
    f"k -> {pick(schema.COLORS, '(o_orderkey * 5 + k * 11) % 26')}) END"
)
PAID = "cast(o_totalprice AS decimal(12,2))"
BOUGHT_ON = "cast(o_orderdate AS date)"
SOLD_FOR = f"cast(round(1.25 * {PAID}, 2) AS decimal(12,2))"
SOLD_ON = f"date_add({BOUGHT_ON}, cast(o_orderkey % 90 AS int))"
MODEL = f"concat({pick(MODEL_NAMES, '(o_orderkey + o_custkey) % 10')}, ' ', o_orderkey % 7 + 1)"
VEHICLE = columns(
    vin=VIN,
    vehicle_type=pick(schema.VEHICLE_TYPES, "o_orderkey % 9"),
    manufacturer_name=pick(schema.MANUFACTURERS, "(o_orderkey * 7 + o_custkey) % 48"),
    condition="CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Excellent' WHEN '2' THEN 'Very Good' "
    "WHEN '3' THEN 'Good' ELSE 'Fair' END",
    model_name=MODEL,
    year="cast(o_orderkey % 46 + 1980 AS int)",
    fuel_type=pick(schema.FUEL_TYPES, "(o_orderkey + o_custkey) % 7"),
    horsepower="cast(o_orderkey % 440 + 60 AS int)",
    description=f"CASE WHEN o_orderkey % 5 <> 0 THEN concat(lower(o_orderpriority), ' trade-in, ', {MODEL}) END",
)


def vehicles(source: Source) -> DataFrame:
    return source.read("orders").selectExpr(*VEHICLE)


def vehicle_colors(source: Source) -> DataFrame:
    return source.read("orders").selectExpr(*columns(vin=VIN, color_name=f"explode({COLOR_LIST})"))


def purchases(source: Source) -> DataFrame:
    return source.read("orders").selectExpr(
        *columns(vin=VIN, customer_id="o_custkey", username=CLERK, purchase_price=PAID, purchased_on=BOUGHT_ON)
    )


def sales(source: Source) -> DataFrame:
    rows = source.read("orders").where(IS_SOLD)
    return rows.selectExpr(
        *columns(vin=VIN, customer_id=BUYER, username=SALESPERSON, sale_price=SOLD_FOR, sold_on=SOLD_ON)
    )


LINE_KEYS = ("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
CENTS = "cast(cast(floor({price} / 16) AS decimal(12,0)) / 100 AS decimal(12,2))"
ORDER_NUMBER = f"concat({vin_of('l_orderkey')}, '-', {padded('l_suppkey', 12)})"


def _merged_lines(source: Source) -> DataFrame:
    """Line items with exact key copies collapsed (combined before the shuffle, which carries numbers only)."""
    rank = "CASE WHEN l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END"
    lines = source.read("lineitem").selectExpr(*LINE_KEYS, "l_quantity AS q", "l_extendedprice AS price", f"{rank} AS r")
    merged = lines.groupBy(*LINE_KEYS).agg({"q": "max", "price": "max", "r": "max"})
    return merged.selectExpr(
        *LINE_KEYS,
        "cast(floor(`max(q)` / 40) AS int) + 1 AS quantity",
        f"{CENTS.format(price='`max(price)`')} AS unit_price",
        "`max(r)` AS rank",
    )


def part_lines(source: Source) -> DataFrame:
    number = "concat('P', l_partkey, '-', l_linenumber)"
    return _merged_lines(source).selectExpr(
        *LINE_KEYS,
        *columns(
            vin=vin_of("l_orderkey"),
            vendor_name=vendor_of("l_suppkey"),
            order_num=padded("l_suppkey", 12),
            order_number=ORDER_NUMBER,
            vendor_parts_number=number,
            description=f"concat('Part ', {number})",
            quantity="quantity",
            unit_price="unit_price",
            status=pick(schema.PART_STATUSES, "rank - 1"),
        ),
    )


def parts_orders(source: Source) -> DataFrame:
    lines = _merged_lines(source).selectExpr("l_orderkey", "l_suppkey", "quantity * unit_price AS cost")
    return (
        lines.groupBy("l_orderkey", "l_suppkey")
        .sum("cost")
        .selectExpr(
            *columns(
                vin=vin_of("l_orderkey"),
                vendor_name=vendor_of("l_suppkey"),
                order_number=ORDER_NUMBER,
                total_cost="`sum(cost)`",
            )
        )
    )


def customers(source: Source) -> DataFrame:
    """Customer keys with contact columns and both kinds' columns, one row per source row."""
    return source.read("customer").selectExpr(
        *columns(
            customer_id="c_custkey",
            email="CASE WHEN c_custkey % 10 <> 0 THEN concat('c', c_custkey, '@example.com') END",
            phone_number=padded("c_custkey", 10),
            street="concat(c_custkey, ' Main Street')",
            city="concat('City ', c_nationkey)",
            state="concat('State ', c_nationkey % 5)",
            postal_code=padded("c_custkey", 12),
            is_business="c_custkey % 5 = 0",
            first_name="concat('First', c_custkey % 50)",
            last_name="c_name",
            social_security_number=ssn_of("c_custkey"),
            business_name="concat('Company ', c_custkey)",
            tax_identification_number=tax_id_of("c_custkey"),
            contact_first_name="'Pat'",
            contact_last_name="c_name",
            contact_title="'Manager'",
            nation_key="c_nationkey",
        )
    )


def vendors(source: Source) -> DataFrame:
    return source.read("supplier").selectExpr(
        *columns(
            supplier_key="s_suppkey",
            name=vendor_of("s_suppkey"),
            phone_number=padded("s_suppkey", 10),
            street="concat(s_suppkey, ' Market Street')",
            city="concat('City ', s_nationkey)",
            state="concat('State ', s_nationkey % 5)",
            postal_code=padded("s_suppkey", 12),
        )
    )


def users(source: Source) -> DataFrame:
    role = (
        "CASE WHEN n_nationkey = 0 THEN 'Owner' WHEN n_nationkey % 3 = 0 THEN 'Inventory clerk' "
        "WHEN n_nationkey % 3 = 1 THEN 'Salesperson' ELSE 'Manager' END"
    )
    return source.read("nation").selectExpr(
        *columns(
            username=username_of("n_nationkey"),
            first_name="n_name",
            last_name="concat('Region ', n_regionkey)",
            role=role,
            line_no="n_nationkey",
        )
    )


def dealership(source: Source) -> Tables:
    """All fourteen tables; each is planned when an operator first asks for it."""
    builders = {
        "vehicle": vehicles,
        "vehicle_color": vehicle_colors,
        "vendor": vendors,
        "parts_order": parts_orders,
        "part": part_lines,
        "customer": customers,
        "individual_customer": lambda s: customers(s).where("NOT is_business"),
        "business_customer": lambda s: customers(s).where("is_business"),
        "user": users,
        "purchase": purchases,
        "sale": sales,
    }
    frames = {name: partial(_built, source, name, build) for name, build in builders.items()}
    seeds = {name: partial(seed_rows, source.spark, name) for name in ("color", "vehicle_type", "manufacturer")}
    return Tables(**seeds, **frames)


# A second dealership with several deals per vehicle.  Multiples of 6 were bought twice, multiples of 12 have the first
# purchase once more; multiples of 4 were sold twice, multiples of 8 have the first sale once more.  A thirteenth of the
# vehicles was never purchased, one vehicle type never sold, and some customers are neither a person nor a firm.

HAS_PURCHASE = "o_orderkey % 13 <> 5"
HAS_SALE = f"{IS_SOLD} AND o_orderkey % 9 <> 4"
HAS_KIND = "customer_id % 29 <> 3"


def _repeated(rows: DataFrame, twice: str, thrice: str) -> DataFrame:
    """Rows with a column `deal`: 0, then 1 where `twice`, then 2 where `thrice`."""
    last = f"CASE WHEN {thrice} THEN 2 WHEN {twice} THEN 1 ELSE 0 END"
    return rows.selectExpr("*", f"explode(sequence(0, {last})) AS deal")


def several_purchases(source: Source) -> DataFrame:
    rows = _repeated(source.read("orders").where(HAS_PURCHASE), "o_orderkey % 6 = 0", "o_orderkey % 12 = 0")
    return rows.selectExpr(
        *columns(
            vin=VIN,
            customer_id=f"if(deal = 1, {BUYER}, o_custkey)",
            username=CLERK,
            purchase_price=f"if(deal = 1, cast(round(0.8 * {PAID}, 2) AS decimal(12,2)), {PAID})",
            purchased_on=f"if(deal = 1, date_add({BOUGHT_ON}, 20), {BOUGHT_ON})",
        )
    )


def several_sales(source: Source) -> DataFrame:
    rows = _repeated(source.read("orders").where(HAS_SALE), "o_orderkey % 4 = 0", "o_orderkey % 8 = 0")
    return rows.selectExpr(
        *columns(
            vin=VIN,
            customer_id=f"if(deal = 1, o_custkey, {BUYER})",
            username=f"if(deal = 1, {username_of('((o_orderkey + 1) % 8 * 3 + 1)')}, {SALESPERSON})",
            sale_price=f"if(deal = 1, cast(round(1.1 * {PAID}, 2) AS decimal(12,2)), {SOLD_FOR})",
            sold_on=f"if(deal = 1, date_add({SOLD_ON}, 45), {SOLD_ON})",
        )
    )


def several_deals(source: Source) -> Tables:
    builders = {
        "purchase": several_purchases,
        "sale": several_sales,
        "individual_customer": lambda s: customers(s).where(f"NOT is_business AND {HAS_KIND}"),
        "business_customer": lambda s: customers(s).where(f"is_business AND {HAS_KIND}"),
    }
    frames = {name: partial(_built, source, name, build) for name, build in builders.items()}
    return dealership(source).with_tables(**frames)


# Faults, one for every declared key and reference: the rows entered twice, and the rows whose reference is lost.

ROWS_TWICE = {
    "color": "color_name = 'Red'",
    "vehicle_type": "vehicle_type = 'SUV'",
    "manufacturer": "manufacturer_name = 'Kia'",
    "vehicle": "year = 1999",
    "vehicle_color": "color_name = 'Red'",
    "vendor": "state = 'State 1'",
    "parts_order": "vendor_name LIKE '%7'",
    "part": "status = 'Received'",
    "customer": "state = 'State 2'",
    "individual_customer": "first_name = 'First7'",
    "business_customer": "business_name LIKE '%5'",
    "user": "role = 'Manager'",
    "purchase": "username = 'user3'",
    "sale": "username = 'user4'",
}
LOST_REFERENCES = {
    ("vehicle", "vehicle_type"): "year = 2001",
    ("vehicle", "manufacturer_name"): "year = 2002",
    ("vehicle_color", "color_name"): "color_name = 'Red'",
    ("vehicle_color", "vin"): "color_name = 'Blue'",
    ("parts_order", "vin"): "vendor_name LIKE '%7'",
    ("parts_order", "vendor_name"): "vendor_name LIKE '%8'",
    ("part", "order_number"): "status = 'Received'",
    ("individual_customer", "customer_id"): "first_name = 'First7'",
    ("business_customer", "customer_id"): "business_name LIKE '%5'",
    ("purchase", "vin"): "username = 'user3'",
    ("purchase", "customer_id"): "username = 'user6'",
    ("purchase", "username"): "username = 'user9'",
    ("sale", "vin"): "username = 'user4'",
    ("sale", "customer_id"): "username = 'user7'",
    ("sale", "username"): "username = 'user10'",
}


def with_rows_twice(tables: Tables) -> Tables:
    return tables.with_tables(
        **{name: tables[name].unionByName(tables[name].where(some)) for name, some in ROWS_TWICE.items()}
    )


def with_lost_references(tables: Tables) -> Tables:
    changed = {}
    for table in {table for table, _ in LOST_REFERENCES}:
        frame, values = tables[table], {}
        for column in frame.columns:
            some = LOST_REFERENCES.get((table, column))
            lost = f"-{column} - 1" if column == "customer_id" else f"concat({column}, '-lost')"
            values[column] = f"CASE WHEN {some} THEN {lost} ELSE {column} END" if some else column
        changed[table] = frame.selectExpr(*columns(**values))
    return tables.with_tables(**changed)


# Keys in other spellings: capitals, small letters and accents.

SPELLINGS = {
    ("vehicle", "manufacturer_name"): "CASE year % 3 WHEN 0 THEN upper({c}) WHEN 1 THEN translate({c}, 'aeou', 'áèöû') ELSE {c} END",
    ("vehicle", "vehicle_type"): "if(horsepower % 2 = 0, lower({c}), {c})",
    ("vehicle_color", "color_name"): "if(vin LIKE '%7', translate({c}, 'aei', 'ãêï'), {c})",
    ("parts_order", "vendor_name"): "if(vin LIKE '%3', upper({c}), {c})",
    ("part", "order_number"): "if(status = 'Received', lower({c}), {c})",
    ("purchase", "username"): "if(vin LIKE '%5', upper({c}), {c})",
    ("sale", "username"): "if(vin LIKE '%1', translate({c}, 'u', 'ú'), {c})",
    ("sale", "vin"): "if(username = 'user4', lower({c}), {c})",
}


def with_other_spellings(tables: Tables) -> Tables:
    changed = {}
    for table in {table for table, _ in SPELLINGS}:
        frame = tables[table]
        spelled = {c: SPELLINGS.get((table, c), "{c}").format(c=c) for c in frame.columns}
        changed[table] = frame.selectExpr(*columns(**spelled))
    return tables.with_tables(**changed)


def _built(source: Source, name: str, build: Callable[[Source], DataFrame]) -> DataFrame:
    return conform(build(source), name)


# Raw files: the wide text rows the ingest operators read.


def _as_text(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[c if c == "line_no" else f"cast({c} AS string) AS {c}" for c in df.columns])


def raw_customers(source: Source) -> DataFrame:
    firm = {
        "biz_tax_id": "tax_identification_number",
        "biz_name": "business_name",
        "biz_contact_first": "contact_first_name",
        "biz_contact_last": "contact_last_name",
        "biz_contact_title": "contact_title",
    }
    person = {"person_ssn": "social_security_number", "person_first": "first_name", "person_last": "last_name"}
    return customers(source).selectExpr(
        "if(is_business, 'business', 'person') AS customer_type",
        "email", "phone_number AS phone", "street", "city", "state", "postal_code AS postal",
        *columns(**{name: f"if(is_business, {c}, NULL)" for name, c in firm.items()}),
        *columns(**{name: f"if(is_business, NULL, {c})" for name, c in person.items()}),
        "customer_id AS line_no",
    )


def raw_users(source: Source) -> DataFrame:
    return users(source).selectExpr(
        "if(role = 'Owner', 'owner', username) AS username",
        "'secret' AS password",
        "first_name",
        "last_name",
        "if(role = 'Owner', 'inventory clerk,salesperson,manager', lower(role)) AS role",
        "line_no",
    )


def raw_vendors(source: Source) -> DataFrame:
    return vendors(source).selectExpr(
        "name AS vendor_name", "phone_number AS phone", "street", "city", "state", "postal_code", "supplier_key AS line_no"
    )


def raw_vehicles(source: Source) -> DataFrame:
    """Every order as a wide vehicle row; every 97th names a seller nobody knows."""
    rows = source.read("orders").selectExpr(
        *VEHICLE,
        *columns(
            purchase_clerk=CLERK,
            purchased_from_customer=f"CASE WHEN o_orderkey % 97 = 0 THEN 'nobody' ELSE {identifier_of('o_custkey')} END",
            price=PAID,
            purchase_date=BOUGHT_ON,
            colors=f"coalesce(array_join({COLOR_LIST}, ', '), '')",
            sale_date=f"CASE WHEN {IS_SOLD} THEN {SOLD_ON} END",
            sold_to_customer=f"CASE WHEN {IS_SOLD} THEN {identifier_of(BUYER)} END",
            salesperson=f"CASE WHEN {IS_SOLD} THEN {SALESPERSON} END",
            line_no="o_orderkey",
        ),
    )
    return _as_text(rows.withColumnRenamed("vin", "VIN"))


# Raw rows with faults.  A row that comes again has a line number above all others; only the first is to be loaded.
AGAIN = 1_000_000_000_000


def _with_repeats(rows: DataFrame, again: str, **changed: str) -> DataFrame:
    """`rows` and, after them, those where `again` holds once more, with some columns changed."""
    later = {**{c: c for c in rows.columns}, **changed, "line_no": f"line_no + {AGAIN}"}
    return rows.unionByName(rows.where(again).selectExpr(*columns(**later)))


def faulty_raw_customers(source: Source) -> DataFrame:
    """Every seventh customer comes again by another street; some persons have no SSN and some firms no tax id."""
    changed = {
        "person_ssn": "CASE WHEN line_no % 41 <> 2 THEN person_ssn END",
        "biz_tax_id": "if(line_no % 35 = 5, ' ', biz_tax_id)",
    }
    rows = raw_customers(source)
    blanked = rows.selectExpr(*columns(**{c: changed.get(c, c) for c in rows.columns}))
    return _with_repeats(blanked, "line_no % 7 = 0", street="'elsewhere'")


def faulty_raw_users(source: Source) -> DataFrame:
    return _with_repeats(raw_users(source), "line_no % 4 = 1", first_name="'Twin'")


def faulty_raw_vendors(source: Source) -> DataFrame:
    raw = raw_vendors(source)
    rows = raw.selectExpr(*columns(**{c: "if(line_no % 9 = 4, '', vendor_name)" if c == "vendor_name" else c for c in raw.columns}))
    return _with_repeats(rows, "line_no % 3 = 0 OR line_no % 9 = 4", city="'Other city'")


def faulty_raw_vehicles(source: Source) -> DataFrame:
    """Unknown clerks, makers, types and salespersons, VINs that come again, and among these some whose first row is broken."""
    rows = raw_vehicles(source)
    changed = {
        "purchase_clerk": "if(line_no % 37 = 1, 'ghost', purchase_clerk)",
        "manufacturer_name": "if(line_no % 41 = 2, 'Nobody', manufacturer_name)",
        "vehicle_type": "if(line_no % 43 = 3, 'Hovercraft', vehicle_type)",
        "salesperson": "if(line_no % 47 = 4, 'ghost', salesperson)",
    }
    broken = rows.selectExpr(*columns(**{c: changed.get(c, c) for c in rows.columns}))
    mended = {"purchase_clerk": "'user3'", "manufacturer_name": "'Kia'", "vehicle_type": "'SUV'", "description": "'again'"}
    return _with_repeats(broken, "line_no % 5 = 0", **mended, salesperson="if(sale_date IS NULL, NULL, 'user4')")


def faulty_raw_parts(source: Source) -> DataFrame:
    """Prices that are no number, and part numbers that come again in their order."""
    rows = raw_parts(source)
    changed = {"price": "if(part_number LIKE '%77-%', 'free', price)"}
    broken = rows.selectExpr(*columns(**{c: changed.get(c, c) for c in rows.columns}))
    return _with_repeats(broken, "part_number LIKE '%5-1'", qty="'1'")


def raw_parts(source: Source) -> DataFrame:
    return _as_text(
        part_lines(source).selectExpr(
            "vin AS VIN", "order_num", "vendor_name", "vendor_parts_number AS part_number", "unit_price AS price",
            "quantity AS qty", "lower(status) AS status", "description", "cast(l_linenumber AS bigint) AS line_no",
        )
    )


# Batches of submissions for the write operators.


def vehicle_submissions(source: Source) -> DataFrame:
    """Every catalogue part offered as a vehicle; sizes divisible by ten have no horsepower."""
    return source.read("part").selectExpr(
        *columns(
            submission_id="p_partkey",
            vin=f"concat('NEW', {padded('p_partkey', 14)})",
            vehicle_type=pick(schema.VEHICLE_TYPES, "p_partkey % 9"),
            manufacturer_name=pick(schema.MANUFACTURERS, "p_partkey % 48"),
            condition=pick(schema.CONDITIONS, "p_partkey % 4"),
            model_name="p_name",
            year="cast(p_partkey % 50 + 1978 AS int)",
            fuel_type=pick(schema.FUEL_TYPES, "p_partkey % 7"),
            horsepower="cast(p_size % 10 AS int)",
            description="concat(p_brand, ' ', p_type)",
            colors=f"array({pick(schema.COLORS, 'p_partkey % 26')}, "
            f"{pick((*schema.COLORS, 'Plaid'), '(p_partkey + 1) % 27')})",
            username=username_of("p_partkey % 9 * 3"),
            seller_identifier=identifier_of("p_partkey % 160"),
            purchase_price="cast(p_retailprice AS decimal(12,2))",
            purchased_on="date'2024-05-01'",
        )
    )


def customer_submissions(source: Source) -> DataFrame:
    """Every customer again: those with nation key below 5 unchanged (identifier exists), the others as new people."""
    fresh = "if(nation_key >= 5, 'N', '')"
    return customers(source).selectExpr(
        "customer_id AS submission_id",
        "if(is_business, 'Business', 'Individual') AS customer_type",
        "email", "phone_number", "street", "city", "state", "postal_code", "first_name", "last_name",
        f"concat({fresh}, social_security_number) AS social_security_number",
        "business_name",
        f"concat({fresh}, tax_identification_number) AS tax_identification_number",
        "contact_first_name", "contact_last_name", "contact_title",
    )


def vendor_submissions(source: Source) -> DataFrame:
    """Every supplier: even keys repeat an existing name, odd keys are new; every third lacks a phone."""
    return vendors(source).selectExpr(
        "supplier_key AS submission_id",
        "if(supplier_key % 2 = 1, concat(name, '-B '), name) AS name",
        "if(supplier_key % 3 = 0, '  ', phone_number) AS phone_number",
        "street", "city", "state", "postal_code",
    )


def parts_order_submissions(source: Source) -> DataFrame:
    """One order of two parts per (order, line number) of all line items; sold vehicles will be refused."""
    return source.spark.sql(
        f"""
        SELECT k * 8 + n AS submission_id, {vin_of("k")} AS vin, {vendor_of("s")} AS vendor_name,
               array(
                   named_struct('part_description', concat('Part A', p), 'vendor_part_number', concat('A', p),
                                'unit_price', low, 'quantity', lines, 'part_status', 'Ordered'),
                   named_struct('part_description', concat('Part B', p), 'vendor_part_number', concat('B', p),
                                'unit_price', high, 'quantity', 1, 'part_status', 'Received')) AS parts
        FROM (
            SELECT l_orderkey AS k, cast(l_linenumber AS bigint) AS n, min(l_suppkey) AS s, min(l_partkey) AS p,
                   cast(count(*) AS int) AS lines, {CENTS.format(price="min(l_extendedprice)")} AS low,
                   {CENTS.format(price="max(l_extendedprice)")} AS high
            FROM {{lineitem}}
            GROUP BY l_orderkey, l_linenumber)
        """,
        lineitem=source.read("lineitem"),
    )


def faulty_parts_orders(source: Source) -> DataFrame:
    """The same orders; by the remainder of their id, ten of eleven break a rule each."""
    part_b = "parts[1]"
    first = {
        5: "'part_description', ' '",
        6: "'unit_price', cast(0 AS decimal(12,2))",
        7: "'quantity', 0",
        8: "'part_status', 'Lost'",
        9: "'vendor_part_number', parts[1].vendor_part_number",
    }
    names = ("part_description", "vendor_part_number", "unit_price", "quantity", "part_status")

    def part_a(change: str) -> str:
        changed, value = change.split(", ", 1)
        fields = [f"'{n}', {value if changed == repr(n) else f'parts[0].{n}'}" for n in names]
        return f"array(named_struct({', '.join(fields)}), {part_b})"

    faults = " ".join(f"WHEN {n} THEN {part_a(change)}" for n, change in first.items())
    return parts_order_submissions(source).selectExpr(
        "submission_id",
        "CASE submission_id % 11 WHEN 1 THEN ' ' WHEN 3 THEN concat(vin, 'X') ELSE vin END AS vin",
        "if(submission_id % 11 = 2, NULL, vendor_name) AS vendor_name",
        f"CASE submission_id % 11 WHEN 4 THEN slice(parts, 1, 0) WHEN 10 THEN array_repeat(parts[0], 101) {faults} "
        "ELSE parts END AS parts",
    )


def status_updates(source: Source) -> DataFrame:
    """Two updates for every part line; those with part key divisible by 50 name an order that does not exist."""
    twice = part_lines(source).selectExpr("*", "explode(array(1, 2)) AS seq")
    return twice.selectExpr(
        *columns(
            order_number="concat(order_number, if(l_partkey % 50 = 0, '-X', ''))",
            vendor_parts_number="vendor_parts_number",
            new_status=pick(("Installed", "Received", "Ordered"), "(l_partkey + l_linenumber * seq) % 3"),
            seq="seq",
        )
    )


def sale_submissions(source: Source) -> DataFrame:
    """Every order offered for sale to the seller's neighbour; vehicles already sold will be refused."""
    return source.read("orders").selectExpr(
        *columns(
            submission_id="o_orderkey",
            vin=VIN,
            buyer_identifier=f"CASE WHEN o_orderkey % 89 = 0 THEN 'nobody' ELSE {identifier_of(BUYER)} END",
            username=SALESPERSON,
            sold_on=f"date_add({BOUGHT_ON}, 30)",
        )
    )
