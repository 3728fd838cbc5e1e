"""The same answers as the registered queries, as SQL for another engine over the same Parquet tables.

Written by hand and apart from the operators.  `MODEL` derives the dealership from the source tables
(FIXTURES.md, section 3); every query is `MODEL` plus its own text.  Row order is never compared.
"""

from __future__ import annotations

from forecourt import schema
from forecourt.plans.dealership_view import MODEL_NAMES


def _pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} AS INTEGER) + 1]"


def _customer_key_to_identifier(key: str) -> str:
    padded = f"lpad(CAST({key} AS VARCHAR), 12, '0')"
    return (
        f"CASE WHEN ({key}) % 5 = 0 THEN lpad(CAST(({key}) % 100 AS VARCHAR), 2, '0') || '-' || {padded} "
        f"ELSE {padded} END"
    )


MODEL = f"""
WITH o AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus = 'F' AS is_sold, o_orderpriority AS priority,
           'VIN' || lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS vin,
           CAST(o_totalprice AS DECIMAL(12,2)) AS paid, CAST(o_orderdate AS DATE) AS bought,
           xor(o_custkey, 1) AS buyer,
           {_pick(MODEL_NAMES, "(o_orderkey + o_custkey) % 10")} || ' ' || CAST(o_orderkey % 7 + 1 AS VARCHAR) AS model
    FROM orders),
d_vehicle AS (
    SELECT vin,
           {_pick(schema.VEHICLE_TYPES, "k % 9")} AS vehicle_type,
           {_pick(schema.MANUFACTURERS, "(k * 7 + c) % 48")} AS manufacturer_name,
           CASE left(priority, 1) WHEN '1' THEN 'Excellent' WHEN '2' THEN 'Very Good' WHEN '3' THEN 'Good'
                ELSE 'Fair' END AS condition,
           model AS model_name, CAST(1980 + k % 46 AS INTEGER) AS year,
           {_pick(schema.FUEL_TYPES, "(k + c) % 7")} AS fuel_type,
           CAST(60 + k % 440 AS INTEGER) AS horsepower,
           CASE WHEN k % 5 <> 0 THEN lower(priority) || ' trade-in, ' || model END AS description
    FROM o),
d_color AS (
    SELECT vin, {_pick(schema.COLORS, "(k * 5 + i * 11) % 26")} AS color_name
    FROM o CROSS JOIN (VALUES (0), (1), (2)) AS steps(i)
    WHERE k % 11 <> 0 AND i <= k % 3),
d_purchase AS (
    SELECT vin, c AS customer_id, 'user' || CAST(k % 9 * 3 AS VARCHAR) AS username, paid AS purchase_price,
           bought AS purchased_on
    FROM o),
d_sale AS (
    SELECT vin, buyer AS customer_id, 'user' || CAST(k % 8 * 3 + 1 AS VARCHAR) AS username,
           CAST(round(1.25 * paid, 2) AS DECIMAL(12,2)) AS sale_price, bought + CAST(k % 90 AS INTEGER) AS sold_on
    FROM o WHERE is_sold),
lines AS (
    SELECT l_orderkey AS k, l_suppkey AS s, l_partkey AS p, l_linenumber AS n,
           max(CAST(floor(l_quantity / 40) AS INTEGER) + 1) AS quantity,
           CAST(max(floor(l_extendedprice / 16)) / 100 AS DECIMAL(12,2)) AS unit_price,
           ['Ordered', 'Received', 'Installed'][max(CASE WHEN l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'N' THEN 1
                                                         ELSE 2 END)] AS status
    FROM lineitem GROUP BY ALL),
d_part AS (
    SELECT *, 'VIN' || lpad(CAST(k AS VARCHAR), 14, '0') AS vin, 'Vendor ' || CAST(s AS VARCHAR) AS vendor_name,
           'VIN' || lpad(CAST(k AS VARCHAR), 14, '0') || '-' || lpad(CAST(s AS VARCHAR), 12, '0') AS order_number,
           'P' || CAST(p AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS vendor_parts_number,
           'Part P' || CAST(p AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS description
    FROM lines),
d_order AS (
    SELECT vin, vendor_name, order_number, CAST(sum(quantity * unit_price) AS DECIMAL(12,2)) AS total_cost
    FROM d_part GROUP BY ALL),
d_customer AS (
    SELECT c_custkey AS customer_id,
           CASE WHEN c_custkey % 10 <> 0 THEN 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
           lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone_number,
           CAST(c_custkey AS VARCHAR) || ' Main Street' AS street,
           'City ' || CAST(c_nationkey AS VARCHAR) AS city, 'State ' || CAST(c_nationkey % 5 AS VARCHAR) AS state,
           lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS postal_code, c_custkey % 5 = 0 AS is_business,
           'First' || CAST(c_custkey % 50 AS VARCHAR) AS first_name, c_name AS last_name,
           'Company ' || CAST(c_custkey AS VARCHAR) AS business_name, c_nationkey AS nation_key,
           {_customer_key_to_identifier("c_custkey")} AS identifier
    FROM customer),
d_vendor AS (
    SELECT s_suppkey AS supplier_key, 'Vendor ' || CAST(s_suppkey AS VARCHAR) AS name,
           lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS phone_number,
           CAST(s_suppkey AS VARCHAR) || ' Market Street' AS street,
           'City ' || CAST(s_nationkey AS VARCHAR) AS city, 'State ' || CAST(s_nationkey % 5 AS VARCHAR) AS state,
           lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS postal_code
    FROM supplier),
d_user AS (
    SELECT 'user' || CAST(n_nationkey AS VARCHAR) AS username, n_name AS first_name,
           'Region ' || CAST(n_regionkey AS VARCHAR) AS last_name,
           CASE WHEN n_nationkey = 0 THEN 'Owner' WHEN n_nationkey % 3 = 0 THEN 'Inventory clerk'
                WHEN n_nationkey % 3 = 1 THEN 'Salesperson' ELSE 'Manager' END AS role
    FROM nation),
pending AS (SELECT DISTINCT vin FROM d_part WHERE status <> 'Installed'),
spent AS (SELECT vin, CAST(sum(total_cost) AS DECIMAL(18,2)) AS cost FROM d_order GROUP BY vin),
shades AS (SELECT vin, string_agg(DISTINCT color_name, ', ' ORDER BY color_name) AS colors FROM d_color GROUP BY vin),
listing AS (
    SELECT v.vin, v.vehicle_type, v.manufacturer_name AS manufacturer, v.model_name AS model, v.year, v.fuel_type,
           h.colors, v.horsepower, v.condition, v.description,
           CAST(coalesce(s.sale_price, round(1.25 * p.purchase_price + 1.1 * coalesce(t.cost, 0), 2)) AS DOUBLE)
               AS sale_price,
           s.sold_on AS sale_date, CAST(p.purchase_price AS DOUBLE) AS purchase_price, p.purchased_on AS purchase_date,
           CAST(coalesce(t.cost, 0) AS DOUBLE) AS total_parts_cost,
           s.vin IS NOT NULL AS is_sold, v.vin IN (SELECT vin FROM pending) AS is_pending
    FROM d_vehicle v
    LEFT JOIN shades h ON h.vin = v.vin
    LEFT JOIN spent t ON t.vin = v.vin
    LEFT JOIN d_purchase p ON p.vin = v.vin
    LEFT JOIN d_sale s ON s.vin = v.vin)
"""

_PUBLIC = "vin, vehicle_type, manufacturer, model, year, fuel_type, colors, horsepower, sale_price"
_CLERK = (
    "vin, vehicle_type, manufacturer, model, year, fuel_type, colors, horsepower, purchase_price, total_parts_cost"
)
_MANAGER = f"{_PUBLIC}, purchase_price, purchase_date, total_parts_cost, description"


def _listing(columns: str, where: str = "TRUE") -> str:
    return f"SELECT {columns} FROM listing WHERE {where}"


def _attributes(rows: str, labels: list[tuple[str, str]]) -> str:
    """One SELECT per attribute, stacked."""
    return " UNION ALL ".join(
        f"SELECT vin, {i} AS ord, '{label}' AS attribute, {value} AS value FROM ({rows})"
        for i, (label, value) in enumerate(labels, start=1)
    )


def _money_text(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR)"


_COMMON_LABELS = [
    ("VIN", "vin"),
    ("VehicleType", "vehicle_type"),
    ("Manufacturer", "manufacturer"),
    ("Model", "model"),
    ("Year", "CAST(year AS VARCHAR)"),
    ("FuelType", "fuel_type"),
    ("Colors", "colors"),
    ("Horsepower", "CAST(horsepower AS VARCHAR)"),
    ("Description", "description"),
]
_PUBLIC_LABELS = [*_COMMON_LABELS, ("SalePrice", _money_text("sale_price"))]
_STAFF_LABELS = [
    *_COMMON_LABELS,
    ("TotalPartsCost", _money_text("total_parts_cost")),
    ("PurchasePrice", _money_text("purchase_price")),
    ("PurchaseDate", "CAST(purchase_date AS VARCHAR)"),
    ("SalePrice", _money_text("sale_price")),
    ("SaleDate", "CAST(sale_date AS VARCHAR)"),
]

_SELLABLE = "NOT is_sold AND NOT is_pending"


def _contacts(deal: str, person: str, staff: str) -> str:
    return f"""
    SELECT d.vin, c.email AS {person}_email, c.phone_number AS {person}_phone,
           c.street || ', ' || c.city || ', ' || c.state || ' ' || c.postal_code AS {person}_address,
           u.first_name AS {staff}_first_name, u.last_name AS {staff}_last_name, u.username AS {staff}_username
    FROM {deal} d JOIN d_customer c ON c.customer_id = d.customer_id JOIN d_user u ON u.username = d.username"""


def _contact_labels(person: str, staff: str, titles: tuple[str, str]) -> list[tuple[str, str]]:
    return [
        *[(f"{titles[0]} {x.title()}", f"{person}_{x}") for x in ("email", "phone", "address")],
        *[(f"{titles[1]} {x.replace('_', ' ').title()}", f"{staff}_{x}") for x in ("first_name", "last_name", "username")],
    ]


def _cents(total_cents: str, count: str) -> str:
    """Half-up cents of a non-negative quotient, in integers."""
    return f"((2 * CAST({total_cents} AS BIGINT) + {count}) // (2 * {count}))"


_SELLERS = f"""
    WITH per_vin AS (SELECT vin, sum(quantity) AS q, CAST(sum(quantity * unit_price) AS DECIMAL(18,2)) AS cost
                     FROM d_part GROUP BY vin)
    SELECT p.customer_id,
           CASE WHEN c.customer_id IS NULL THEN NULL WHEN c.is_business THEN c.business_name
                ELSE c.first_name || ' ' || c.last_name END AS seller_name,
           count(*) AS total_vehicles_sold,
           CAST({_cents("sum(p.purchase_price) * 100", "count(*)")} AS DOUBLE) / 100 AS avg_purchase_price,
           CAST(sum(coalesce(v.q, 0)) AS DOUBLE) / count(*) AS avg_parts_quantity,
           CAST(sum(coalesce(v.cost, 0)) AS DOUBLE) / count(*) AS avg_parts_cost,
           sum(coalesce(v.q, 0)) >= 5 * count(*) OR sum(coalesce(v.cost, 0)) >= 500 * count(*) AS flagged
    FROM d_purchase p LEFT JOIN per_vin v ON v.vin = p.vin LEFT JOIN d_customer c ON c.customer_id = p.customer_id
    GROUP BY p.customer_id, c.customer_id, c.is_business, c.business_name, c.first_name, c.last_name"""

_AVT_CENTS = _cents("sum(s.sold_on - p.purchased_on + 1) * 100", "count(s.sold_on - p.purchased_on)")
_INVENTORY_TIME = f"""
    SELECT v.vehicle_type,
           CASE WHEN count(s.sold_on) > 0 THEN CAST({_AVT_CENTS} AS DOUBLE) / 100 END AS avg_days,
           CASE WHEN count(s.sold_on) = 0 THEN 'N/A'
                ELSE printf('%d.%02d', {_AVT_CENTS} // 100, {_AVT_CENTS} % 100) END AS avg_inventory_time
    FROM d_vehicle v LEFT JOIN d_purchase p ON p.vin = v.vin LEFT JOIN d_sale s ON s.vin = v.vin
    GROUP BY v.vehicle_type"""

_CONDITION_COLUMNS = ", ".join(
    f"coalesce(CAST(sum(CASE WHEN v.condition = '{c}' THEN p.purchase_price END) AS DOUBLE) / "
    f"nullif(count(CASE WHEN v.condition = '{c}' THEN p.purchase_price END), 0), 0) AS {c.lower().replace(' ', '_')}"
    for c in schema.CONDITIONS
)


def _drilldown(columns: str, where: str) -> str:
    return f"""
    SELECT {columns} u.username, u.first_name, u.last_name, count(*) AS vehicles_sold,
           CAST(sum(s.sale_price) AS DOUBLE) AS total_sales
    FROM d_sale s JOIN d_user u ON u.username = s.username WHERE {where} GROUP BY ALL"""


_OPTIONS = f"""
    SELECT DISTINCT 'vehicle_type' AS option, vehicle_type AS value FROM d_vehicle
    UNION ALL SELECT DISTINCT 'manufacturer', manufacturer_name FROM d_vehicle
    UNION ALL SELECT DISTINCT 'color', color_name FROM d_color"""


def _values(option: str, values: tuple[str, ...]) -> str:
    return " " + " ".join(f"UNION ALL SELECT '{option}', '{v}'" for v in values)


_SEED_LISTS = (
    ("vehicle_type", schema.VEHICLE_TYPES),
    ("manufacturer", schema.MANUFACTURERS),
    ("color", schema.COLORS),
)
_SEEDS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, unnest([{', '.join(repr(v) for v in values)}]) AS value" for d, values in _SEED_LISTS
)

# Ingest: the raw rows carry an unknown seller on every 97th vehicle.
_LOADED = "(SELECT * FROM o WHERE k % 97 <> 0)"
_INGESTED_CUSTOMER = "row_number() OVER (ORDER BY customer_id)"

# Batch of new vehicles.
_OFFERS = f"""
offers AS (
    SELECT p_partkey AS submission_id, 'NEW' || lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS vin,
           {_pick(schema.VEHICLE_TYPES, "p_partkey % 9")} AS vehicle_type,
           {_pick(schema.MANUFACTURERS, "p_partkey % 48")} AS manufacturer_name,
           {_pick(schema.CONDITIONS, "p_partkey % 4")} AS condition, p_name AS model_name,
           CAST(1978 + p_partkey % 50 AS INTEGER) AS year, {_pick(schema.FUEL_TYPES, "p_partkey % 7")} AS fuel_type,
           CAST(p_size % 10 AS INTEGER) AS horsepower, p_brand || ' ' || p_type AS description,
           {_pick(schema.COLORS, "p_partkey % 26")} AS color_1,
           {_pick((*schema.COLORS, "Plaid"), "(p_partkey + 1) % 27")} AS color_2,
           'user' || CAST(p_partkey % 9 * 3 AS VARCHAR) AS username,
           {_customer_key_to_identifier("p_partkey % 160")} AS seller_identifier,
           CAST(p_retailprice AS DECIMAL(12,2)) AS purchase_price
    FROM part),
form_checked AS (
    SELECT *, concat_ws('|',
               CASE WHEN horsepower <= 0 THEN 'missing_horsepower' END,
               CASE WHEN year < 1980 OR year > 2025 THEN 'year_out_of_range' END) AS form_reasons
    FROM offers),
offer_checked AS (
    SELECT f.*, c.customer_id, concat_ws('|', 
               CASE WHEN horsepower <= 0 THEN 'missing_horsepower' END,
               CASE WHEN color_2 = 'Plaid' THEN 'unknown_color' END,
               CASE WHEN c.customer_id IS NULL THEN 'unknown_seller' END,
               CASE WHEN f.year < 1980 OR f.year > 2025 THEN 'year_out_of_range' END) AS reasons
    FROM form_checked f LEFT JOIN d_customer c ON c.identifier = f.seller_identifier)"""

# Batch of new customers: people from nation keys 0 to 4 exist already.
_APPLICANTS = """
applicants AS (
    SELECT *, concat_ws('|', CASE WHEN nation_key < 5 THEN 'identifier_exists' END,
                             CASE WHEN email IS NULL THEN 'missing_email' END) AS reasons
    FROM d_customer),
admitted AS (
    SELECT * REPLACE (row_number() OVER (ORDER BY customer_id) + (SELECT max(c_custkey) FROM customer) AS customer_id)
    FROM applicants WHERE reasons = '')"""

_VENDOR_BATCH = """
vendor_batch AS (
    SELECT supplier_key AS submission_id, name || CASE WHEN supplier_key % 2 = 1 THEN '-B' ELSE '' END AS new_name,
           concat_ws('|', CASE WHEN supplier_key % 3 = 0 THEN 'missing_phone_number' END,
                          CASE WHEN supplier_key % 2 = 0 THEN 'name_exists' END) AS reasons, *
    FROM d_vendor)"""

# Batch of parts orders.
_REORDERS = """
reorders AS (
    SELECT l_orderkey * 8 + l_linenumber AS submission_id, 'VIN' || lpad(CAST(l_orderkey AS VARCHAR), 14, '0') AS vin,
           'Vendor ' || CAST(min(l_suppkey) AS VARCHAR) AS vendor_name, CAST(min(l_partkey) AS VARCHAR) AS p,
           CAST(count(*) AS INTEGER) AS lines,
           CAST(min(floor(l_extendedprice / 16)) / 100 AS DECIMAL(12,2)) AS low,
           CAST(max(floor(l_extendedprice / 16)) / 100 AS DECIMAL(12,2)) AS high
    FROM lineitem GROUP BY l_orderkey, l_linenumber),
placed AS (
    SELECT r.*, r.vin || '-' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0')
                                     ELSE CAST(seq AS VARCHAR) END AS order_number
    FROM (SELECT r.*, coalesce(e.n, 0) + row_number() OVER (PARTITION BY r.vin ORDER BY submission_id) AS seq
          FROM reorders r
          JOIN o ON o.vin = r.vin AND NOT o.is_sold
          LEFT JOIN (SELECT vin, count(*) AS n FROM d_order GROUP BY vin) e ON e.vin = r.vin) r)"""

# Batch of status updates.
_UPDATES = """
updates AS (
    SELECT order_number || CASE WHEN p % 50 = 0 THEN '-X' ELSE '' END AS order_number, vendor_parts_number,
           ['Installed', 'Received', 'Ordered'][CAST((p + n * seq) % 3 AS INTEGER) + 1] AS new_status, seq
    FROM d_part CROSS JOIN (VALUES (1), (2)) AS twice(seq)),
before_after AS (
    SELECT d.order_number, d.vendor_parts_number, d.description, d.quantity, CAST(d.unit_price AS DOUBLE) AS unit_price,
           d.status AS s0,
           CASE WHEN p % 50 <> 0 THEN ['Installed', 'Received', 'Ordered'][CAST((p + n) % 3 AS INTEGER) + 1] END AS u1,
           CASE WHEN p % 50 <> 0 THEN ['Installed', 'Received', 'Ordered'][CAST((p + n * 2) % 3 AS INTEGER) + 1] END AS u2
    FROM d_part d),
one_step AS (
    SELECT *, (s0 = 'Ordered' AND u1 IN ('Received', 'Installed')) OR (s0 = 'Received' AND u1 = 'Installed') AS ok1
    FROM before_after),
two_steps AS (
    SELECT *, (s1 = 'Ordered' AND u2 IN ('Received', 'Installed')) OR (s1 = 'Received' AND u2 = 'Installed') AS ok2
    FROM (SELECT *, CASE WHEN ok1 THEN u1 ELSE s0 END AS s1 FROM one_step))"""

# Batch of sales.
_BIDS = f"""
bids AS (
    SELECT b.*, l.sale_price, c.customer_id AS buyer_id,
           concat_ws('|', CASE WHEN l.is_sold THEN 'already_sold' END, CASE WHEN l.is_pending THEN 'parts_pending' END,
                          CASE WHEN c.customer_id IS NULL THEN 'unknown_buyer' END) AS reasons
    FROM (SELECT k AS submission_id, vin, 'user' || CAST(k % 8 * 3 + 1 AS VARCHAR) AS username, bought + 30 AS sold_on,
                 CASE WHEN k % 89 = 0 THEN 'nobody' ELSE {_customer_key_to_identifier("buyer")} END AS identifier
          FROM o) b
    JOIN listing l ON l.vin = b.vin
    LEFT JOIN d_customer c ON c.identifier = b.identifier)"""

# Planted faults of the quality checks.
_FAULTS = """
f_vehicle AS (
    SELECT * REPLACE (CASE WHEN fuel_type = 'Diesel' THEN 'Poor' ELSE condition END AS condition) FROM d_vehicle
    UNION ALL SELECT * FROM d_vehicle WHERE year = 1999),
f_part AS (
    SELECT * REPLACE (CASE WHEN status = 'Received' THEN order_number || '-lost' ELSE order_number END AS order_number)
    FROM d_part),
f_color AS (
    SELECT vin, CASE WHEN color_name = 'Rust' THEN 'Plaid' ELSE color_name END AS color_name FROM d_color)"""


def _with(extra: str, select: str) -> str:
    return f", {extra.strip()} {select}"


def _domain_rows() -> str:
    """Rule list of the domain check; only the planted faults have violations."""
    broken = {
        ("vehicle", "condition", "domain"): "(SELECT count(*) FROM f_vehicle WHERE condition = 'Poor')",
        ("customer", "city", "not_null"): "(SELECT count(*) FROM d_customer WHERE email IS NULL)",
    }
    rows = []
    for table, columns in schema.SCHEMAS.items():
        rules = [(f.name, "not_null") for f in columns if not f.nullable]
        rules += [(c, "domain") for (owner, c) in schema.DOMAINS if owner == table]
        for column, rule in rules:
            n = broken.get((table, column, rule), "0")
            rows.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{rule}' AS rule, CAST({n} AS BIGINT) AS violations"
            )
    return " UNION ALL ".join(rows)


# The dealership with several deals per vehicle; `_several` puts its tables in place of the others.
_SEVERAL = """
s_purchase AS (
    SELECT p.* FROM d_purchase p JOIN o ON o.vin = p.vin WHERE k % 13 <> 5
    UNION ALL
    SELECT vin, buyer, 'user' || CAST(k % 9 * 3 AS VARCHAR), CAST(round(0.8 * paid, 2) AS DECIMAL(12,2)), bought + 20
    FROM o WHERE k % 13 <> 5 AND k % 6 = 0
    UNION ALL
    SELECT p.* FROM d_purchase p JOIN o ON o.vin = p.vin WHERE k % 13 <> 5 AND k % 12 = 0),
s_sale AS (
    SELECT s.* FROM d_sale s JOIN o ON o.vin = s.vin WHERE k % 9 <> 4
    UNION ALL
    SELECT vin, c, 'user' || CAST((k + 1) % 8 * 3 + 1 AS VARCHAR), CAST(round(1.1 * paid, 2) AS DECIMAL(12,2)),
           bought + CAST(k % 90 AS INTEGER) + 45
    FROM o WHERE is_sold AND k % 9 <> 4 AND k % 4 = 0
    UNION ALL
    SELECT s.* FROM d_sale s JOIN o ON o.vin = s.vin WHERE k % 9 <> 4 AND k % 8 = 0),
s_customer AS (SELECT * FROM d_customer WHERE customer_id % 29 <> 3),
s_listing AS (
    SELECT DISTINCT v.vin, v.vehicle_type, v.manufacturer_name AS manufacturer, v.model_name AS model, v.year,
           v.fuel_type, h.colors, v.horsepower, v.condition, v.description,
           CAST(coalesce(s.sale_price, round(1.25 * p.purchase_price + 1.1 * coalesce(t.cost, 0), 2)) AS DOUBLE)
               AS sale_price,
           s.sold_on AS sale_date, CAST(p.purchase_price AS DOUBLE) AS purchase_price, p.purchased_on AS purchase_date,
           CAST(coalesce(t.cost, 0) AS DOUBLE) AS total_parts_cost,
           s.vin IS NOT NULL AS is_sold, v.vin IN (SELECT vin FROM pending) AS is_pending
    FROM d_vehicle v
    LEFT JOIN shades h ON h.vin = v.vin
    LEFT JOIN spent t ON t.vin = v.vin
    LEFT JOIN s_purchase p ON p.vin = v.vin
    LEFT JOIN s_sale s ON s.vin = v.vin)"""


def _several(text: str) -> str:
    for table in ("d_purchase", "d_sale", "listing"):
        text = text.replace(table, f"s_{table.removeprefix('d_')}")
    return _with(_SEVERAL, text)


def _dollars(column: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({column} AS DOUBLE))"


def _titled(rows: str, titles: list[tuple[str, str]]) -> str:
    return f"SELECT {', '.join(f'{value} AS "{title}"' for title, value in titles)} FROM ({rows})"


# One fault of every kind: table, rows entered twice, and the columns of each declared key.
_TWICE = (
    (f"(SELECT unnest({list(schema.COLORS)}) AS color_name)", "color_name = 'Red'", {"color_pk": "color_name"}),
    (f"(SELECT unnest({list(schema.VEHICLE_TYPES)}) AS t)", "t = 'SUV'", {"vehicle_type_pk": "t"}),
    (f"(SELECT unnest({list(schema.MANUFACTURERS)}) AS m)", "m = 'Kia'", {"manufacturer_pk": "m"}),
    ("d_vehicle", "year = 1999", {"vehicle_pk": "vin"}),
    ("d_color", "color_name = 'Red'", {"vehicle_color_pk": "color_name, vin"}),
    ("d_vendor", "state = 'State 1'", {"vendor_pk": "name"}),
    (
        "d_order",
        "vendor_name LIKE '%7'",
        {"parts_order_pk": "order_number, vendor_name, vin", "parts_order_number_uq": "order_number"},
    ),
    ("d_part", "status = 'Received'", {"part_pk": "vendor_parts_number, order_number"}),
    ("d_customer", "state = 'State 2'", {"customer_pk": "CAST(customer_id AS VARCHAR)"}),
    (
        "d_customer",
        "NOT is_business AND first_name = 'First7'",
        {"individual_customer_pk": "identifier", "individual_customer_id_uq": "CAST(customer_id AS VARCHAR)"},
    ),
    (
        "d_customer",
        "is_business AND business_name LIKE '%5'",
        {"business_customer_pk": "identifier", "business_customer_id_uq": "CAST(customer_id AS VARCHAR)"},
    ),
    ("d_user", "role = 'Manager'", {"user_pk": "username"}),
    ("d_purchase", "username = 'user3'", {"purchase_pk": "vin, username, customer_id"}),
    ("d_sale", "username = 'user4'", {"sale_pk": "vin, username, customer_id"}),
)
_LOST = (
    ("vehicle.vehicle_type", "d_vehicle", "vehicle_type", "year = 2001"),
    ("vehicle.manufacturer_name", "d_vehicle", "manufacturer_name", "year = 2002"),
    ("vehicle_color.color_name", "d_color", "color_name", "color_name = 'Red'"),
    ("vehicle_color.vin", "d_color", "vin", "color_name = 'Blue'"),
    ("parts_order.vin", "d_order", "vin", "vendor_name LIKE '%7'"),
    ("parts_order.vendor_name", "d_order", "vendor_name", "vendor_name LIKE '%8'"),
    ("part.order_number", "d_part", "order_number", "status = 'Received'"),
    ("individual_customer.customer_id", "d_customer", "customer_id", "NOT is_business AND first_name = 'First7'"),
    ("business_customer.customer_id", "d_customer", "customer_id", "is_business AND business_name LIKE '%5'"),
    ("purchase.vin", "d_purchase", "vin", "username = 'user3'"),
    ("purchase.customer_id", "d_purchase", "customer_id", "username = 'user6'"),
    ("purchase.username", "d_purchase", "username", "username = 'user9'"),
    ("sale.vin", "d_sale", "vin", "username = 'user4'"),
    ("sale.customer_id", "d_sale", "customer_id", "username = 'user7'"),
    ("sale.username", "d_sale", "username", "username = 'user10'"),
)


def _repeated_keys() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS constraint_name, concat_ws('|', {key}) AS key, CAST(2 AS BIGINT) AS n FROM {table} WHERE {some}"
        for table, some, keys in _TWICE
        for name, key in keys.items()
    )


def _lost_values() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS constraint_name, "
        + (f"CAST(-{column} - 1 AS VARCHAR)" if column == "customer_id" else f"{column} || '-lost'")
        + f" AS value, count(*) AS n FROM {table} WHERE {some} GROUP BY ALL"
        for name, table, column, some in _LOST
    )


# The rule that orders break by the remainder of their id.
_BROKEN_RULES = (
    "missing_vin", "missing_vendor_name", "vin_too_long", "part_count", "missing_part_description", "bad_unit_price",
    "bad_quantity", "bad_status", "repeated_part_number", "part_count|repeated_part_number",
)


_WANTED_PART = "order_number, vendor_parts_number, description, quantity, status, CAST(unit_price AS DOUBLE) AS unit_price"
_CONTACT_COLUMNS = "email, phone_number, street, city, state, postal_code"
_VEHICLE_COLUMNS = (
    "vin, vehicle_type, manufacturer_name, condition, model_name, year, fuel_type, horsepower, description"
)


def _queries() -> dict[str, str]:
    purchase_contacts = _contacts("d_purchase", "seller", "clerk")
    sale_contacts = _contacts("d_sale", "customer", "seller")
    return {
        "search_vehicles_public": _listing(_PUBLIC, _SELLABLE),
        "search_vehicles_salesperson": _listing(_PUBLIC, _SELLABLE),
        "search_vehicles_clerk": _listing(_CLERK, "NOT is_sold"),
        "search_vehicles_manager_all": _listing(_MANAGER),
        "search_vehicles_manager_sold": _listing(_MANAGER, "is_sold"),
        "search_vehicles_manager_unsold": _listing(_MANAGER, "NOT is_sold"),
        "search_by_attributes": _listing(_MANAGER, "vehicle_type = 'SUV' AND fuel_type = 'Hybrid'"),
        "search_by_year": _listing(_CLERK, "NOT is_sold AND year = 1999"),
        "search_by_color": f"SELECT * REPLACE ('Red' AS colors) FROM ({_listing(_MANAGER, 'TRUE')}) "
        "WHERE vin IN (SELECT vin FROM d_color WHERE color_name = 'Red')",
        "search_by_color_all_colors": _listing(_MANAGER, "vin IN (SELECT vin FROM d_color WHERE color_name = 'Red')"),
        "search_by_keyword": _listing(
            _MANAGER,
            "manufacturer ILIKE '%harbor 3%' OR model ILIKE '%harbor 3%' OR CAST(year AS VARCHAR) ILIKE '%harbor 3%' "
            "OR description ILIKE '%harbor 3%'",
        ),
        "search_by_keyword_wildcard": _listing(_MANAGER, "description ILIKE '%5-low%summit%'"),
        "search_by_keyword_collated": _listing(_MANAGER, "contains(lower(model), 'harbor')"),
        "search_by_vin": _listing(_PUBLIC, f"{_SELLABLE} AND vin IN (SELECT vin FROM d_order)"),
        "search_by_one_vin": _listing(_MANAGER, "vin = 'VIN00000000000042'"),
        "asking_price": _listing("vin, purchase_price, total_parts_cost, sale_price"),
        "filter_options": _OPTIONS
        + _values("fuel_type", ("Any", *schema.FUEL_TYPES))
        + " UNION ALL SELECT 'year', 'Any' UNION ALL SELECT 'year', CAST(y AS VARCHAR) FROM range(1980, 2026) r(y)"
        + _values("vehicle_type", ("Any",))
        + _values("manufacturer", ("Any",))
        + _values("color", ("Any",)),
        "parts_cost_per_vehicle": "SELECT vin, CAST(cost AS DOUBLE) AS parts_cost FROM spent",
        "vehicle_parts": "SELECT p.vin, p.order_number, p.vendor_parts_number, p.description AS part_description, "
        "p.quantity, p.status AS part_status, CAST(p.unit_price AS DOUBLE) AS unit_price, p.vendor_name "
        "FROM d_part p JOIN d_vendor v ON v.name = p.vendor_name",
        "vehicles_without_pending_parts": "SELECT * FROM d_vehicle WHERE vin NOT IN (SELECT vin FROM pending)",
        "unsold_vehicles": "SELECT * FROM d_vehicle WHERE vin NOT IN (SELECT vin FROM d_sale)",
        "purchase_details": purchase_contacts,
        "purchase_attributes": _attributes(
            purchase_contacts, _contact_labels("seller", "clerk", ("External Seller", "Inventory Clerk"))
        ),
        "sale_details": sale_contacts,
        "sale_details_one_per_vin": sale_contacts,
        "sale_attributes": _attributes(sale_contacts, _contact_labels("customer", "seller", ("Customer", "Seller"))),
        "vehicle_colors": "SELECT vin, colors FROM shades",
        "all_parts_installed": "SELECT vin, vin NOT IN (SELECT vin FROM pending) AS all_installed FROM d_vehicle",
        "sale_eligibility": "SELECT vin, NOT is_sold AS unsold, NOT is_pending AS all_installed, "
        "NOT is_sold AND NOT is_pending AS can_sell FROM listing",
        "seller_history": f"SELECT * FROM ({_SELLERS})",
        "avg_inventory_time": _INVENTORY_TIME,
        "price_per_condition": f"SELECT v.vehicle_type, {_CONDITION_COLUMNS} FROM d_vehicle v "
        "LEFT JOIN d_purchase p ON p.vin = v.vin GROUP BY v.vehicle_type",
        "parts_statistics": "SELECT v.name AS vendor_name, CAST(sum(p.quantity) AS BIGINT) AS total_parts_quantity, "
        "CAST(sum(p.quantity * p.unit_price) AS DOUBLE) AS total_amount_spent "
        "FROM d_vendor v JOIN d_part p ON p.vendor_name = v.name GROUP BY v.name",
        "monthly_sales": "SELECT CAST(year(s.sold_on) AS INTEGER) AS year, CAST(month(s.sold_on) AS INTEGER) AS month, "
        "count(*) AS vehicles_sold, CAST(sum(s.sale_price) AS DOUBLE) AS gross_sales_income, "
        "CAST(sum(s.sale_price - p.purchase_price - coalesce(t.cost, 0)) AS DOUBLE) AS net_income "
        "FROM d_sale s JOIN d_purchase p ON p.vin = s.vin LEFT JOIN spent t ON t.vin = s.vin GROUP BY ALL",
        "monthly_sales_drilldown": _drilldown(
            "CAST(year(s.sold_on) AS INTEGER) AS year, CAST(month(s.sold_on) AS INTEGER) AS month,", "TRUE"
        ),
        "monthly_sales_drilldown_month": _drilldown("", "year(s.sold_on) = 1997 AND month(s.sold_on) = 5"),
        "count_pending_parts": "SELECT count(*) AS pending_parts_count FROM listing WHERE NOT is_sold AND is_pending",
        "count_available": f"SELECT count(*) AS available_count FROM listing WHERE {_SELLABLE}",
        "vehicle_counts": f"SELECT count(*) FILTER (WHERE {_SELLABLE}) AS available_count, "
        "count(*) FILTER (WHERE NOT is_sold AND is_pending) AS pending_parts_count FROM listing",
        "distinct_values": "SELECT DISTINCT model_name FROM d_vehicle",
        "customer_identifiers": "SELECT DISTINCT identifier FROM d_customer",
        "customer_lookup": "SELECT identifier, customer_id FROM d_customer WHERE identifier IN ("
        f"SELECT CASE WHEN k % 89 = 0 THEN 'nobody' ELSE {_customer_key_to_identifier('buyer')} END FROM o)",
        "list_vendors": "SELECT name FROM d_vendor",
        "list_dimension_values": f"SELECT option AS dimension, value FROM ({_OPTIONS})",
        "seed_dimensions": f"SELECT d.dimension, d.value, count(u.value) AS vehicles FROM ({_SEEDS}) d LEFT JOIN ("
        "SELECT 'vehicle_type' AS dimension, vehicle_type AS value FROM d_vehicle "
        "UNION ALL SELECT 'manufacturer', manufacturer_name FROM d_vehicle "
        "UNION ALL SELECT 'color', color_name FROM d_color) u "
        "ON u.dimension = d.dimension AND u.value = d.value GROUP BY ALL",
        "vehicle_details_public": _attributes(_listing("*", _SELLABLE), _PUBLIC_LABELS),
        "vehicle_details_manager": _attributes(_listing("*"), _STAFF_LABELS),
        "vehicle_details_clerk": _attributes(_listing("*", "NOT is_sold"), _STAFF_LABELS),
        "vehicle_details_unsold": _attributes(_listing("*", "NOT is_sold"), _STAFF_LABELS),
        "sellable_vehicle": _listing(
            "vin, vehicle_type, manufacturer, model, year, fuel_type, horsepower, colors, condition, description, "
            "purchase_price, purchase_date, sale_price",
            "NOT is_sold",
        ),
        "ingest_customers": f"SELECT {_INGESTED_CUSTOMER} AS customer_id, {_CONTACT_COLUMNS} FROM d_customer",
        "ingest_customers_individual": "SELECT customer_id, first_name, last_name, identifier AS social_security_number "
        f"FROM (SELECT * REPLACE ({_INGESTED_CUSTOMER} AS customer_id) FROM d_customer) WHERE NOT is_business",
        "ingest_customers_business": "SELECT customer_id, business_name, identifier AS tax_identification_number, "
        "'Pat' AS contact_first_name, last_name AS contact_last_name, 'Manager' AS contact_title "
        f"FROM (SELECT * REPLACE ({_INGESTED_CUSTOMER} AS customer_id) FROM d_customer) WHERE is_business",
        "assign_customer_ids": "SELECT customer_id AS line_no, CASE WHEN is_business THEN 'business' ELSE 'person' END "
        f"AS customer_type, 1000 + {_INGESTED_CUSTOMER} AS customer_id FROM d_customer",
        "ingest_users": "SELECT * REPLACE (CASE WHEN role = 'Owner' THEN 'owner' ELSE username END AS username) FROM d_user",
        "ingest_vendors": "SELECT name, phone_number, street, city, state, postal_code FROM d_vendor",
        "ingest_vehicles": f"SELECT * FROM d_vehicle WHERE vin IN (SELECT vin FROM {_LOADED})",
        "ingest_vehicle_purchases": "SELECT vin, customer_id, username, CAST(purchase_price AS DOUBLE) AS purchase_price, "
        f"purchased_on FROM d_purchase WHERE vin IN (SELECT vin FROM {_LOADED})",
        "ingest_vehicle_colors": f"SELECT vin, color_name FROM d_color WHERE vin IN (SELECT vin FROM {_LOADED})",
        "ingest_vehicle_sales": "SELECT s.vin, s.customer_id, s.username, CAST(p.purchase_price AS DOUBLE) AS sale_price, "
        "s.sold_on FROM d_sale s JOIN d_purchase p ON p.vin = s.vin "
        f"WHERE s.vin IN (SELECT vin FROM {_LOADED})",
        "ingest_vehicle_rejects": "SELECT vin, 'unknown_seller' AS reasons FROM o WHERE k % 97 = 0",
        "ingest_parts": f"SELECT {_WANTED_PART} FROM d_part",
        "ingest_parts_orders": "SELECT vin, vendor_name, order_number, CAST(total_cost AS DOUBLE) AS total_cost FROM d_order",
        "order_total_cost": "SELECT order_number, CAST(total_cost AS DOUBLE) AS total_cost FROM d_order",
        "resolve_customer_id": "SELECT r.vin AS \"VIN\", r.seller AS purchased_from_customer, c.customer_id FROM ("
        f"SELECT vin, CASE WHEN k % 97 = 0 THEN 'nobody' ELSE {_customer_key_to_identifier('c')} END AS seller FROM o) r "
        "LEFT JOIN d_customer c ON c.identifier = r.seller",
        "apply_vehicle_batch": _with(_OFFERS, f"SELECT {_VEHICLE_COLUMNS} FROM offer_checked WHERE reasons = ''"),
        "apply_vehicle_batch_colors": _with(
            _OFFERS,
            "SELECT vin, color_1 AS color_name FROM offer_checked WHERE reasons = '' "
            "UNION SELECT vin, color_2 FROM offer_checked WHERE reasons = ''",
        ),
        "apply_vehicle_batch_purchases": _with(
            _OFFERS,
            "SELECT vin, customer_id, username, CAST(purchase_price AS DOUBLE) AS purchase_price, "
            "DATE '2024-05-01' AS purchased_on FROM offer_checked WHERE reasons = ''",
        ),
        "apply_vehicle_batch_rejects": _with(
            _OFFERS, "SELECT submission_id, reasons FROM offer_checked WHERE reasons <> ''"
        ),
        "apply_customer_batch": _with(_APPLICANTS, f"SELECT customer_id, {_CONTACT_COLUMNS} FROM admitted"),
        "apply_customer_batch_individual": _with(
            _APPLICANTS,
            "SELECT customer_id, first_name, last_name, 'N' || identifier AS social_security_number FROM admitted "
            "WHERE NOT is_business",
        ),
        "apply_customer_batch_business": _with(
            _APPLICANTS,
            "SELECT customer_id, business_name, 'N' || identifier AS tax_identification_number, "
            "'Pat' AS contact_first_name, last_name AS contact_last_name, 'Manager' AS contact_title FROM admitted "
            "WHERE is_business",
        ),
        "apply_customer_batch_rejects": _with(
            _APPLICANTS, "SELECT customer_id AS submission_id, reasons FROM applicants WHERE reasons <> ''"
        ),
        "apply_vendor_batch": _with(
            _VENDOR_BATCH,
            "SELECT new_name AS name, phone_number, street, city, state, postal_code FROM vendor_batch WHERE reasons = ''",
        ),
        "apply_vendor_batch_rejects": _with(
            _VENDOR_BATCH, "SELECT submission_id, reasons FROM vendor_batch WHERE reasons <> ''"
        ),
        "apply_parts_orders": _with(
            _REORDERS,
            "SELECT vin, vendor_name, order_number, CAST(low * lines + high AS DOUBLE) AS total_cost FROM placed",
        ),
        "apply_parts_orders_parts": _with(
            _REORDERS,
            "SELECT order_number, 'A' || p AS vendor_parts_number, 'Part A' || p AS description, lines AS quantity, "
            "'Ordered' AS status, CAST(low AS DOUBLE) AS unit_price FROM placed "
            "UNION ALL SELECT order_number, 'B' || p, 'Part B' || p, 1, 'Received', CAST(high AS DOUBLE) FROM placed",
        ),
        "apply_parts_orders_rejects": _with(
            _REORDERS,
            "SELECT submission_id, 'sold_or_unknown_vehicle' AS reasons FROM reorders "
            "WHERE vin NOT IN (SELECT vin FROM o WHERE NOT is_sold)",
        ),
        "apply_status_updates": _with(
            _UPDATES,
            "SELECT order_number, vendor_parts_number, description, quantity, coalesce(u2, s0) AS status, unit_price "
            "FROM before_after",
        ),
        "apply_status_updates_results": _with(
            _UPDATES,
            "SELECT order_number, vendor_parts_number, new_status, seq, NOT ends_with(order_number, '-X') AS matched "
            "FROM updates",
        ),
        "apply_status_transitions": _with(
            _UPDATES,
            "SELECT order_number, vendor_parts_number, description, quantity, CASE WHEN ok2 THEN u2 ELSE s1 END AS status, "
            "unit_price FROM two_steps",
        ),
        "apply_status_transitions_results": _with(
            _UPDATES,
            "SELECT u.order_number, u.vendor_parts_number, u.new_status, u.seq, "
            "coalesce(CASE WHEN u.seq = 1 THEN t.ok1 ELSE t.ok2 END, FALSE) AS applied FROM updates u "
            "LEFT JOIN two_steps t ON t.order_number = u.order_number AND t.vendor_parts_number = u.vendor_parts_number",
        ),
        "apply_sales": _with(
            _BIDS, "SELECT vin, buyer_id AS customer_id, username, sale_price, sold_on FROM bids WHERE reasons = ''"
        ),
        "apply_sales_rejects": _with(_BIDS, "SELECT submission_id, reasons FROM bids WHERE reasons <> ''"),
        "check_primary_keys": _with(
            _FAULTS,
            "SELECT 'vehicle_pk' AS constraint_name, vin AS key, count(*) AS n FROM f_vehicle GROUP BY vin "
            "HAVING count(*) > 1",
        ),
        "check_foreign_keys": _with(
            _FAULTS,
            "SELECT 'part.order_number' AS constraint_name, order_number AS value, count(*) AS n FROM f_part "
            "WHERE order_number NOT IN (SELECT order_number FROM d_order) GROUP BY order_number "
            "UNION ALL SELECT 'vehicle_color.color_name', color_name, count(*) FROM f_color "
            "WHERE color_name = 'Plaid' GROUP BY color_name",
        ),
        "check_domains": _with(_FAULTS, _domain_rows()),
        "validate_submissions": _with(_OFFERS, "SELECT submission_id, form_reasons AS reasons FROM form_checked"),
        "validate_customer_submissions": "SELECT customer_id AS submission_id, "
        "CASE WHEN email IS NULL THEN 'missing_email' ELSE '' END AS reasons FROM d_customer",
        "validate_vendor_submissions": "SELECT supplier_key AS submission_id, "
        "CASE WHEN supplier_key % 3 = 0 THEN 'missing_phone_number' ELSE '' END AS reasons FROM d_vendor",
        "validate_parts_order_submissions": _with(_REORDERS, "SELECT submission_id, '' AS reasons FROM reorders"),
    }


def _later_queries() -> dict[str, str]:
    plain = _queries()
    same = (
        "seller_history", "avg_inventory_time", "price_per_condition", "monthly_sales", "monthly_sales_drilldown",
        "sellable_vehicle", "purchase_details", "sale_details",
    )
    found = {f"several_deals_{name}": _several(plain[name]) for name in same}
    # Of customers that are neither a person nor a firm, there is no name and no identifier.
    unnamed = _SELLERS.replace("WHEN c.customer_id IS NULL", "WHEN c.customer_id % 29 = 3")
    firsts = (
        "(SELECT * FROM d_sale QUALIFY row_number() OVER (PARTITION BY vin ORDER BY sold_on, username, customer_id) = 1)"
    )
    monthly = plain["monthly_sales"]
    listed = [("VIN", "vin"), ("VehicleType", "vehicle_type"), ("Manufacturer", "manufacturer"), ("Model", "model")]
    listed += [("Year", "year"), ("FuelType", "fuel_type"), ("Horsepower", "horsepower"), ("Colors", "colors")]
    listed += [("Condition", "condition"), ("Description", "description"), ("PurchasePrice", "purchase_price")]
    listed += [("PurchaseDate", "purchase_date"), ("SalePrice", "sale_price")]
    conditions = [c.lower().replace(" ", "_") for c in schema.CONDITIONS]

    def contacts(person: str, staff: str, titles: tuple[str, str]) -> list[tuple[str, str]]:
        return [("VIN", "vin"), *_contact_labels(person, staff, titles)]

    return found | {
        "several_deals_seller_history": _several(f"SELECT * FROM ({unnamed})"),
        "several_deals_search_public": _several(_listing(_PUBLIC, _SELLABLE)),
        "several_deals_search_clerk": _several(_listing(_CLERK, "NOT is_sold")),
        "several_deals_search_manager_all": _several(_listing(_MANAGER)),
        "several_deals_search_manager_sold": _several(_listing(_MANAGER, "is_sold")),
        "several_deals_vehicle_counts": _several(
            f"SELECT count(DISTINCT vin) FILTER (WHERE {_SELLABLE}) AS available_count, "
            "count(DISTINCT vin) FILTER (WHERE NOT is_sold AND is_pending) AS pending_parts_count FROM listing"
        ),
        "several_deals_sale_details_one_per_vin": _several(_contacts(firsts, "customer", "seller")),
        "several_deals_customer_identifiers": _with(_SEVERAL, "SELECT DISTINCT identifier FROM s_customer"),
        "display_seller_history": _titled(
            _SELLERS,
            [
                ("Seller Name", "seller_name"),
                ("Total Vehicles Sold", "total_vehicles_sold"),
                ("Avg Purchase Price", _dollars("avg_purchase_price")),
                ("Avg Parts Quantity Per Vehicle", "avg_parts_quantity"),
                ("Avg Parts Cost Per Vehicle", _dollars("avg_parts_cost")),
                ("Flagged", "flagged"),
            ],
        ),
        "display_sellable_vehicle": _titled(plain["sellable_vehicle"], listed),
        "display_purchase_details": _titled(
            plain["purchase_details"], contacts("seller", "clerk", ("External Seller", "Inventory Clerk"))
        ),
        "display_sale_details": _titled(plain["sale_details"], contacts("customer", "seller", ("Customer", "Seller"))),
        "display_parts_statistics": _titled(
            plain["parts_statistics"],
            [
                ("Vendor Name", "vendor_name"),
                ("Total Parts Quantity", "total_parts_quantity"),
                ("Total Amount Spent", _dollars("total_amount_spent")),
            ],
        ),
        "display_monthly_sales": _titled(
            monthly,
            [
                ("place", "row_number() OVER (ORDER BY year DESC, month DESC)"),
                ("Year", "CAST(year AS VARCHAR)"),
                ("Month", "month"),
                ("Vehicles Sold", "vehicles_sold"),
                ("Gross Sales Income", _dollars("gross_sales_income")),
                ("Net Income", _dollars("net_income")),
            ],
        ),
        "display_price_per_condition": _titled(
            plain["price_per_condition"],
            [
                ("place", "row_number() OVER (ORDER BY vehicle_type)"),
                ("Vehicle Type", "vehicle_type"),
                *[(c, _dollars(column)) for c, column in zip(schema.CONDITIONS, conditions)],
            ],
        ),
        "display_avg_inventory_time": _several(
            _titled(
                _INVENTORY_TIME,
                [
                    ("place", "row_number() OVER (ORDER BY vehicle_type)"),
                    ("Vehicle Type", "vehicle_type"),
                    ("Avg Inventory Time", "avg_inventory_time"),
                ],
            )
        ),
        "check_primary_keys_all": _repeated_keys(),
        "check_foreign_keys_all": _lost_values(),
        "validate_parts_order_submissions_faulty": _with(
            _REORDERS,
            f"SELECT submission_id, coalesce({list(_BROKEN_RULES)}[CAST(submission_id % 11 AS INTEGER)], '') AS reasons "
            "FROM reorders",
        ),
    }


# Raw rows with faults, as the loads read them: `again` marks a row's second appearance.
_TWICE_READ = "CROSS JOIN (VALUES (FALSE), (TRUE)) AS copies(again)"
_RAW_CUSTOMERS = f"""
raw_c AS (
    SELECT * REPLACE (CASE WHEN again THEN 'elsewhere' ELSE street END AS street), again,
           CASE WHEN is_business THEN 'business' ELSE 'person' END AS customer_type,
           CASE WHEN is_business AND customer_id % 35 = 5 OR NOT is_business AND customer_id % 41 = 2 THEN NULL
                ELSE identifier END AS known
    FROM d_customer {_TWICE_READ} WHERE NOT again OR customer_id % 7 = 0),
judged_c AS (
    SELECT *, CASE WHEN known IS NULL THEN 'missing_' || CASE WHEN is_business THEN 'tax_id' ELSE 'ssn' END
                   WHEN again THEN 'repeated_' || CASE WHEN is_business THEN 'tax_id' ELSE 'ssn' END END AS reasons
    FROM raw_c)"""
_RAW_USERS = f"""
raw_u AS (
    SELECT u.* REPLACE (CASE WHEN role = 'Owner' THEN 'owner' ELSE username END AS username,
                        CASE WHEN again THEN 'Twin' ELSE first_name END AS first_name), again
    FROM d_user u {_TWICE_READ} WHERE NOT again OR CAST(substr(username, 5) AS INTEGER) % 4 = 1)"""
_RAW_VENDORS = f"""
raw_v AS (
    SELECT * REPLACE (CASE WHEN again THEN 'Other city' ELSE city END AS city), again, supplier_key % 9 = 4 AS nameless
    FROM d_vendor {_TWICE_READ} WHERE NOT again OR supplier_key % 3 = 0 OR supplier_key % 9 = 4)"""
_RAW_VEHICLES = f"""
raw_w AS (
    SELECT v.*, again, concat_ws('|',
               CASE WHEN k % 37 = 1 AND NOT again THEN 'unknown_clerk' END,
               CASE WHEN k % 41 = 2 AND NOT again THEN 'unknown_manufacturer' END,
               CASE WHEN k % 47 = 4 AND is_sold AND NOT again THEN 'unknown_salesperson' END,
               CASE WHEN k % 97 = 0 THEN 'unknown_seller' END,
               CASE WHEN k % 43 = 3 AND NOT again THEN 'unknown_vehicle_type' END) AS broken
    FROM d_vehicle v JOIN o ON o.vin = v.vin {_TWICE_READ} WHERE NOT again OR k % 5 = 0),
judged_w AS (
    SELECT *, CASE WHEN broken <> '' THEN broken
                   WHEN again AND EXISTS (SELECT 1 FROM raw_w x WHERE x.vin = w.vin AND NOT x.again AND x.broken = '')
                   THEN 'repeated_vin' END AS reasons
    FROM raw_w w)"""
_RAW_PARTS = f"""
raw_p AS (
    SELECT * REPLACE (CASE WHEN again THEN 1 ELSE quantity END AS quantity), again,
           vendor_parts_number LIKE '%77-%' AS unreadable
    FROM d_part {_TWICE_READ} WHERE NOT again OR vendor_parts_number LIKE '%5-1'),
judged_p AS (
    SELECT *, concat_ws('|', CASE WHEN bool_or(unreadable) OVER w THEN 'bad_number' END,
                             CASE WHEN bool_or(again) OVER w THEN 'repeated_part_number' END) AS reasons
    FROM raw_p WINDOW w AS (PARTITION BY order_number))"""


def _faulty_loads() -> dict[str, str]:
    vehicle = (
        "vin, CASE WHEN again THEN 'SUV' ELSE vehicle_type END AS vehicle_type, "
        "CASE WHEN again THEN 'Kia' ELSE manufacturer_name END AS manufacturer_name, condition, model_name, year, "
        "fuel_type, horsepower, CASE WHEN again THEN 'again' ELSE description END AS description"
    )
    return {
        "ingest_faulty_customers": _with(_RAW_CUSTOMERS, f"SELECT {_CONTACT_COLUMNS} FROM judged_c WHERE reasons IS NULL"),
        "ingest_customers_rejects": _with(
            _RAW_CUSTOMERS, "SELECT customer_type, known AS identifier, reasons FROM judged_c WHERE reasons IS NOT NULL"
        ),
        "ingest_faulty_users": _with(_RAW_USERS, "SELECT * EXCLUDE (again) FROM raw_u WHERE NOT again"),
        "ingest_users_rejects": _with(
            _RAW_USERS, "SELECT username, 'repeated_username' AS reasons FROM raw_u WHERE again"
        ),
        "ingest_faulty_vendors": _with(
            _RAW_VENDORS,
            "SELECT name, phone_number, street, city, state, postal_code FROM raw_v WHERE NOT again AND NOT nameless",
        ),
        "ingest_vendors_rejects": _with(
            _RAW_VENDORS,
            "SELECT CASE WHEN nameless THEN '' ELSE name END AS vendor_name, "
            "CASE WHEN nameless THEN 'missing_vendor_name' ELSE 'repeated_vendor_name' END AS reasons "
            "FROM raw_v WHERE again OR nameless",
        ),
        "ingest_faulty_vehicles": _with(_RAW_VEHICLES, f"SELECT {vehicle} FROM judged_w WHERE reasons IS NULL"),
        "ingest_vehicles_rejects": _with(_RAW_VEHICLES, "SELECT vin, reasons FROM judged_w WHERE reasons IS NOT NULL"),
        "ordered_search": "SELECT row_number() OVER (ORDER BY vin) AS place, vin FROM listing WHERE " + _SELLABLE,
        "ordered_seller_history": "SELECT row_number() OVER (ORDER BY total_vehicles_sold DESC, avg_purchase_price NULLS FIRST, "
        f"seller_name) AS place, seller_name FROM ({_SELLERS})",
        "ordered_parts_statistics": "SELECT row_number() OVER (ORDER BY total_amount_spent DESC, vendor_name) AS place, "
        f"vendor_name FROM ({_queries()['parts_statistics']})",
        "ordered_monthly_sales_drilldown": "SELECT row_number() OVER (ORDER BY vehicles_sold DESC, total_sales DESC, "
        f"first_name, last_name) AS place, first_name, last_name FROM ({_queries()['monthly_sales_drilldown_month']})",
        "collated_search": _listing(_MANAGER, "vehicle_type = 'SUV' AND fuel_type = 'Hybrid'"),
        "collated_distinct_makers": "SELECT DISTINCT manufacturer_name FROM d_vehicle",
        "ingest_faulty_parts": _with(_RAW_PARTS, f"SELECT {_WANTED_PART} FROM judged_p WHERE reasons = ''"),
        "ingest_parts_rejects": _with(
            _RAW_PARTS, "SELECT order_number, vendor_parts_number, reasons FROM judged_p WHERE reasons <> ''"
        ),
    }


# Queries that give the rows of another one by another way.
SAME_ROWS = {
    "search_by_keyword_in_blocks": "search_by_keyword",
    "search_by_keyword_wildcard_in_blocks": "search_by_keyword_wildcard",
    "collated_parts_statistics": "parts_statistics",
    "collated_monthly_sales_drilldown": "monthly_sales_drilldown",
    "collated_vehicle_colors": "vehicle_colors",
    "collated_check_primary_keys": "check_primary_keys",
    "store_status_updates": "apply_status_updates",
    "store_status_transitions": "apply_status_transitions",
}


def oracle_sql() -> dict[str, str]:
    found = _queries() | _later_queries() | _faulty_loads()
    found |= {name: found[other] for name, other in SAME_ROWS.items()}
    # Lost order numbers have no parent whose spelling stands for them.
    found["collated_check_foreign_keys"] = found["check_foreign_keys"].replace(
        "order_number AS value", "lower(order_number) AS value"
    )
    return {name: f"{MODEL} {text}" for name, text in found.items()}
