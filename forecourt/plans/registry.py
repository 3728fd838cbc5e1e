"""Every registered query: the operators run over the dealership derived from the test tables.

A query returns a lazy frame.  Money leaves as DOUBLE and reason lists as text, so another engine's result
can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schema
from forecourt.functions.lineage import new_folder
from forecourt.operators import batches, ingest, inventory, lookups, quality, reports, vehicles
from forecourt.operators.collation import respelled
from forecourt.operators.display import VIEWS, display
from forecourt.plans import dealership_view as view
from forecourt.sources import partitioned, trigrams
from forecourt.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
Rows = Callable[[view.Source], DataFrame]

AS_OF_YEAR = 2024
KEYWORD = "harbor 3"
ONE_VIN = "VIN00000000000042"
MONTH = (1997, 5)

# The entry forms' limits, for the queries that check forms.
VEHICLE_LIMITS = {"max_vin_length": schema.MAX_VIN_LENGTH, "max_description_length": schema.MAX_DESCRIPTION_LENGTH}
ORDER_LIMITS = {"max_vin_length": schema.MAX_VIN_LENGTH, "max_parts": schema.MAX_PARTS_PER_ORDER}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE, text arrays joined with "|"."""
    shown = []
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            column = F.array_join(F.array_sort(column), "|")
        shown.append(column.alias(f.name))
    return df.select(*shown)


def _on_tables(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: plain(operator(view.dealership(view.Source(spark, folder))))


def _on_several_deals(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: plain(operator(view.several_deals(view.Source(spark, folder))))


def _on_raw(operator: Callable[[DataFrame], DataFrame], raw: Rows) -> Query:
    return lambda spark, folder: plain(operator(raw(view.Source(spark, folder))))


def _on_other_spellings(operator: Callable[[Tables], DataFrame], faults: Callable[[Tables], Tables] = lambda t: t) -> Query:
    """The operator on tables whose keys come in several spellings."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = faults(view.dealership(view.Source(spark, folder)))
        return plain(operator(respelled(view.with_other_spellings(tables))))

    return run


def _on_batch(operator: Callable[[Tables, DataFrame], DataFrame], batch: Rows) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = view.Source(spark, folder)
        return plain(operator(view.dealership(source), batch(source)))

    return run


def _with_faults(tables: Tables) -> Tables:
    """Planted faults: a model year entered twice, orphaned part lines and colors, and values outside their domains."""
    vehicle, part, color = tables.vehicle, tables.part, tables.vehicle_color
    twice = vehicle.where(F.col("year") == 1999)
    worn = vehicle.withColumn(
        "condition", F.when(F.col("fuel_type") == "Diesel", F.lit("Poor")).otherwise(F.col("condition"))
    )
    lost = part.withColumn(
        "order_number",
        F.when(F.col("status") == "Received", F.concat("order_number", F.lit("-lost"))).otherwise(F.col("order_number")),
    )
    plaid = color.withColumn(
        "color_name", F.when(F.col("color_name") == "Rust", F.lit("Plaid")).otherwise(F.col("color_name"))
    )
    nameless = tables.customer.withColumn("city", F.when(F.col("email").isNotNull(), F.col("city")))
    return tables.with_tables(
        vehicle=worn.unionByName(twice), part=lost, vehicle_color=plaid, customer=nameless
    )


def _options_in_use(tables: Tables) -> Tables:
    """Dimension tables holding what the vehicles really use."""
    return tables.with_tables(
        vehicle_type=lookups.distinct_values(tables, "vehicle", "vehicle_type"),
        manufacturer=lookups.distinct_values(tables, "vehicle", "manufacturer_name"),
        color=lookups.distinct_values(tables, "vehicle_color", "color_name"),
    )


def _search(role: str, **filters: object) -> Query:
    return _on_tables(lambda t: vehicles.search_vehicles(t, role, **filters))


def _ingested_vehicles(part: str) -> Query:
    def operator(tables: Tables, raw: DataFrame) -> DataFrame:
        result = ingest.ingest_vehicles(tables, raw)
        return result.rejects if part == "rejects" else result.rows[part]

    return _on_batch(operator, view.raw_vehicles)


def _batch_part(apply: Callable[[Tables, DataFrame], batches.BatchResult], batch: Rows, part: str) -> Query:
    def operator(tables: Tables, submissions: DataFrame) -> DataFrame:
        result = apply(tables, submissions)
        return result.rejects if part == "rejects" else result.new_rows[part]

    return _on_batch(operator, batch)


def _vehicle_batch(tables: Tables, submissions: DataFrame) -> batches.BatchResult:
    return batches.apply_vehicle_batch(tables, submissions, AS_OF_YEAR)


# Partitions of the stored part table of the test data.
PART_PARTITIONS = 16


def _on_stored_parts(store: Callable[[Tables, DataFrame, str, int], list[int]]) -> Query:
    """The stored part table after a batch replaced the partitions it touches."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = view.Source(spark, folder)
        tables, path = view.dealership(source), new_folder(spark, "part")
        partitioned.write_parts(tables.part, path, PART_PARTITIONS)
        store(tables, view.status_updates(source), path, PART_PARTITIONS)
        return plain(partitioned.read_parts(spark, path))

    return run


# Blocks of the searchable vehicle table of the test data.
VEHICLE_BLOCKS = 48


def _search_in_blocks(keyword: str) -> Query:
    """The keyword search on a vehicle table with three-letter sequences beside it."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables, path = view.dealership(view.Source(spark, folder)), new_folder(spark, "searchable")
        trigrams.write_searchable(tables.vehicle, path, VEHICLE_BLOCKS)
        found = tables.with_tables(vehicle=trigrams.candidates(spark, path, keyword))
        return plain(vehicles.search_vehicles(found, "Manager", keyword=keyword))

    return run


def _placed(df: DataFrame, shown: str, *columns: str) -> DataFrame:
    """The place of each row of a view, with the columns that name the row."""
    titles = VIEWS[shown].titles
    found = display(df, shown, place="place")
    return found.select("place", *[F.col(f"`{titles[c]}`").alias(c) for c in columns])


def _invalid(df: DataFrame) -> DataFrame:
    return df.select("submission_id", "reasons")


def queries() -> dict[str, Query]:
    customers = view.raw_customers
    found: dict[str, Query] = {
        # Search
        "search_vehicles_public": _search("Public"),
        "search_vehicles_salesperson": _search("Salesperson"),
        "search_vehicles_clerk": _search("Inventory clerk"),
        "search_vehicles_manager_all": _search("Manager"),
        "search_vehicles_manager_sold": _search("Owner", vehicle_status="Sold"),
        "search_vehicles_manager_unsold": _search("Manager", vehicle_status="Unsold"),
        "search_by_attributes": _search("Manager", vehicle_type="suv", fuel_type="Hybrid", manufacturer="Any"),
        "search_by_year": _search("Inventory clerk", year=1999),
        "search_by_color": _search("Manager", color="Red"),
        "search_by_color_all_colors": _search("Manager", color="Red", all_colors=True),
        "search_by_keyword": _search("Manager", keyword=KEYWORD),
        "search_by_keyword_wildcard": _search("Manager", keyword="5-low%summit"),
        "search_by_keyword_in_blocks": _search_in_blocks(KEYWORD),
        "search_by_keyword_wildcard_in_blocks": _search_in_blocks("5-low%summit"),
        "search_by_keyword_collated": _search("Manager", keyword="Härbor", accent_insensitive=True),
        "search_by_vin": _on_tables(lambda t: vehicles.search_vehicles(t, "Salesperson", vin=t.parts_order)),
        "search_by_one_vin": _search("Manager", vin=ONE_VIN),
        "asking_price": _on_tables(vehicles.asking_prices),
        "filter_options": _on_tables(lambda t: lookups.filter_options(_options_in_use(t), AS_OF_YEAR)),
        # Joins and per-vehicle facts
        "parts_cost_per_vehicle": _on_tables(inventory.parts_cost_per_vehicle),
        "vehicle_parts": _on_tables(lookups.vehicle_parts),
        "vehicles_without_pending_parts": _on_tables(inventory.vehicles_without_pending_parts),
        "unsold_vehicles": _on_tables(inventory.unsold_vehicles),
        "purchase_details": _on_tables(lookups.purchase_details),
        "purchase_attributes": _on_tables(lookups.purchase_attributes),
        "sale_details": _on_tables(lookups.sale_details),
        "sale_details_one_per_vin": _on_tables(lambda t: lookups.sale_details(t, one_per_vin=True)),
        "sale_attributes": _on_tables(lookups.sale_attributes),
        "vehicle_colors": _on_tables(inventory.vehicle_colors),
        "all_parts_installed": _on_tables(inventory.all_parts_installed),
        "sale_eligibility": _on_tables(inventory.sale_eligibility),
        # Reports and counts
        "seller_history": _on_tables(reports.seller_history),
        "avg_inventory_time": _on_tables(reports.avg_inventory_time),
        "price_per_condition": _on_tables(reports.price_per_condition),
        "parts_statistics": _on_tables(reports.parts_statistics),
        "monthly_sales": _on_tables(reports.monthly_sales),
        "monthly_sales_drilldown": _on_tables(reports.sales_by_salesperson),
        "monthly_sales_drilldown_month": _on_tables(lambda t: reports.monthly_sales_drilldown(t, *MONTH)),
        "count_pending_parts": _on_tables(inventory.count_pending_parts),
        "count_available": _on_tables(inventory.count_available),
        "vehicle_counts": _on_tables(inventory.vehicle_counts),
        "distinct_values": _on_tables(lambda t: lookups.distinct_values(t, "vehicle", "model_name")),
        # Identifiers and pick lists
        "customer_identifiers": _on_tables(lookups.customer_identifiers),
        "customer_lookup": _on_batch(
            lambda t, b: lookups.customer_lookup(t, b.withColumnRenamed("buyer_identifier", "identifier")),
            view.sale_submissions,
        ),
        "list_vendors": _on_tables(lookups.list_vendors),
        "list_dimension_values": _on_tables(lambda t: lookups.list_dimension_values(_options_in_use(t))),
        "seed_dimensions": _on_tables(lookups.dimension_usage),
        # Detail views
        "vehicle_details_public": _on_tables(lambda t: vehicles.vehicle_details(t, "Public")),
        "vehicle_details_manager": _on_tables(lambda t: vehicles.vehicle_details(t, "Manager")),
        "vehicle_details_clerk": _on_tables(lambda t: vehicles.vehicle_details(t, "Inventory clerk")),
        "vehicle_details_unsold": _on_tables(lambda t: vehicles.vehicle_details(t, "Owner", unsold_only=True)),
        "sellable_vehicle": _on_tables(vehicles.sellable_vehicle),
        # Ingest
        "ingest_customers": _on_raw(lambda r: ingest.ingest_customers(r, order_by="line_no").rows["customer"], customers),
        "ingest_customers_individual": _on_raw(
            lambda r: ingest.ingest_customers(r, order_by="line_no").rows["individual_customer"], customers
        ),
        "ingest_customers_business": _on_raw(
            lambda r: ingest.ingest_customers(r, order_by="line_no").rows["business_customer"], customers
        ),
        "assign_customer_ids": _on_raw(
            lambda r: ingest.assign_customer_ids(r, order_by="line_no", start=1000).select(
                "line_no", "customer_type", "customer_id"
            ),
            customers,
        ),
        "ingest_users": _on_raw(lambda r: ingest.ingest_users(r).rows["user"], view.raw_users),
        "ingest_vendors": _on_raw(lambda r: ingest.ingest_vendors(r).rows["vendor"], view.raw_vendors),
        "ingest_vehicles": _ingested_vehicles("vehicle"),
        "ingest_vehicle_purchases": _ingested_vehicles("purchase"),
        "ingest_vehicle_colors": _ingested_vehicles("vehicle_color"),
        "ingest_vehicle_sales": _ingested_vehicles("sale"),
        "ingest_vehicle_rejects": _ingested_vehicles("rejects"),
        "ingest_parts": _on_raw(lambda r: ingest.ingest_parts(r).rows["part"], view.raw_parts),
        "ingest_parts_orders": _on_raw(lambda r: ingest.ingest_parts(r).rows["parts_order"], view.raw_parts),
        "order_total_cost": _on_tables(lambda t: ingest.order_total_cost(t.part)),
        "resolve_customer_id": _on_batch(
            lambda t, raw: ingest.resolve_customer_id(t, raw, "purchased_from_customer", "VIN").select(
                "VIN", "purchased_from_customer", "customer_id"
            ),
            view.raw_vehicles,
        ),
        # Batches
        "apply_vehicle_batch": _batch_part(_vehicle_batch, view.vehicle_submissions, "vehicle"),
        "apply_vehicle_batch_colors": _batch_part(_vehicle_batch, view.vehicle_submissions, "vehicle_color"),
        "apply_vehicle_batch_purchases": _batch_part(_vehicle_batch, view.vehicle_submissions, "purchase"),
        "apply_vehicle_batch_rejects": _batch_part(_vehicle_batch, view.vehicle_submissions, "rejects"),
        "apply_customer_batch": _batch_part(batches.apply_customer_batch, view.customer_submissions, "customer"),
        "apply_customer_batch_individual": _batch_part(
            batches.apply_customer_batch, view.customer_submissions, "individual_customer"
        ),
        "apply_customer_batch_business": _batch_part(
            batches.apply_customer_batch, view.customer_submissions, "business_customer"
        ),
        "apply_customer_batch_rejects": _batch_part(batches.apply_customer_batch, view.customer_submissions, "rejects"),
        "apply_vendor_batch": _batch_part(batches.apply_vendor_batch, view.vendor_submissions, "vendor"),
        "apply_vendor_batch_rejects": _batch_part(batches.apply_vendor_batch, view.vendor_submissions, "rejects"),
        "apply_parts_orders": _batch_part(batches.apply_parts_orders, view.parts_order_submissions, "parts_order"),
        "apply_parts_orders_parts": _batch_part(batches.apply_parts_orders, view.parts_order_submissions, "part"),
        "apply_parts_orders_rejects": _batch_part(batches.apply_parts_orders, view.parts_order_submissions, "rejects"),
        "apply_status_updates": _on_batch(batches.apply_status_updates, view.status_updates),
        "apply_status_updates_results": _on_batch(batches.status_update_results, view.status_updates),
        "apply_status_transitions": _on_batch(batches.apply_status_transitions, view.status_updates),
        "apply_status_transitions_results": _on_batch(batches.status_transition_results, view.status_updates),
        "store_status_updates": _on_stored_parts(partitioned.store_status_updates),
        "store_status_transitions": _on_stored_parts(partitioned.store_status_transitions),
        "apply_sales": _batch_part(batches.apply_sales, view.sale_submissions, "sale"),
        "apply_sales_rejects": _batch_part(batches.apply_sales, view.sale_submissions, "rejects"),
        # Data quality
        "check_primary_keys": _on_tables(lambda t: quality.check_primary_keys(_with_faults(t))),
        "check_foreign_keys": _on_tables(lambda t: quality.check_foreign_keys(_with_faults(t))),
        "check_domains": _on_tables(lambda t: quality.check_domains(_with_faults(t))),
        "validate_submissions": _on_raw(
            lambda r: _invalid(quality.validate_submissions(r, quality.vehicle_rules(AS_OF_YEAR, **VEHICLE_LIMITS))),
            view.vehicle_submissions,
        ),
        "validate_customer_submissions": _on_raw(
            lambda r: _invalid(quality.validate_submissions(r, quality.customer_rules())), view.customer_submissions
        ),
        "validate_vendor_submissions": _on_raw(
            lambda r: _invalid(quality.validate_submissions(r, quality.vendor_rules())), view.vendor_submissions
        ),
        "validate_parts_order_submissions": _on_raw(
            lambda r: _invalid(quality.validate_submissions(r, quality.parts_order_rules(**ORDER_LIMITS))),
            view.parts_order_submissions,
        ),
    }
    found |= {
        # Raw files with faults: what is loaded and what is refused
        "ingest_faulty_customers": _on_raw(
            lambda r: ingest.ingest_customers(r, order_by="line_no").rows["customer"].drop("customer_id"),
            view.faulty_raw_customers,
        ),
        "ingest_customers_rejects": _on_raw(
            lambda r: ingest.ingest_customers(r, order_by="line_no").rejects.drop("customer_id"), view.faulty_raw_customers
        ),
        "ingest_faulty_users": _on_raw(lambda r: ingest.ingest_users(r).rows["user"], view.faulty_raw_users),
        "ingest_users_rejects": _on_raw(lambda r: ingest.ingest_users(r).rejects, view.faulty_raw_users),
        "ingest_faulty_vendors": _on_raw(lambda r: ingest.ingest_vendors(r).rows["vendor"], view.faulty_raw_vendors),
        "ingest_vendors_rejects": _on_raw(lambda r: ingest.ingest_vendors(r).rejects, view.faulty_raw_vendors),
        "ingest_faulty_vehicles": _on_batch(
            lambda t, r: ingest.ingest_vehicles(t, r).rows["vehicle"], view.faulty_raw_vehicles
        ),
        "ingest_vehicles_rejects": _on_batch(
            lambda t, r: ingest.ingest_vehicles(t, r).rejects, view.faulty_raw_vehicles
        ),
        "ingest_faulty_parts": _on_raw(lambda r: ingest.ingest_parts(r).rows["part"], view.faulty_raw_parts),
        "ingest_parts_rejects": _on_raw(lambda r: ingest.ingest_parts(r).rejects, view.faulty_raw_parts),
    }
    # The same operators where vehicles have several purchases and sales
    several: dict[str, Callable[[Tables], DataFrame]] = {
        "search_public": lambda t: vehicles.search_vehicles(t, "Public"),
        "search_clerk": lambda t: vehicles.search_vehicles(t, "Inventory clerk"),
        "search_manager_all": lambda t: vehicles.search_vehicles(t, "Manager"),
        "search_manager_sold": lambda t: vehicles.search_vehicles(t, "Manager", vehicle_status="Sold"),
        "sellable_vehicle": vehicles.sellable_vehicle,
        "vehicle_counts": inventory.vehicle_counts,
        "seller_history": reports.seller_history,
        "avg_inventory_time": reports.avg_inventory_time,
        "price_per_condition": reports.price_per_condition,
        "monthly_sales": reports.monthly_sales,
        "monthly_sales_drilldown": reports.sales_by_salesperson,
        "purchase_details": lookups.purchase_details,
        "sale_details": lookups.sale_details,
        "sale_details_one_per_vin": lambda t: lookups.sale_details(t, one_per_vin=True),
        "customer_identifiers": lookups.customer_identifiers,
    }
    found |= {f"several_deals_{name}": _on_several_deals(operator) for name, operator in several.items()}
    # What people see: titles, currency text and, for reports of a bounded number of rows, the order
    found |= {
        "display_seller_history": _on_tables(lambda t: display(reports.seller_history(t), "seller_history")),
        "display_sellable_vehicle": _on_tables(lambda t: display(vehicles.sellable_vehicle(t), "sellable_vehicle")),
        "display_purchase_details": _on_tables(lambda t: display(lookups.purchase_details(t), "purchase_details")),
        "display_sale_details": _on_tables(lambda t: display(lookups.sale_details(t), "sale_details")),
        "display_parts_statistics": _on_tables(lambda t: display(reports.parts_statistics(t), "parts_statistics")),
        "display_monthly_sales": _on_tables(
            lambda t: display(reports.monthly_sales(t), "monthly_sales", place="place")
        ),
        "display_price_per_condition": _on_tables(
            lambda t: display(reports.price_per_condition(t), "price_per_condition", place="place")
        ),
        "display_avg_inventory_time": _on_several_deals(
            lambda t: display(reports.avg_inventory_time(t), "avg_inventory_time", place="place")
        ),
    }
    # The order of long reports, as each row's place in it
    found |= {
        "ordered_search": _on_tables(lambda t: _placed(vehicles.search_vehicles(t, "Public"), "search", "vin")),
        "ordered_seller_history": _on_tables(
            lambda t: _placed(reports.seller_history(t), "seller_history", "seller_name")
        ),
        "ordered_parts_statistics": _on_tables(
            lambda t: _placed(reports.parts_statistics(t), "parts_statistics", "vendor_name")
        ),
        "ordered_monthly_sales_drilldown": _on_tables(
            lambda t: _placed(reports.monthly_sales_drilldown(t, *MONTH), "monthly_sales_drilldown", "first_name", "last_name")
        ),
    }
    # Keys in capitals, small letters and with accents: the same answers as if they were spelled alike
    found |= {
        "collated_search": _on_other_spellings(lambda t: vehicles.search_vehicles(t, "Manager", vehicle_type="Súv", fuel_type="hybrid")),
        "collated_parts_statistics": _on_other_spellings(reports.parts_statistics),
        "collated_monthly_sales_drilldown": _on_other_spellings(reports.sales_by_salesperson),
        "collated_distinct_makers": _on_other_spellings(lambda t: lookups.distinct_values(t, "vehicle", "manufacturer_name")),
        "collated_vehicle_colors": _on_other_spellings(inventory.vehicle_colors),
        "collated_check_primary_keys": _on_other_spellings(quality.check_primary_keys, _with_faults),
        "collated_check_foreign_keys": _on_other_spellings(quality.check_foreign_keys, _with_faults),
    }
    # A fault for every declared key and reference, and for every rule of a parts order
    found |= {
        "check_primary_keys_all": _on_tables(lambda t: quality.check_primary_keys(view.with_rows_twice(t))),
        "check_foreign_keys_all": _on_tables(lambda t: quality.check_foreign_keys(view.with_lost_references(t))),
        "validate_parts_order_submissions_faulty": _on_raw(
            lambda r: _invalid(quality.validate_submissions(r, quality.parts_order_rules(**ORDER_LIMITS))),
            view.faulty_parts_orders,
        ),
    }
    return found
