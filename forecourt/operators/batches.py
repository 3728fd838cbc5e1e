"""Batches of submissions applied to the current tables.

A submission is accepted whole or rejected whole: one frame of judged submissions feeds every output.
Existing tables are never changed in place; a result carries new rows, or the next snapshot of a table.
Submissions carry a 64-bit `submission_id`; one without an id, or with an id that another one has too, is rejected, so
accepted and rejected submissions always add up.  Where two compete, the lower id wins.
The judged submissions are stored once (`functions.lineage.pin`), so that the several outputs of a result do not judge
them again; with `pinned=False` everything stays lazy and each output judges anew.  Of parts orders the parts are stored
beside, before they are judged, and are joined only to accepted orders.  Tables are reduced to the vehicles of
the batch before anything is aggregated or joined, so the work follows the batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schema
from forecourt.functions.joins import first_per_key, keys_of, lookup, lookup_and_minima, lookup_by_counts, mark, mark_rows
from forecourt.functions.lineage import pin
from forecourt.functions.money import asking_price
from forecourt.functions.numbering import number_rows
from forecourt.functions.text import order_number
from forecourt.operators import quality
from forecourt.operators.inventory import pending_vins
from forecourt.operators.lookups import first_customer_per_identifier
from forecourt.operators.roles import resolve_role
from forecourt.tables import Tables


@dataclass(frozen=True)
class BatchResult:
    """New rows per table, and the rejected submissions with their reasons."""

    new_rows: Mapping[str, DataFrame]
    rejects: DataFrame

    def next_tables(self, tables: Tables) -> Tables:
        return tables.appended(**self.new_rows)


def _add_reason(df: DataFrame, name: str, broken: Column) -> DataFrame:
    added = F.when(F.coalesce(broken, F.lit(True)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("reasons", F.concat("reasons", added))


def _fine() -> Column:
    return F.size("reasons") == 0


ID = "submission_id"


def _judge_ids(df: DataFrame) -> DataFrame:
    """Reject submissions without an id and those that share one."""
    shared = df.where(F.col(ID).isNotNull()).groupBy(ID).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # An id, or none, that very many submissions have is cut by the rest of the row.
    rest = [c for c in df.columns if c not in (ID, "reasons")]
    marked = lookup_by_counts(df, shared.select(ID, F.lit(True).alias("_shared")), ID, rest)
    marked = _add_reason(marked, "missing_submission_id", F.col(ID).isNull())
    return _add_reason(marked, "repeated_submission_id", F.col("_shared").isNotNull()).drop("_shared")


def _keep_first(df: DataFrame, key: str, reason: str, base: DataFrame) -> DataFrame:
    """Of the fine submissions with one key, the first stays fine; the others are rejected for `reason`."""
    decided = first_per_key(df, key, ID, _fine(), "_first_of_key", base)
    later = _fine() & ~F.col("_first_of_key")
    return _add_reason(decided, reason, later).drop("_first_of_key")


def _one_new_per_key(df: DataFrame, key: str, existing: DataFrame, exists: str, repeated: str) -> DataFrame:
    """Reject a key that `existing` has already, and all but the first fine submission of a new key.

    Both facts are gathered per key first, so the submissions are joined once.
    """
    facts = df.groupBy(key).agg(F.min(F.when(_fine(), F.col("submission_id"))).alias("_first"))
    facts = mark(facts, existing, key, "_taken")
    judged = lookup(df, facts, key, ID)
    later = _fine() & ~F.coalesce(F.col("_first") == F.col("submission_id"), F.lit(False))
    taken = F.coalesce("_taken", F.lit(False))
    judged = judged.withColumn("_later", later & ~taken)
    judged = _add_reason(_add_reason(judged, exists, taken), repeated, F.col("_later"))
    return judged.drop("_first", "_taken", "_later")


def _split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.where(_fine()), judged.where(~_fine()).select("submission_id", "reasons")


def _with_customer(tables: Tables, df: DataFrame, identifier: str, base: DataFrame) -> DataFrame:
    people = first_customer_per_identifier(tables).withColumnRenamed("identifier", identifier)
    return lookup(df, people, identifier, ID, base)


def _require(df: DataFrame, keys: DataFrame, column: str, reason: str) -> DataFrame:
    """Reject submissions whose `column` does not occur in `keys`, the distinct keys of a dimension table.

    A plain join: Spark's own size check broadcasts a small dimension, and then a hot value costs nothing.
    """
    marked = df.join(keys.withColumn("_known", F.lit(True)), column, "left")
    return _add_reason(marked, reason, F.col("_known").isNull()).drop("_known")


def apply_vehicle_batch(
    tables: Tables, submissions: DataFrame, as_of_year: int, *, pinned: bool = True
) -> BatchResult:
    """New vehicles with their colors and purchase.

    Columns: submission_id, the vehicle columns, colors (text array), username, seller_identifier,
    purchase_price, purchased_on.
    """
    judged = _judge_ids(quality.validate_submissions(submissions, quality.vehicle_rules(as_of_year)))
    for table, column, reason in (
        ("vehicle_type", "vehicle_type", "unknown_vehicle_type"),
        ("manufacturer", "manufacturer_name", "unknown_manufacturer"),
        ("user", "username", "unknown_user"),
    ):
        judged = _require(judged, keys_of(tables[table], column), column, reason)
    taken = keys_of(_of_batch(tables.vehicle, keys_of(submissions, "vin")), "vin")
    judged = mark_rows(judged, taken, "vin", "_taken", ID, submissions)
    judged = _add_reason(judged, "vin_exists", F.col("_taken")).drop("_taken")
    judged = _with_customer(tables, judged, "seller_identifier", submissions)
    judged = _add_reason(judged, "unknown_seller", F.col("customer_id").isNull())

    wanted = submissions.select("submission_id", F.explode("colors").alias("color_name"))
    strange = keys_of(wanted.join(keys_of(tables.color, "color_name"), "color_name", "left_anti"), "submission_id")
    judged = mark(judged, strange, "submission_id", "_strange")
    judged = _add_reason(judged, "unknown_color", F.col("_strange")).drop("_strange")

    judged = pin(judged) if pinned else judged
    accepted, rejects = _split(_keep_first(judged, "vin", "vin_repeated_in_batch", submissions))
    vehicle = accepted.select(*schema.SCHEMAS["vehicle"].names)
    color = accepted.select("vin", F.explode(F.array_distinct("colors")).alias("color_name"))
    purchase = accepted.select(*schema.SCHEMAS["purchase"].names)
    return BatchResult({"vehicle": vehicle, "vehicle_color": color, "purchase": purchase}, rejects)


def apply_customer_batch(tables: Tables, submissions: DataFrame, *, pinned: bool = True) -> BatchResult:
    """New customers of both kinds, with ids continuing after the highest existing one.

    Columns: submission_id, customer_type ("Individual" or "Business"), email, phone_number, address,
    and the columns of the individual or business kind.
    """
    judged = _judge_ids(quality.validate_submissions(submissions, quality.customer_rules()))
    business = F.col("customer_type") == "Business"
    judged = judged.withColumn(
        "_identity",
        F.when(business, F.concat(F.lit("B:"), "tax_identification_number")).otherwise(
            F.concat(F.lit("I:"), "social_security_number")
        ),
    )
    people = tables.individual_customer.select(F.concat(F.lit("I:"), "social_security_number").alias("_identity"))
    firms = tables.business_customer.select(F.concat(F.lit("B:"), "tax_identification_number").alias("_identity"))
    known = keys_of(people.unionByName(firms), "_identity")
    judged = _one_new_per_key(judged, "_identity", known, "identifier_exists", "identifier_repeated_in_batch")
    accepted, rejects = _split(pin(judged) if pinned else judged)

    highest = tables.customer.agg(F.coalesce(F.max("customer_id"), F.lit(0)).alias("highest")).scalar()
    numbered = number_rows(accepted, "submission_id", name="_n").withColumn("customer_id", F.col("_n") + highest)
    kinds = {
        "customer": numbered,
        "individual_customer": numbered.where(F.col("customer_type") == "Individual"),
        "business_customer": numbered.where(F.col("customer_type") == "Business"),
    }
    return BatchResult(
        {table: rows.select(*schema.SCHEMAS[table].names) for table, rows in kinds.items()}, rejects
    )


def apply_vendor_batch(tables: Tables, submissions: DataFrame, *, pinned: bool = True) -> BatchResult:
    """New vendors; a name that exists, or repeats in the batch, is rejected.

    Columns: submission_id and the vendor columns.
    """
    trimmed = submissions.withColumns({c: F.trim(c) for c in schema.SCHEMAS["vendor"].names})
    judged = _judge_ids(quality.validate_submissions(trimmed, quality.vendor_rules()))
    judged = _one_new_per_key(judged, "name", keys_of(tables.vendor, "name"), "name_exists", "name_repeated_in_batch")
    accepted, rejects = _split(pin(judged) if pinned else judged)
    return BatchResult({"vendor": accepted.select(*schema.SCHEMAS["vendor"].names)}, rejects)


def _of_batch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose vehicle occurs in the batch."""
    return rows.join(wanted, "vin", "left_semi")


def _read_apart(orders: DataFrame) -> DataFrame:
    """(vin, _seq) of the order numbers that have the usual form."""
    shape = r"^(.*)-(\d+)$"
    used = orders.select(
        "order_number",
        F.regexp_extract("order_number", shape, 1).alias("vin"),
        F.regexp_extract("order_number", shape, 2).try_cast("bigint").alias("_seq"),
    )
    return used.where(F.col("order_number") == order_number(F.col("vin"), F.col("_seq"))).select("vin", "_seq")


def _order_counts(tables: Tables, wanted: DataFrame) -> DataFrame:
    """(vin, _existing, _taken): orders a vehicle has, and the first number beyond that count already in use."""
    orders = tables.parts_order.select("vin", "order_number")
    of_batch = _of_batch(orders, wanted)
    existing = of_batch.groupBy("vin").agg(F.count(F.lit(1)).alias("_existing"))
    # Nearly every number begins with its order's own VIN; only of the others are all read apart.
    own = F.startswith("order_number", F.concat("vin", F.lit("-")))
    used = _read_apart(of_batch.where(own)).unionByName(_of_batch(_read_apart(orders.where(~own)), wanted))
    beyond = lookup_by_counts(used, existing, "vin", "_seq").where(F.col("_seq") > F.coalesce("_existing", F.lit(0)))
    return existing.join(beyond.groupBy("vin").agg(F.min("_seq").alias("_taken")), "vin", "full")


def _order_cost() -> Column:
    """Sum over the parts; NULL if it does not even fit 24 digits."""
    return F.aggregate(
        "parts",
        F.lit(0).cast("decimal(24,2)"),
        lambda total, p: F.try_add(total, F.try_multiply(p["unit_price"], p["quantity"])).try_cast("decimal(24,2)"),
    )


def apply_parts_orders(tables: Tables, submissions: DataFrame, *, pinned: bool = True) -> BatchResult:
    """New parts orders with their part lines; a sold or unknown vehicle is rejected.

    Columns: submission_id, vin, vendor_name, parts (array of part_description, vendor_part_number,
    unit_price, quantity, part_status).  The order number continues from the vehicle's order count.  If
    that number is already taken, the order fails without advancing the count, and so do all later ones of
    the vehicle in this batch.
    """
    trimmed = submissions.select(ID, F.trim("vin").alias("vin"), F.trim("vendor_name").alias("vendor_name"), "parts")
    trimmed = pin(trimmed) if pinned else trimmed
    checked = quality.validate_submissions(trimmed, quality.parts_order_rules())
    # The parts stay where they are until their order has a number: what the judgement needs of them is small.
    narrow = checked.select(
        ID,
        "vin",
        "vendor_name",
        "reasons",
        F.round(_order_cost(), 2).try_cast(schema.MONEY).alias("_total"),
        F.exists("parts", lambda p: p["quantity"].try_cast("int").isNull()).alias("_uncountable"),
        F.xxhash64("parts").alias("_parts_hash"),
    )
    judged = _judge_ids(narrow).drop("_parts_hash")
    judged = _add_reason(judged, "quantity_out_of_range", _fine() & F.col("_uncountable")).drop("_uncountable")
    judged = _add_reason(judged, "total_out_of_range", _fine() & F.col("_total").isNull())
    vendors = keys_of(tables.vendor.withColumnRenamed("name", "vendor_name"), "vendor_name")
    judged = _require(judged, vendors, "vendor_name", "unknown_vendor")
    wanted = keys_of(trimmed, "vin")
    sold = keys_of(_of_batch(tables.sale, wanted), "vin")
    on_sale = keys_of(_of_batch(tables.vehicle, wanted), "vin").join(sold, "vin", "left_anti")
    facts = on_sale.withColumn("_on_sale", F.lit(True)).join(_order_counts(tables, wanted), "vin", "left")
    judged = lookup_by_counts(judged, facts, "vin", ID, trimmed)
    judged = _add_reason(judged, "sold_or_unknown_vehicle", F.col("_on_sale").isNull())
    judged = pin(judged) if pinned else judged

    # Only ids and VINs are numbered; refused rows have no number.
    numbers = number_rows(judged.where(_fine()).select(ID, "vin"), ID, ["vin"], "_n").select(ID, "_n")
    # Ids of accepted submissions are unique; the others, among them those without an id, take no part in the join.
    refused = judged.where(~_fine()).withColumn("_n", F.lit(None).cast("bigint"))
    numbered = judged.where(_fine()).join(numbers, ID).unionByName(refused)
    sequence = F.coalesce("_existing", F.lit(0)) + F.col("_n")
    numbered = numbered.withColumn("order_number", order_number(F.col("vin"), sequence))
    numbered = _add_reason(numbered, "order_number_exists", F.coalesce(sequence >= F.col("_taken"), F.lit(False)))
    accepted, rejects = _split(numbered)
    orders = accepted.select("vin", "vendor_name", "order_number", F.col("_total").alias("total_cost"))
    # Accepted submissions have an id of their own.
    ordered = trimmed.select(ID, "parts").join(accepted.select(ID, "order_number"), ID)
    parts = ordered.select("order_number", F.explode("parts").alias("_p")).select(
        "order_number",
        F.coalesce(F.trim("_p.vendor_part_number"), F.lit("")).alias("vendor_parts_number"),
        F.trim("_p.part_description").alias("description"),
        F.col("_p.quantity").cast("int").alias("quantity"),
        F.col("_p.part_status").alias("status"),
        F.col("_p.unit_price").cast(schema.MONEY).alias("unit_price"),
    )
    return BatchResult({"parts_order": orders, "part": parts}, rejects)


PART_KEY = ["order_number", "vendor_parts_number"]


# Updates of one part whose seq agrees but for so many bits meet in one task before the others.
SEQ_BLOCK_BITS = 12


def latest_status(updates: DataFrame) -> DataFrame:
    """The part key and `_new`, the status of its last valid update: a maximum of (seq, status), which Spark sorts for.

    The stage that makes the updates may hold very many in a task, so they are dealt out before they are sorted, in
    `spark.sql.shuffle.partitions` pieces.  A part with very many updates is dealt out by blocks of seq, and what a block
    leaves of it combines after that.
    """
    named = F.col("order_number").isNotNull() & F.col("vendor_parts_number").isNotNull()
    valid = updates.where(F.col("new_status").isin(*schema.PART_STATUSES) & named)
    whole = isinstance(updates.select("seq").schema[0].dataType, T.IntegralType)
    block = F.shiftright(F.col("seq").cast("bigint"), SEQ_BLOCK_BITS) if whole else F.col("seq")
    pieces = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = valid.repartition(pieces, *PART_KEY, block)
    return dealt.groupBy(*PART_KEY).agg(F.max(F.struct("seq", "new_status"))["new_status"].alias("_new"))


def apply_status_updates(tables: Tables, updates: DataFrame) -> DataFrame:
    """Next snapshot of the part table: the last update of each part wins, whatever the move.

    Columns of `updates`: order_number, vendor_parts_number, new_status, seq.
    """
    changed = with_latest_status(tables.part.join(latest_status(updates), PART_KEY, "left"))
    return changed.select(*schema.SCHEMAS["part"].names)


def with_latest_status(parts: DataFrame) -> DataFrame:
    """Parts beside their `latest_status`, if there is one, as the batch leaves them."""
    return parts.withColumn("status", F.coalesce("_new", "status"))


def status_update_results(tables: Tables, updates: DataFrame) -> DataFrame:
    """Every update with `matched`: did it name an existing part and a valid status?"""
    known = tables.part.select(*PART_KEY).distinct()
    marked = lookup_by_counts(updates, known.withColumn("_known", F.lit(True)), PART_KEY, "seq")
    matched = F.col("_known").isNotNull() & F.coalesce(F.col("new_status").isin(*schema.PART_STATUSES), F.lit(False))
    return marked.withColumn("matched", matched).drop("_known")


def _seq_of_move(status: str) -> Column:
    return F.when(F.col("new_status") == status, F.col("seq"))


def _with_moves(parts: DataFrame, status_col: str = "status") -> DataFrame:
    """Add the seq of the updates that move a part, from its status and the first seq of either move.

    Legal moves only go forward, so of any ordered list of updates at most two take effect: the first
    "Installed" (unless the part is installed already), and the first "Received" if the part is "Ordered"
    and nothing installs it earlier.  Two minima per part therefore replace replaying the list.
    """
    status = F.col(status_col)
    installs = F.when(status != "Installed", F.col("_installed"))
    receives = F.when(
        (status == "Ordered") & (F.col("_installed").isNull() | (F.col("_received") < F.col("_installed"))),
        F.col("_received"),
    )
    return parts.withColumns({"_install_at": installs, "_receive_at": receives})


FIRST_MOVES = {"_received": "Received", "_installed": "Installed"}


def apply_status_transitions(tables: Tables, updates: DataFrame) -> DataFrame:
    """Next snapshot of the part table after the legal moves, applied in `seq` order per part (seq unique per part)."""
    moved = with_moved_status(tables.part.join(first_moves(updates), PART_KEY, "left"))
    return moved.select(*schema.SCHEMAS["part"].names)


def first_moves(updates: DataFrame) -> DataFrame:
    """The part key and the first seq of either move."""
    return updates.groupBy(*PART_KEY).agg(*[F.min(_seq_of_move(move)).alias(c) for c, move in FIRST_MOVES.items()])


def with_moved_status(parts: DataFrame) -> DataFrame:
    """Parts beside their `first_moves`, if there are any, as the batch leaves them."""
    status = (
        F.when(F.col("_install_at").isNotNull(), F.lit("Installed"))
        .when(F.col("_receive_at").isNotNull(), F.lit("Received"))
        .otherwise(F.col("status"))
    )
    return _with_moves(parts).withColumn("status", status)


def status_transition_results(tables: Tables, updates: DataFrame) -> DataFrame:
    """Every update with `applied`: was it a legal move of a known part at its turn?"""
    before = tables.part.select(*PART_KEY, F.col("status").alias("_status"))
    firsts = {c: _seq_of_move(move) for c, move in FIRST_MOVES.items()}
    moves = _with_moves(lookup_and_minima(updates, before, PART_KEY, "seq", firsts), "_status")
    seq, new = F.col("seq"), F.col("new_status")
    applied = ((new == "Installed") & (seq == F.col("_install_at"))) | (
        (new == "Received") & (seq == F.col("_receive_at"))
    )
    applied = F.coalesce(applied, F.lit(False))
    return moves.withColumn("applied", applied).drop("_status", *FIRST_MOVES, "_install_at", "_receive_at")


def sale_prices(tables: Tables) -> DataFrame:
    """(vin, sale_price): asking price per purchased vehicle, from its earliest purchase."""
    earliest = F.min(F.struct("purchased_on", "username", "customer_id", "purchase_price"))
    bought = tables.purchase.groupBy("vin").agg(earliest["purchase_price"].alias("_paid"))
    cost = tables.parts_order.groupBy("vin").agg(F.sum("total_cost").alias("_parts"))
    return bought.join(cost, "vin", "left").select("vin", asking_price(F.col("_paid"), F.col("_parts")).alias("sale_price"))


def apply_sales(
    tables: Tables, submissions: DataFrame, *, seller_roles: Sequence[str] | None = None, pinned: bool = True
) -> BatchResult:
    """New sales at the asking price: the vehicle is unsold, nothing is pending, buyer and seller are known.

    Columns: submission_id, vin, buyer_identifier, username, sold_on.  One sale per vehicle and batch.  With
    `seller_roles`, such as ["Owner"], a user of another role may not sell.
    """
    rules = [
        *quality.required("vin", "buyer_identifier", "username"),
        ("missing_sold_on", F.col("sold_on").isNull()),
    ]
    judged = _judge_ids(submissions.withColumn("reasons", quality.reasons(rules)))
    # One row of facts per vehicle of the batch, then a single join of the submissions.
    wanted = keys_of(submissions, "vin")
    current = tables.with_tables(
        **{name: _of_batch(tables[name], wanted) for name in ("vehicle", "sale", "purchase", "parts_order")}
    )
    # Of the part lines, those of the batch's orders alone.
    orders = keys_of(current.parts_order, "order_number")
    current = current.with_tables(part=tables.part.join(orders, "order_number", "left_semi"))
    facts = mark(keys_of(current.vehicle, "vin"), keys_of(current.sale, "vin"), "vin", "_sold")
    facts = mark(facts, pending_vins(current), "vin", "_waiting").join(sale_prices(current), "vin", "left")
    judged = lookup(judged, facts, "vin", ID, submissions)
    known = F.col("_sold").isNotNull()
    judged = _add_reason(judged, "unknown_vehicle", ~known)
    judged = _add_reason(judged, "already_sold", known & F.col("_sold"))
    judged = _add_reason(judged, "parts_pending", known & F.col("_waiting"))
    judged = _add_reason(judged, "no_price", known & F.col("sale_price").isNull()).drop("_sold", "_waiting")
    too_high = F.col("sale_price").isNotNull() & F.col("sale_price").try_cast(schema.MONEY).isNull()
    judged = _add_reason(judged, "price_out_of_range", too_high)
    judged = _require(judged, keys_of(tables.user, "username"), "username", "unknown_user")
    if seller_roles is not None:
        sellers = tables.user.where(F.col("role").isin(*[resolve_role(r) for r in seller_roles]))
        judged = _require(judged, keys_of(sellers, "username"), "username", "user_may_not_sell")
    judged = _with_customer(tables, judged, "buyer_identifier", submissions)
    judged = _add_reason(judged, "unknown_buyer", F.col("customer_id").isNull())
    judged = pin(judged) if pinned else judged
    accepted, rejects = _split(_keep_first(judged, "vin", "vin_repeated_in_batch", submissions))
    sale = accepted.withColumn("sale_price", F.col("sale_price").cast(schema.MONEY))
    return BatchResult({"sale": sale.select(*schema.SCHEMAS["sale"].names)}, rejects)
