"""Keys that differ in case or accents only are one key: `KIA`, `Kia` and `Kía` are one manufacturer.

Keys are stored as bytes, and joins, grouping and pushed filters on bytes are what Spark does fastest.  So the collation is
applied once, to the tables, instead of in every comparison: `respelled` gives each key the spelling its parent table has,
and then every operator, join and check of this library folds case and accents.  Comparison is by Spark's collation
UNICODE_CI_AI; printable ASCII values, where that is the same, by their small letters.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schema
from forecourt.functions.lineage import pin
from forecourt.tables import Tables

COLLATION = "UNICODE_CI_AI"


def collated(column: Column) -> Column:
    """The column, compared without regard to case and accents."""
    return F.collate(column, COLLATION)


def _key_domains() -> tuple[tuple[tuple[str, str], ...], ...]:
    """Text columns that hold the same keys; the first one, the parent's, decides the spelling."""
    text = {(t, f.name) for t, columns in schema.SCHEMAS.items() for f in columns if f.dataType == T.StringType()}
    found: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for ref in schema.FOREIGN_KEYS:
        if (ref.parent, ref.parent_column) in text:
            found.setdefault((ref.parent, ref.parent_column), []).append((ref.table, ref.column))
    held = {*found, *(c for children in found.values() for c in children)}
    for table, columns in schema.UNIQUE_KEYS.values():
        for column in columns:
            if (table, column) in text - held:
                found.setdefault((table, column), [])
    return tuple((parent, *children) for parent, children in found.items())


KEY_DOMAINS = _key_domains()


def _printable(value: Column) -> Column:
    """Only ASCII letters, digits, signs and spaces: under COLLATION such texts are equal when their small letters are."""
    return ~value.rlike(r"[^\x20-\x7E]")


def _class_keys(values: DataFrame, odd: DataFrame) -> DataFrame:
    """`values` with `key`, equal for the spellings of one key: plain bytes, so grouping never calls the collation.

    `odd` are the stored values with other letters than `_printable` ones.  The collation is asked for these and, if there
    are any, once per other value; where there are none, small letters decide.
    """
    plain = values.where(_printable(F.col("value"))).withColumn("key", F.lower("value"))
    if odd.isEmpty():
        return plain
    # The name of a class with odd spellings is one of these, which no printable key equals.
    classes = odd.groupBy(collated(F.col("value")).alias("folded")).agg(F.min("value").alias("class"))
    named = values.where(~_printable(F.col("value"))).join(classes, collated(F.col("value")) == F.col("folded"))
    named = named.select(*values.columns, F.col("class").alias("key"))
    plain = plain.join(classes, collated(F.col("value")) == F.col("folded"), "left")
    return plain.select(*values.columns, F.coalesce("class", "key").alias("key")).unionByName(named)


def other_spellings(tables: Tables, domain: tuple[tuple[str, str], ...]) -> DataFrame:
    """(value, spelling): the values of one domain that another spelling stands for, one row each.

    The parent's spelling stands for all; of several, and among values the parent does not have, one without accents, and
    of these the last in byte order.
    """
    used = [
        tables[table].select(F.col(column).alias("value"), F.lit(place == 0).alias("own"))
        for place, (table, column) in enumerate(domain)
    ]
    each = reduce(DataFrame.unionByName, used).where(F.col("value").isNotNull())
    odd = pin(each.where(~_printable(F.col("value"))).select("value").distinct())
    values = each.groupBy("value").agg(F.max("own").alias("own"))
    keyed = _class_keys(values, odd)
    ascii_only = (F.octet_length("value") == F.char_length("value")).alias("ascii")
    best = F.max(F.struct("own", ascii_only, "value"))["value"].alias("spelling")
    spelled = keyed.groupBy("key").agg(best, F.collect_set("value").alias("_values")).where(F.size("_values") > 1)
    found = spelled.select(F.explode("_values").alias("value"), "spelling")
    return found.where(F.col("value") != F.col("spelling"))


def respelled(tables: Tables) -> Tables:
    """The same tables, with every key of `KEY_DOMAINS` in the one spelling that stands for it.

    Rows are neither added nor removed.  The spellings of a domain that change, usually few, are found when one of its tables
    is first asked for, and stored once (`functions.lineage.pin`): their size is then known to the planner, which broadcasts
    them where they are small.
    """
    of_column = {column: domain for domain in KEY_DOMAINS for column in domain}
    stored: dict[tuple[tuple[str, str], ...], DataFrame] = {}

    def build(name: str) -> DataFrame:
        rows = tables[name]
        for column in schema.SCHEMAS[name].names:
            domain = of_column.get((name, column))
            if domain:
                if domain not in stored:
                    stored[domain] = pin(other_spellings(tables, domain))
                changes = stored[domain].toDF(column, "_spelling")
                rows = rows.join(changes, column, "left").withColumn(column, F.coalesce("_spelling", column)).drop("_spelling")
        return rows.select(*schema.SCHEMAS[name].names)

    return tables.with_tables(**{name: partial(build, name) for name in schema.TABLE_NAMES})
