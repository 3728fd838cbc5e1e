"""URL filter with dated lists: each capture is judged by the entries that were active when it was fetched.

A list is a log of changes: entry, action ("add" or "remove"), day.  Changes become validity intervals [from, to), and
an as-of join finds the interval that holds at the capture's day.  An entry is a domain ("example.com", which covers
its subdomains) or a URL prefix ("example.com/path/", whole path segments, that host only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.llm.frames import col

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; empty where there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def entry_keys(url: Column, labels: Column | int, parts: Column | int) -> Column:
    """Every entry that may match the URL: its host, the host's parent domains, and its host with each path prefix.

    Domains of more than `labels` labels and prefixes of more than `parts` path parts are left out: given the most that any
    entry has, a very long URL costs no more than the longest entry.
    """
    labels, parts = (F.lit(x) if isinstance(x, int) else x for x in (labels, parts))
    names = F.split(host_of(url), r"\.")
    n = F.size(names)
    last = F.least(n, F.greatest(labels, F.lit(1)))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(names, n - i + 1, i), "."))
    # The last part holds the whole rest of the path.
    steps = F.split(F.regexp_extract(url, PATH, 1), "/")
    most = F.least(F.size(steps), F.greatest(parts, F.lit(1)))
    prefixes = F.transform(
        F.sequence(F.lit(1), most),
        lambda i: F.concat(host_of(url), F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")),
    )
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array())


def validity_intervals(changes: DataFrame, entry: str = "entry", action: str = "action", day: str = "day") -> DataFrame:
    """entry, active_from, active_to (exclusive; NULL: still active): when the entry was on the list.

    Of several changes on one day "add" wins.  Rows with a NULL entry or day, or another action, change nothing.
    """
    daily = (
        changes.select(
            F.lower(col(entry)).alias("entry"), col(day).cast("date").alias("day"), F.lower(col(action)).alias("action")
        )
        .where("entry IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy("entry", "day")
        .agg(F.max(F.col("action") == "add").alias("listed"))
    )
    # One row per entry and calendar day, so no group grows with the number of changes.
    following = Window.partitionBy("entry").orderBy("day")
    return (
        daily.withColumn("active_to", F.lead("day").over(following))
        .where("listed")
        .select("entry", F.col("day").alias("active_from"), "active_to")
    )


def filter_captures(
    captures: DataFrame,
    changes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    fetched_col: str = "fetched_on",
) -> DataFrame:
    """One row per distinct capture: page_id, url, fetched_on, n_active, entry, blocked.

    `n_active` counts the entries active at fetch time that match, `entry` is the longest of them (ties: the first in
    order).  A capture with a NULL URL, one without a host, or without a day matches nothing and is not blocked.
    Repeated rows collapse.  Empty tables give no rows, or nothing blocked.
    """
    seen = captures.select(
        col(id_col).alias("page_id"), col(url_col).alias("url"), col(fetched_col).cast("date").alias("fetched_on")
    )
    intervals = validity_intervals(changes)
    is_prefix = F.contains("entry", F.lit("/"))
    longest = intervals.agg(
        F.max(F.when(~is_prefix, F.size(F.split("entry", r"\.")))).alias("labels"),
        F.max(F.when(is_prefix, F.size(F.split("entry", "/")))).alias("parts"),
    ).first()
    asked = seen.select(
        "*", F.explode(entry_keys(F.col("url"), longest["labels"] or 0, longest["parts"] or 0)).alias("entry")
    )
    # An entry's intervals are disjoint and at most one per day: one bounded row per entry, so that a hot entry's
    # captures can be spread over tasks by `lookup`.
    dated = (
        intervals.groupBy("entry")
        .agg(F.collect_list(F.struct("active_from", "active_to")).alias("active"))
    )
    matched = lookup(asked, dated, "entry", ["page_id", "url", "fetched_on"], how="inner").where(
        F.exists(
            "active",
            lambda x: (x["active_from"] <= F.col("fetched_on"))
            & (x["active_to"].isNull() | (F.col("fetched_on") < x["active_to"])),
        )
    )
    hits = matched.select(
        "page_id", "url", "fetched_on", F.struct((-F.char_length("entry")).alias("order"), "entry").alias("hit")
    )
    none = seen.select("*", F.lit(None).cast("struct<order:int,entry:string>").alias("hit"))
    # A repeated capture gives each of its hits again, so entries are counted as a set.
    return (
        none.unionByName(hits)
        .groupBy("page_id", "url", "fetched_on")
        .agg(F.min("hit").alias("best"), F.size(F.collect_set("hit.entry")).cast("bigint").alias("n_active"))
        .select(
            "page_id",
            "url",
            "fetched_on",
            "n_active",
            F.col("best.entry").alias("entry"),
            (F.col("n_active") > 0).alias("blocked"),
        )
    )
