"""Line removal by site-relative frequency: a line on more than a share of its host's pages is boilerplate.

Share = pages of the host that contain the line / pages of the host.  Hosts with few pages say little, so a line also
needs `min_pages` pages.  Lines are compared in normalised form; lines without a word are neither counted nor removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.llm.frames import col, join_same, text_of, whole_row, with_text
from forecourt.llm.lines import clean_lines, line_keys, without_lines

MAX_RATIO = 0.05
MIN_PAGES = 5


def _host(name: str):
    return F.coalesce(F.concat(F.lit("h"), col(name)), F.lit(""))


def remove_site_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Every row of `docs` with its boilerplate lines removed: doc_id, text, n_lines, n_removed_lines and `row`.

    `n_lines` counts lines with a word; `row` holds all columns of `docs` as they were.  NULL text counts as empty and
    a NULL host as a host of its own.  Repeated rows count as pages each and each gives a row.  An empty table gives no
    rows.
    """
    rows = docs.select(
        whole_row(docs).alias("row"),
        col(id_col).alias("doc_id"),
        _host(host_col).alias("host"),
        text_of(text_col).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    # Each page gives a line once, so pages are counted without a distinct; counts combine before the shuffle.
    keys = F.array_distinct(line_keys(F.col("text")))
    page_lines = rows.select("doc_id", "host", "text_hash", F.explode(keys).alias("line"))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    # Read twice by the join below, from one shuffle: a stored copy would be a file per partition for very few rows.
    counts = page_lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = (
        lookup(counts, pages, "host", "line", how="inner")
        .where(F.col("n") > max_ratio * F.col("host_pages"))
        .select("host", "line")
    )
    # Both sides come straight from a shuffle, so adaptive execution can cut a hot line into pieces.
    hits = page_lines.join(frequent, ["host", "line"], "left_semi")
    # With the text's hash, rows that share an id, or have none, do not meet in one key.
    page = ["doc_id", "host", "text_hash"]
    removed = hits.groupBy(*page).agg(F.collect_set("line").alias("removed"))

    # Counted in the scan; only the removed lines, where there are any, are looked for again after the join.
    counted = rows.withColumn("n_lines", F.size(F.filter(clean_lines(F.col("text")), lambda x: x != "")).cast("bigint"))
    joined = join_same(counted, removed, page, "left")
    gone = F.size(F.filter(line_keys(F.col("text")), lambda k: F.array_contains("removed", k)))
    return joined.select(
        "row",
        "doc_id",
        without_lines(F.col("text"), F.col("removed")).alias("text"),
        "n_lines",
        F.when(F.col("removed").isNull(), 0).otherwise(gone).cast("bigint").alias("n_removed_lines"),
    )


def cleaned(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` with the same columns, boilerplate lines removed and `n_chars` recomputed."""
    done = remove_site_lines(docs, text_col=text_col, **options)
    return done.select(*with_text(docs, "row", F.col("text"), text_col))
