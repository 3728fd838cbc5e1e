"""Quality rules: word statistics of each text, and lines that too many documents of one host share.

A line is frequent on its host if it occurs in at least `min_docs` distinct documents there, and in at least `line_share`
of them or in at least `many_docs`; documents with identical text count once.  Frequent lines are boilerplate and are
removed, and a document that loses more than `max_removed_share` of its words is depleted and rejected.

Near copies share most of their lines without being boilerplate, so a line counts once per group of near copies: a text
with at least `copy_share` of its words in frequent lines is a near copy of others on its host.  Of a line's documents, and
of the host's, the near copies count as one, and lines that are not frequent by this count stay.  So pages of a host
that are mostly its template are rejected, and near copies of one document are left to the dedup stages.

Built-in functions only.  Statistics are computed inside the scan, row by row; what is shuffled is one narrow row per
distinct line of a document and one per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.llm.frames import SPACE, col, join_same, pin, text_of, whole_row, with_text
from forecourt.llm.lines import clean_lines, line_keys, lines_of, without_lines

SYMBOL = "[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 5
LINE_SHARE = 0.1
MANY_DOCS = 500
MAX_REMOVED_SHARE = 0.5
# From this share of common words on, near-duplicate operators call two texts similar.
COPY_SHARE = 0.8


def _host(host: Column) -> Column:
    """A non-NULL name; a NULL host differs from every named one."""
    return F.coalesce(F.concat(F.lit("h"), host), F.lit(""))


def word_metrics(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of column `text` (not NULL).

    Windows of three words are compared by their 64-bit hash, inside one text.  Everything is linear in the text, or a
    sort of its windows where one of them repeats.
    """
    text = F.col("text")
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.filter(lines_of(text), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    listed = rows.withColumns(
        {
            "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOL, ""))).cast("bigint"),
            "_lines": F.transform(lines, lambda x: F.xxhash64(x)),
            "_words": F.when(trimmed != "", F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>")),
        }
    )
    counted = listed.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_windows": F.expr(
                "IF(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3),"
                " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
            ),
        }
    ).drop("_words", "_lines")
    # Only texts with a repeated window are sorted; for others the list is NULL.
    sorted_ = counted.withColumn(
        "_sorted",
        F.expr(
            "IF(size(array_distinct(_windows)) < size(_windows),"
            " sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))), NULL)"
        ),
    ).drop("_windows")
    repeated = sorted_.withColumn(
        "_at",
        F.expr(
            "sort_array(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h OR x.h = get(_sorted, k + 1).h),"
            " x -> x.i))"
        ),
    ).drop("_sorted")
    # A repeated window adds the words that the repeated window before it does not cover.
    covered = F.expr(
        "coalesce(aggregate(_at, named_struct('last', -3, 'n', 0L),"
        " (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n), 0L)"
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    # A generator, so that a filter on a metric is not pushed into the steps above, each element computing them anew.
    measured = F.struct(*[F.col(n) for n in names], covered.alias("n_repeat_words"))
    return repeated.select(*rows.columns, F.inline(F.array(measured)))


def _lines_by_host(rows: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, text_words, pos, line, words: one row per line with a word."""
    listed = F.transform(
        F.filter(clean_lines(F.col("text")), lambda x: x != ""),
        # Single spaces separate the words of a normalised line.
        lambda x, i: F.struct(
            i.alias("pos"),
            F.xxhash64(x).alias("line"),
            (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("words"),
        ),
    )
    every = rows.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), listed.alias("listed"))
    text_words = F.aggregate("listed.words", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("text_words")
    return every.select("doc_id", "host", "text_hash", text_words, F.inline("listed"))


def _frequent(n_docs: Column, host_docs: Column, min_docs: int, line_share: float, many_docs: int) -> Column:
    return (n_docs >= min_docs) & ((n_docs >= line_share * host_docs) | (n_docs >= many_docs))


def frequent_lines(rows: DataFrame, min_docs: int, line_share: float, many_docs: int) -> DataFrame:
    """host, line, n_docs, host_docs: the lines above the limits.  `rows` has doc_id, host and text."""
    text_hash = F.xxhash64("text").alias("text_hash")
    keys = F.array_distinct(line_keys(F.col("text")))
    spread = rows.select("host", text_hash, F.explode(keys).alias("line")).distinct()
    # Stored, because the join below reads it twice.
    per_line = pin(
        spread.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    )
    hosts = (
        rows.select("host", text_hash)
        .distinct()
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("host_docs"))
    )
    both = lookup(per_line, hosts, "host", "line", how="inner")
    above = both.where(_frequent(F.col("n_docs"), F.col("host_docs"), min_docs, line_share, many_docs))
    return above.select("host", "line", "n_docs", "host_docs")


def _words_of(hit: str) -> Column:
    return F.aggregate(f"{hit}.words", F.lit(0).cast("bigint"), lambda a, x: a + x)


def _without_copies(
    lines: DataFrame, found: DataFrame, min_docs: int, line_share: float, many_docs: int, copy_share: float
) -> DataFrame:
    """host, line: those of `lines` that are frequent if near copies count as one.

    `found` has host, text_hash, text_words and `hit`, the lines of each text that are among `lines`.
    """
    copies = (
        found.where(_words_of("hit") >= copy_share * F.col("text_words"))
        .select("host", "text_hash", F.array_distinct("hit.line").alias("lines"))
    )
    of_line = copies.select("host", "text_hash", F.explode("lines").alias("line")).distinct()
    of_line = of_line.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    of_host = copies.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_n"))
    counted = lines.join(of_line, ["host", "line"], "left").join(of_host, "host", "left")
    n_docs = F.col("n_docs") - F.coalesce(F.col("n") - 1, F.lit(0))
    host_docs = F.col("host_docs") - F.coalesce(F.col("host_n") - 1, F.lit(0))
    return counted.where(_frequent(n_docs, host_docs, min_docs, line_share, many_docs)).select("host", "line")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    line_share: float = LINE_SHARE,
    many_docs: int = MANY_DOCS,
    copy_share: float = COPY_SHARE,
    max_removed_share: float = MAX_REMOVED_SHARE,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Every row of `docs` with its statistics and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept,
    `removed` (keys of its boilerplate lines, NULL if none) and `row` (all columns of `docs`).

    NULL text counts as empty: no words, so it fails the base rule.  A NULL host is a host of its own.  Repeated rows
    are judged alike and each gives a row.  An empty table gives no rows.
    """
    rows = docs.select(
        whole_row(docs).alias("row"), col(id_col).alias("doc_id"), col(host_col).alias("host"), text_of(text_col).alias("text")
    )
    narrow = rows.select("doc_id", _host(F.col("host")).alias("host"), "text")
    lines = pin(frequent_lines(narrow, min_docs, line_share, many_docs))
    # Both sides come straight from a shuffle, so adaptive execution can cut a hot line into pieces.
    hits = _lines_by_host(narrow).join(lines.select("host", "line"), ["host", "line"], "left_semi")
    key = ["doc_id", "host", "text_hash"]
    # A set, because repeated rows give each of their lines again.  Stored, because it is read twice.
    found = pin(
        hits.groupBy(*key, "text_words").agg(F.collect_set(F.struct("pos", "line", "words")).alias("hit"))
    )
    bad = pin(_without_copies(lines, found, min_docs, line_share, many_docs, copy_share))
    boilerplate = found.select(*key, F.inline("hit")).join(bad, ["host", "line"], "left_semi")
    removed = boilerplate.groupBy(*key).agg(
        F.collect_set("line").alias("removed"), F.sum("words").alias("n_removed_words")
    )

    measured = word_metrics(
        rows.withColumns({"host": _host(F.col("host")), "text_hash": F.xxhash64("text")})
    ).drop("text")
    joined = join_same(measured, removed, key, "left").drop("host", "text_hash")
    base_failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    removed_words = F.coalesce("n_removed_words", F.lit(0).cast("bigint"))
    return joined.withColumns({"n_removed_words": removed_words, "base_failed": base_failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed_share * F.col("n_words"))
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept documents with the columns of `docs`, their boilerplate lines removed and `n_chars` recomputed."""
    kept = judge(docs, id_col, text_col, host_col, **limits).where("kept")
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    return kept.select(*with_text(docs, "row", without_lines(text, F.col("removed")), text_col))
