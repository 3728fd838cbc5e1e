"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Each level is computed only for rows whose key of the level before is shared.  What survived a level is told to the
next scan by a bitmap of fixed size (`FILTER_BITS`), never by moving texts: the scan tests a bit and computes the
costlier key only where it is set.  A bit set by another key costs one needless hash and changes no result; with many
more shared keys than bits, every scan hashes every text once.  `duplicate_groups` shuffles ids and keys, no texts;
`drop_exact_duplicates` shuffles whole rows once, and only those whose length and prefix another row may share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.joins import lookup
from forecourt.llm.frames import bitmap_of, col, is_set, pin, text_of, whole_row

PREFIX_CHARS = 256
FILTER_BITS = 2**20
REPEATED_AT_ONCE = 4096


def _shared(keys: DataFrame, bits: int) -> bytearray:
    """Bitmap of the keys that more than one row has."""
    names = [F.col(c) for c in keys.columns]
    return bitmap_of(keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*names), bits)


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _prefix(text: Column, prefix_chars: int) -> Column:
    return F.xxhash64(F.substring(text, 1, prefix_chars))


def _suspected(rows: DataFrame, prefix_chars: int, filter_bits: int) -> Column:
    """May another row have the same text?  False proves that none has."""
    length, prefix = _length(F.col("text")), _prefix(F.col("text"), prefix_chars)
    same_length = _shared(rows.select(length.alias("n_bytes")), filter_bits)
    survivors = rows.where(is_set(same_length, [length]))
    same_prefix = _shared(survivors.select(length.alias("n_bytes"), prefix.alias("prefix_hash")), filter_bits)
    return is_set(same_length, [length]) & is_set(same_prefix, [length, prefix])


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, n_bytes, prefix_hash, full_hash.

    Of equal texts the row with the largest id stays.  `full_hash` (SHA-256, hex) is NULL where length and prefix
    already proved the text unique.  NULL text counts as empty.  Rows equal in id and text are documents of their own,
    of which one at most is kept.  A NULL id loses against any other; of copies that all have a NULL id one is kept.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    length, prefix = _length(F.col("text")), _prefix(F.col("text"), prefix_chars)

    full = F.when(_suspected(rows, prefix_chars, filter_bits), F.sha2(F.col("text"), 256))
    keyed = pin(
        rows.select("doc_id", length.alias("n_bytes"), prefix.alias("prefix_hash"), full.alias("full_hash"))
        .groupBy("doc_id", "n_bytes", "prefix_hash", "full_hash")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )

    alike = keyed.where("full_hash IS NOT NULL")
    groups = alike.groupBy("n_bytes", "full_hash").agg(
        F.max("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size")
    )
    key = ["n_bytes", "full_hash"]
    judged = lookup(alike, groups, key, "doc_id", how="inner")
    single = keyed.where("full_hash IS NULL").select(
        *key, "doc_id", "prefix_hash", "_rows", F.col("doc_id").alias("keep_id"), F.col("_rows").alias("group_size")
    )
    # Equal rows were counted; here each is a row again, in two steps so that no list is long.
    block = F.lit(REPEATED_AT_ONCE)
    each = judged.unionByName(single).withColumn("_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_rows") / block) - 1)))
    begin = F.col("_block") * block
    each = each.withColumn("_copy", F.explode(F.sequence(begin, F.least(begin + block, F.col("_rows")) - 1)))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0)).alias("kept"),
        *["n_bytes", "prefix_hash", "full_hash"],
    )


def drop_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The kept documents with all their columns; of rows equal in id and text one stays."""
    rows = docs.select(whole_row(docs).alias("row"), col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    suspected = _suspected(rows.select("text"), prefix_chars, filter_bits)
    alone = rows.where(~suspected).select("row.*")
    # The others are dealt out by 128 bits, never NULL, of id and text, and equal rows with them, so rows move once.
    keyed = rows.where(suspected).select("row", "doc_id", F.sha2("text", 256).alias("full_hash"))
    stays = keyed.groupBy("full_hash").agg(F.max("doc_id").alias("doc_id"))
    key = [F.xxhash64("doc_id", "full_hash").alias("key"), F.xxhash64("full_hash", F.lit(1), "doc_id").alias("other")]
    left = keyed.select("row", *key).join(stays.select(*key), ["key", "other"], "left_semi")
    one = left.groupBy("key", "other").agg(F.first("row").alias("row"))
    return alone.union(one.select("row.*"))
