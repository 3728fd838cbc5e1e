"""What the document operators share: narrow input rows, stored copies, bitmaps of keys, whole rows carried through a join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.lineage import shared_folder

# The white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name}`")


def text_of(name: str) -> Column:
    """The text, NULL as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def pin(df: DataFrame) -> DataFrame:
    """The stored copy of `df` on shared storage, so that a lost executor costs no recomputation of what came before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that working columns beside it cannot clash with them."""
    return F.struct(*[col(c) for c in docs.columns])


def join_same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Join on equality of all `names`, NULL equal to NULL: an ordinary hash or merge join key for Spark.

    The result has the columns of `left` and, unless `how` is a semi join, the other columns of `right`.
    """
    renamed = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    condition = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names])
    return left.join(renamed, condition, how).drop(*[f"_right_{n}" for n in names])


def _slot(keys: Sequence[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bitmap_of(keys: DataFrame, bits: int) -> bytearray:
    """Bitmap of the rows of `keys`, for the scans that follow: `bits` bits whatever the number of rows."""
    slot = keys.select(_slot([col(c) for c in keys.columns], bits).alias("slot"))
    words = slot.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("set")
    )
    bitmap = bytearray(bits // 8)
    for word, value in words.collect():  # at most bits / 64 rows
        bitmap[word * 8 : word * 8 + 8] = value.to_bytes(8, "little", signed=True)
    return bitmap


def is_set(bitmap: bytearray, keys: Sequence[Column]) -> Column:
    """True for every row that `bitmap_of` was given, and for some others."""
    slot = _slot(keys, len(bitmap) * 8)
    byte = F.substr(F.lit(bitmap), F.shiftright(slot, 3).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(slot, F.lit(8)).cast("int")) == 1


def with_text(docs: DataFrame, row: str, text: Column, text_col: str, chars_col: str = "n_chars") -> list[Column]:
    """The columns of `docs` out of struct `row`, with the text replaced and its length, if there is one, recomputed."""
    out = []
    for field in docs.schema.fields:
        if field.name == text_col:
            value = text
        elif field.name == chars_col and text_col in docs.columns:
            value = F.char_length(text).cast(field.dataType)
        else:
            value = F.col(row).getField(field.name)
        out.append(value.alias(field.name))
    return out
