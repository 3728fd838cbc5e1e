"""Lines of a text as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space inside a line that is not already a single space.
_RAGGED = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normalised(text: Column) -> Column:
    """In lower case, each line with single spaces and none at its ends.

    Given a whole text it does the same to all its lines but for the outer spaces, which `clean_lines` removes.
    """
    return F.trim(F.regexp_replace(F.lower(text), _RAGGED, " "))


def clean_lines(text: Column) -> Column:
    """The normalised lines in order; a line without a word is empty."""
    return F.transform(lines_of(normalised(text)), lambda x: F.trim(x))


def line_keys(text: Column) -> Column:
    """64-bit hashes of the normalised lines that have a word, in order."""
    return F.transform(F.filter(clean_lines(text), lambda x: x != ""), lambda x: F.xxhash64(x))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is in `removed`; lines without a word stay."""
    some = F.size(F.coalesce(removed, F.array().cast("array<bigint>"))) > 0

    def stays(line: Column) -> Column:
        clean = normalised(line)
        return (clean == "") | ~F.array_contains(removed, F.xxhash64(clean))

    return F.when(some, F.array_join(F.filter(lines_of(text), stays), "\n")).otherwise(text)
