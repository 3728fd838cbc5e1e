"""Text rules: case folding, keyword patterns, capitalised words, order-number suffixes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(value: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
    return plain.casefold()


def same_text(column: Column, value: str, domain: Sequence[str] = ()) -> Column:
    """Equality that ignores case and accents.

    A value of a closed `domain` is compared in its declared spelling, which a scan can filter by.
    """
    for declared in domain:
        if _folded(declared) == _folded(value):
            return column == declared
    return F.collate(column, "UNICODE_CI_AI") == F.lit(value)


def keyword_pattern(keyword: str) -> str:
    """LIKE pattern for "contains keyword".

    `%` and `_` typed by the user stay wildcards.  A backslash escapes a wildcard or itself; before any
    other character it has no meaning and is dropped, because Spark rejects such a pattern.
    """
    kept = re.sub(r"\\(?![%_\\])", "", keyword.replace("\\\\", "\0")).replace("\0", "\\\\")
    return f"%{kept}%"


def capitalised(column: Column) -> Column:
    """First letter upper case and everything after it lower case, across the whole text."""
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substr(column, F.lit(2))))


def order_number(vin: Column, sequence: Column) -> Column:
    """`VIN-NNN`; numbers past 999 grow instead of being cut."""
    return F.concat(vin, F.lit("-"), F.format_string("%03d", sequence))


def is_blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def blank_to_null(column: Column) -> Column:
    return F.when(~is_blank(column), column)
