"""Wide rows to (key, attribute, value) rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_rows(df: DataFrame, key: str, labels: Mapping[str, str]) -> DataFrame:
    """One output row per input row and attribute: (key, ord, attribute, value as text).

    `labels` maps column to attribute label in display order.  NULL values stay as rows.  Expanded row by
    row, so it needs no shuffle.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(label).alias("attribute"), F.col(column).cast("string").alias("value")
            )
            for i, (column, label) in enumerate(labels.items(), start=1)
        ]
    )
    return df.select(F.col(key), F.inline(pairs))
