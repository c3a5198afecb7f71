"""Row fingerprints for change capture (A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checksum(cols: list[str]) -> Column:
    """xxhash64 over (value, is-null) pairs of the chosen columns.

    Spark's hash skips NULL inputs, so (1, NULL) and (NULL, 1) would collide
    without the null markers. Only equality of fingerprints is meaningful.
    """
    parts: list[Column] = []
    for c in cols:
        parts.append(F.col(c))
        parts.append(F.col(c).isNull())
    return F.xxhash64(*parts)


def with_row_checksum(df: DataFrame, cols: list[str], name: str = "row_checksum") -> DataFrame:
    return df.withColumn(name, row_checksum(cols))
