"""A bounded, repeatable sample by hash: no sort, no shuffle, no limit node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(*cols) -> Column:
    """A number in [0, 1) from the values of ``cols``."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit("sample"))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def hashed_sample(df: DataFrame, rows: int, *cols) -> DataFrame:
    """All rows when there are at most ``rows``, else about ``rows`` of them (within a few standard deviations
    of the square root of ``rows``), chosen by the hash of ``cols``."""
    n = df.count()
    return df if n <= rows else df.where(unit_hash(*cols) < rows / n)
