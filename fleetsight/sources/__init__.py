"""Readers: driver parquet tables, captured command text, schema drift."""

from fleetsight.sources.tables import TABLE_NAMES, read_table  # noqa: F401
