"""Parquet table access.

Readers return lazy scans; Catalyst prunes columns and pushes filters into
the Parquet reader, so callers just select what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Attribute access to the tables of one folder: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self._spark = spark
        self._dir = base_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self._spark, self._dir, name)
