"""Versioned Parquet tables: write a new version folder, then switch.

Plain Parquet has no transactions, so a state change (a merge, a history
append) is written to ``<base>/version=<n>`` and becomes visible only when
that folder is complete (Spark's ``_SUCCESS`` marker). Readers take the
newest complete version, so a job that dies half-way leaves the previous
state readable, and a rerun of version n overwrites the same folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, base: str, prefix: str = "version=") -> list[int]:
    """Complete versions under ``base`` (folders with a _SUCCESS marker)."""
    jvm, p, fs = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[len(prefix):]))
    return sorted(out)


def current_version(spark: SparkSession, base: str, below: int | None = None) -> int | None:
    v = [x for x in versions(spark, base) if below is None or x < below]
    return v[-1] if v else None


def read_current(spark: SparkSession, base: str, schema=None, below: int | None = None) -> DataFrame | None:
    """Newest complete version (below ``below`` when given: the input of the
    run that writes version ``below``, so reruns see the same input)."""
    v = current_version(spark, base, below)
    if v is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(os.path.join(base, f"version={v}"))


def read_below(spark: SparkSession, base: str, version: int, prefix: str = "version=") -> DataFrame | None:
    """All rows of the complete versions below ``version``; None when there is none."""
    found = [x for x in versions(spark, base, prefix) if x < version]
    if not found:
        return None
    return spark.read.parquet(*[os.path.join(base, f"{prefix}{x}") for x in found])


def write_version(df: DataFrame, base: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as version ``version`` (overwrite: reruns are idempotent)."""
    path = os.path.join(base, f"version={version}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def append(df: DataFrame, base: str, partition_by: list[str] | None = None) -> None:
    """Append-only tables (history, time series): plain Parquet append,
    partitioned by collection date when given."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(base)
