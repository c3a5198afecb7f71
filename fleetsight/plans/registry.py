"""Registry of queries over the driver's tables, each with its DuckDB SQL twin.

A query is a callable ``(spark, sf_dir) -> DataFrame`` reading whole tables.
The SQL twin computes the same result independently (used as the oracle);
computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetsight.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from fleetsight.plans import (  # noqa: F401
        workload_queries, snapshot_queries, reference_queries, capacity_queries,
        compliance_queries, security_queries, profile_queries,
    )
