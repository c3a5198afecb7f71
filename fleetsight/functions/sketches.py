"""Distinct counts that add up: one sketch per column and snapshot, merged without the rows.

A sketch (HyperLogLog, a few KB) is kept per column with its row and
not-NULL counts. Sketches of loads, partitions or days merge into the sketch
of all of them, so the distinct count of a table that grows is never
recomputed. All columns are sketched in one aggregation, with map-side
partial sketches and no copy of the rows per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14               # 2^14 registers: relative standard error 0.8 %
# an estimate lies within this many standard errors (1.04 / sqrt(2^lg_k)) of the truth but once in a million
SIGMAS = 5.0


def error_bound(lg_k: int = LG_K) -> float:
    """Relative error that an estimate practically never exceeds."""
    return SIGMAS * 1.04 / 2 ** (lg_k / 2)


def column_sketches(df: DataFrame, cols: list[str], by: list[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(by.., column_name, n_rows, n_not_null, sketch): one row per column (and group), in one aggregation.

    Values of any hashable type are sketched through their 64-bit hash; NULL is no value.
    """
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        value = F.col(f"`{c}`")
        aggs += [F.count(value).alias(f"__n{i}"),
                 F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), lg_k).alias(f"__s{i}")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("__rows").alias("n_rows"),
                              F.col(f"__n{i}").alias("n_not_null"), F.col(f"__s{i}").alias("sketch"))
                     for i, c in enumerate(cols)])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def merge_sketches(*parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of all ``parts`` together, per (by.., column)."""
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_not_null").alias("n_not_null"),
        F.hll_union_agg("sketch").alias("sketch"))


def sketched_selectivity(sketches: DataFrame) -> DataFrame:
    """Estimated distinct count and density (1 / distinct) per column; the sketch itself is dropped."""
    out = sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
    return out.withColumn("density", F.when(F.col("n_distinct") > 0, F.lit(1.0) / F.col("n_distinct")))
