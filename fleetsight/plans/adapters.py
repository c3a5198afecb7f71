"""Views of the driver's tables in the shapes the operators read (FIXTURES.md §2).

Each adapter is a projection (plus at most a cheap expression) of one table,
so it adds no shuffle: Catalyst folds it into the scan's column pruning.
Measures are exact (integer units or decimals) before any sum, so totals do not depend
on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.scalar import code_text

# Return flag -> execution outcome used for the workload views.
RETURNFLAG_OUTCOME = {"N": "Regular", "R": "Aborted", "A": "Exception"}


def runtime_stats(lineitem: DataFrame, *more: str) -> DataFrame:
    """lineitem as workload runtime statistics: database = line status, plan =
    part, interval = ship month, executions = quantity, duration = price in
    cents, cpu = net price in 1/10,000 units, reads = tax in percent points.

    Integer units keep the per-row arithmetic in 64-bit integers (exact and
    far cheaper than decimal casts of every row); totals are summed as
    decimals, so they cannot overflow."""
    outcome = code_text("l_returnflag", RETURNFLAG_OUTCOME)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return lineitem.select(
        F.col("l_linestatus").alias("db"),
        F.col("l_partkey").alias("plan_id"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("interval_id"),
        outcome.alias("execution_type_desc"),
        F.col("l_quantity").cast("bigint").alias("count_executions"),
        cents.alias("avg_duration"),
        (cents * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint"))).alias("avg_cpu_time"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("avg_logical_io_reads"),
        *more,
    )


RUNTIME_SQL = """
SELECT l_linestatus AS db, l_partkey AS plan_id,
       year(l_shipdate) * 100 + month(l_shipdate) AS interval_id,
       CASE l_returnflag WHEN 'N' THEN 'Regular' WHEN 'R' THEN 'Aborted' ELSE 'Exception' END
         AS execution_type_desc,
       CAST(l_quantity AS BIGINT) AS count_executions,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS avg_duration,
       CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS avg_cpu_time,
       CAST(round(l_tax * 100) AS BIGINT) AS avg_logical_io_reads
FROM lineitem
"""
