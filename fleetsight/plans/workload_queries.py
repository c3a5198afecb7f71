"""Registered queries for the workload family (D)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetsight.functions.sketches import column_sketches, merge_sketches, sketched_selectivity
from fleetsight.operators import workload as W
from fleetsight.operators.intervals import interval_join
from fleetsight.plans.adapters import RUNTIME_SQL, runtime_stats
from fleetsight.plans.registry import ORACLE, query
from fleetsight.session import checkpoint_dir
from fleetsight.sources.versioned import read_below, write_version

MEASURES = {"duration": "avg_duration", "cpu": "avg_cpu_time", "reads": "avg_logical_io_reads"}


def flagship(t, n: int = 10, order_by: str = "total_duration"):
    stats = runtime_stats(t.lineitem)
    part = t.part.select(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"))
    return W.top_workload(stats, group_cols=["db"], plan_col="plan_id", count_col="count_executions",
                          measures=MEASURES, outcome_col="execution_type_desc", order_by=order_by,
                          n=n, lookup=part, lookup_key="p_partkey")


_TOP_SQL = f"""
WITH s AS ({RUNTIME_SQL}),
p AS (
  SELECT db, plan_id,
    CAST(SUM(count_executions) AS BIGINT) AS total_executions,
    CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Regular' THEN count_executions END), 0) AS BIGINT) AS total_exec_successful,
    CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Aborted' THEN count_executions END), 0) AS BIGINT) AS total_exec_aborted,
    CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Exception' THEN count_executions END), 0) AS BIGINT) AS total_exec_exceptions,
    CAST(SUM(avg_duration) AS DOUBLE) / COUNT(avg_duration) AS avg_duration,
    CAST(SUM(CAST(CAST(count_executions AS HUGEINT) * avg_duration AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS total_duration,
    CAST(SUM(avg_cpu_time) AS DOUBLE) / COUNT(avg_cpu_time) AS avg_cpu,
    CAST(SUM(CAST(CAST(count_executions AS HUGEINT) * avg_cpu_time AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS total_cpu,
    CAST(SUM(avg_logical_io_reads) AS DOUBLE) / COUNT(avg_logical_io_reads) AS avg_reads,
    CAST(SUM(CAST(CAST(count_executions AS HUGEINT) * avg_logical_io_reads AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS total_reads
  FROM s GROUP BY db, plan_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY db ORDER BY {{order}} DESC, db, plan_id) AS rn FROM p),
t AS (SELECT db, SUM(total_duration) AS pd, SUM(total_cpu) AS pc, SUM(total_reads) AS pr FROM p GROUP BY db)
SELECT r.db, r.plan_id, r.total_executions, r.total_exec_successful, r.total_exec_aborted,
  r.total_exec_exceptions, r.avg_duration, r.total_duration, r.avg_cpu, r.total_cpu, r.avg_reads,
  r.total_reads, CAST(r.rn AS INTEGER) AS rn,
  CAST(COALESCE(CAST(CAST(r.total_duration AS DECIMAL(38,4)) * 100 / NULLIF(t.pd, 0) AS DECIMAL(5,2)), 0) AS DECIMAL(5,2)) AS percent_duration,
  CAST(COALESCE(CAST(CAST(r.total_cpu AS DECIMAL(38,4)) * 100 / NULLIF(t.pc, 0) AS DECIMAL(5,2)), 0) AS DECIMAL(5,2)) AS percent_cpu,
  CAST(COALESCE(CAST(CAST(r.total_reads AS DECIMAL(38,4)) * 100 / NULLIF(t.pr, 0) AS DECIMAL(5,2)), 0) AS DECIMAL(5,2)) AS percent_reads,
  '(Successful:' || CAST(r.total_exec_successful AS VARCHAR) || ', Aborted:' || CAST(r.total_exec_aborted AS VARCHAR)
    || ', Exceptions:' || CAST(r.total_exec_exceptions AS VARCHAR) || ')' AS total_executions_breakdown,
  part.p_name, part.p_brand
FROM r JOIN t ON r.db = t.db LEFT JOIN part ON part.p_partkey = r.plan_id
WHERE r.rn <= 10
"""


@query("d2_top_workload_by_duration", _TOP_SQL.replace("{order}", "total_duration"))
def d2_top_workload_by_duration(t):
    """D2+D3: top 10 plans per database by execution-weighted duration, with percents."""
    return flagship(t)


@query("d2_top_workload_by_executions", _TOP_SQL.replace("{order}", "total_executions"))
def d2_top_workload_by_executions(t):
    """D2+D3 with another sort choice (executions)."""
    return flagship(t, order_by="total_executions")


@query("d2_top_workload_by_avg_cpu", _TOP_SQL.replace("{order}", "avg_cpu"))
def d2_top_workload_by_avg_cpu(t):
    """D2+D3 sorted by the unweighted mean of a measure."""
    return flagship(t, order_by="avg_cpu")


@query("d1_interval_overlap", """
SELECT interval_id, start_time, end_time FROM (
  SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS interval_id,
         MIN(l_shipdate) AS start_time, MAX(l_shipdate) AS end_time
  FROM lineitem GROUP BY 1) i
WHERE start_time <= TIMESTAMP '1998-06-30 00:00:00' AND end_time >= TIMESTAMP '1997-12-15 00:00:00'
""")
def d1_interval_overlap(t):
    """Intervals (ship months) touching a date range."""
    li = t.lineitem
    iv = li.groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("interval_id")).agg(
        F.min("l_shipdate").alias("start_time"), F.max("l_shipdate").alias("end_time"))
    return W.interval_overlap(iv, "start_time", "end_time",
                              F.lit("1997-12-15 00:00:00").cast("timestamp_ntz"),
                              F.lit("1998-06-30 00:00:00").cast("timestamp_ntz"))


@query("d4_outcome_counts", f"""
WITH s AS ({RUNTIME_SQL})
SELECT db, plan_id,
  CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Regular' THEN count_executions END), 0) AS BIGINT) AS "Regular",
  CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Aborted' THEN count_executions END), 0) AS BIGINT) AS "Aborted",
  CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Exception' THEN count_executions END), 0) AS BIGINT) AS "Exception",
  CAST(COALESCE(SUM(count_executions), 0) AS BIGINT) AS total_executions,
  '(Successful:' || CAST(CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Regular' THEN count_executions END), 0) AS BIGINT) AS VARCHAR)
  || ', Aborted:' || CAST(CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Aborted' THEN count_executions END), 0) AS BIGINT) AS VARCHAR)
  || ', Exceptions:' || CAST(CAST(COALESCE(SUM(CASE WHEN execution_type_desc = 'Exception' THEN count_executions END), 0) AS BIGINT) AS VARCHAR)
  || ')' AS total_executions_breakdown
FROM s GROUP BY db, plan_id
""")
def d4_outcome_counts(t):
    """Executions per outcome as columns per (database, plan)."""
    return W.outcome_counts(runtime_stats(t.lineitem), ["db", "plan_id"], "execution_type_desc", "count_executions")


@query("d5_category_breakdown", """
WITH c AS (
  SELECT l_partkey, l_returnflag,
         SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS cat_total,
         CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / COUNT(l_quantity) AS cat_avg,
         CAST(trunc(CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / COUNT(l_quantity)) AS BIGINT) AS cat_avg_int
  FROM lineitem GROUP BY l_partkey, l_returnflag)
SELECT l_partkey, CAST(SUM(cat_total) AS DECIMAL(38,2)) AS total, COUNT(*) AS n_categories,
  string_agg(l_returnflag || ' (Total: ' || CAST(cat_total AS VARCHAR) || ' - Avg: ' || CAST(cat_avg_int AS VARCHAR) || ')',
             ', ' ORDER BY cat_total DESC, l_returnflag) AS breakdown,
  list_sum(list_sort(list(cat_avg))) / COUNT(cat_avg) AS mean
FROM c GROUP BY l_partkey
""")
def d5_category_breakdown(t):
    """Per part, price total and the per-flag breakdown text."""
    li = t.lineitem.select("l_partkey", "l_returnflag", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
                           F.col("l_quantity").cast("decimal(15,2)").alias("qty"))
    out = W.category_breakdown(li, ["l_partkey"], "l_returnflag", "price", "qty")
    return out.withColumn("total", F.col("total").cast("decimal(38,2)"))


@query("d6_unused_items", """
WITH u AS (SELECT l_partkey, COUNT(*) AS seeks FROM lineitem GROUP BY l_partkey)
SELECT p.p_partkey, p.p_name, p.p_retailprice, CAST(COALESCE(u.seeks, 0) AS BIGINT) AS user_seeks
FROM part p LEFT JOIN u ON u.l_partkey = p.p_partkey
WHERE COALESCE(u.seeks, 0) <= 30
""")
def d6_unused_items(t):
    """Parts used by at most 30 lines (absent -> 0 uses)."""
    usage = t.lineitem.select("l_partkey", F.lit(1).alias("seeks"))
    items = t.part.select("p_partkey", "p_name", "p_retailprice")
    return W.unused_items(items, usage, "p_partkey", "l_partkey", "seeks", threshold=30)


@query("d7_totals_with_grand", """
SELECT CASE WHEN GROUPING(l_returnflag) = 1 THEN '***Total***' ELSE l_returnflag END AS l_returnflag,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total_size,
       COUNT(*) AS n_items, GROUPING(l_returnflag) = 1 AS is_total
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())
""")
def d7_totals_with_grand(t):
    """Size and count per return flag plus the overall row."""
    li = t.lineitem.select("l_returnflag", F.col("l_extendedprice").cast("decimal(15,2)").alias("size"))
    out = W.totals_with_grand(li, "l_returnflag", "size", total_label="***Total***")
    return out.withColumn("total_size", F.col("total_size").cast("decimal(38,2)"))


@query("d8_duplicate_signatures", """
WITH sig AS (
  SELECT l_orderkey % 4 AS object_id, l_orderkey,
         string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS key_list
  FROM lineitem GROUP BY ALL),
c AS (SELECT object_id, key_list, COUNT(*) AS n_duplicates FROM sig GROUP BY ALL HAVING COUNT(*) > 1)
SELECT sig.object_id, sig.key_list, sig.l_orderkey, c.n_duplicates
FROM sig JOIN c ON c.key_list = sig.key_list AND c.object_id = sig.object_id
""")
def d8_duplicate_signatures(t):
    """Orders whose ordered part list equals another order's of the same 'table' (order key modulo 4)."""
    li = t.lineitem.select((F.col("l_orderkey") % 4).alias("object_id"), "l_orderkey", "l_partkey", "l_linenumber")
    return W.duplicate_signatures(li, ["l_orderkey"], "l_partkey", "l_linenumber", scope=["object_id"])


@query("d9_column_selectivity", """
SELECT n_rows, column_name, n_distinct, CASE WHEN n_distinct > 0 THEN 1.0 / n_distinct END AS density FROM (
  SELECT COUNT(*) AS n_rows, COUNT(DISTINCT l_orderkey) AS a, COUNT(DISTINCT l_partkey) AS b,
         COUNT(DISTINCT l_suppkey) AS c, COUNT(DISTINCT l_returnflag) AS d, COUNT(DISTINCT l_shipdate) AS e
  FROM lineitem) w,
LATERAL (VALUES ('l_orderkey', a), ('l_partkey', b), ('l_suppkey', c), ('l_returnflag', d), ('l_shipdate', e))
  AS v(column_name, n_distinct)
""")
def d9_column_selectivity(t):
    """Distinct count and density of lineitem columns in one aggregation."""
    return W.column_selectivity(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"])


@query("d12_plan_maintenance", """
WITH f AS (
  SELECT l_orderkey, l_linenumber, CAST(l_discount * 400 AS DECIMAL(10,2)) AS frag, CAST(l_quantity * 40 AS BIGINT) AS pages
  FROM lineitem)
SELECT l_orderkey, l_linenumber, frag, pages,
  CASE WHEN frag BETWEEN 10 AND 30 THEN 'REORGANIZE' ELSE 'REBUILD' END AS operation,
  frag BETWEEN 10 AND 30 AS online, n_items_in_table
FROM f JOIN (SELECT l_orderkey AS k, COUNT(*) AS n_items_in_table FROM f GROUP BY 1) c
  ON c.k = f.l_orderkey
WHERE frag > 10 AND pages > 1000
""")
def d12_plan_maintenance(t):
    """REORGANIZE/REBUILD per lineitem 'index' (fragmentation = discount * 400,
    pages = quantity * 40), with the count of all partitions per order."""
    f = t.lineitem.select("l_orderkey", "l_linenumber",
                          (F.col("l_discount") * 400).cast("decimal(10,2)").alias("frag"),
                          (F.col("l_quantity") * 40).cast("bigint").alias("pages"))
    return W.plan_maintenance(f, frag_col="frag", pages_col="pages", table_key=["l_orderkey"])


@query("d13_stale_statistics", """
WITH s AS (
  SELECT l_partkey, COUNT(*) AS rows_, COUNT(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-01-01 00:00:00') AS modified
  FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, rows_ AS "rows", modified AS modification_counter,
  COALESCE(CAST(CAST(modified AS DECIMAL(38,4)) * 100 / NULLIF(rows_, 0) AS DECIMAL(19,2)), 0) AS modified_percent
FROM s WHERE modified > 0 AND (modified >= 100000 OR CAST(modified AS DOUBLE) * 100.0 >= CAST(rows_ AS DOUBLE) * 10.0)
  AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
""")
def d13_stale_statistics(t):
    """Per part 'statistic': rows = lines, modified = lines shipped since 2001;
    parts of type PROMO excluded (NOT EXISTS)."""
    li = t.lineitem
    s = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("l_shipdate") >= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"), 1))
        .alias("modification_counter"))
    excl = t.part.filter(F.col("p_type") == "PROMO").select(F.col("p_partkey").alias("l_partkey"))
    return W.stale_statistics(s, exclude=excl, exclude_keys=["l_partkey"])


def _partitions(t):
    rf = F.col("l_returnflag")
    q = F.col("l_quantity").cast("bigint")
    return t.lineitem.select(
        F.col("l_suppkey").alias("object_id"), (F.col("l_linenumber") % 3).alias("index_id"),
        F.when(rf == "A", "IN_ROW_DATA").when(rf == "N", "LOB_DATA").otherwise("ROW_OVERFLOW_DATA").alias("type_desc"),
        (q * 10).alias("total_pages"), (q * 8).alias("used_pages"), (q * 5).alias("data_pages"),
        F.lit(1).cast("bigint").alias("rows"))


def _usage(t):
    ls = F.col("l_linestatus")
    return t.lineitem.select(
        F.col("l_suppkey").alias("object_id"),
        F.when(ls == "O", F.col("l_shipdate")).alias("last_user_seek"),
        F.when(ls == "F", F.col("l_shipdate")).alias("last_user_scan"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("last_user_lookup"),
        F.when(ls == "O", 1).otherwise(0).alias("user_seeks"), F.when(ls == "F", 1).otherwise(0).alias("user_scans"),
        F.lit(0).alias("user_lookups"))


@query("d11_describe_tables", """
WITH p AS (SELECT l_suppkey AS object_id, l_linenumber % 3 AS index_id,
                  CASE l_returnflag WHEN 'A' THEN 'IN_ROW_DATA' WHEN 'N' THEN 'LOB_DATA' ELSE 'ROW_OVERFLOW_DATA' END AS type_desc,
                  CAST(l_quantity AS BIGINT) AS q, l_linestatus, l_returnflag, l_shipdate FROM lineitem),
a AS (SELECT object_id, CAST(SUM(CASE WHEN index_id < 2 THEN 1 END) AS BIGINT) AS "rows",
        SUM(q * 10) * 8 / 1024.0 AS total_mb, SUM(q * 8) * 8 / 1024.0 AS used_mb, SUM(q * 5) * 8 / 1024.0 AS data_mb,
        greatest(SUM(q * 8) - SUM(q * 5), 0) * 8 / 1024.0 AS index_mb,
        greatest(SUM(q * 10) - SUM(q * 8), 0) * 8 / 1024.0 AS unused_mb,
        COALESCE(SUM(CASE WHEN type_desc = 'IN_ROW_DATA' THEN q * 10 END), 0) * 8 / 1024.0 AS in_row_data_mb,
        COALESCE(SUM(CASE WHEN type_desc = 'LOB_DATA' THEN q * 10 END), 0) * 8 / 1024.0 AS lob_data_mb,
        COALESCE(SUM(CASE WHEN type_desc = 'ROW_OVERFLOW_DATA' THEN q * 10 END), 0) * 8 / 1024.0 AS row_overflow_data_mb,
        greatest(MAX(CASE WHEN l_linestatus = 'O' THEN l_shipdate END), MAX(CASE WHEN l_linestatus = 'F' THEN l_shipdate END),
                 MAX(CASE WHEN l_returnflag = 'R' THEN l_shipdate END)) AS last_read,
        CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) + SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT)
          AS reads
      FROM p GROUP BY object_id)
SELECT * FROM a
""")
def d11_describe_tables(t):
    """Suppliers as tables; their line items as partitions (flag = allocation type)."""
    return W.describe_tables(_partitions(t), _usage(t))


# event type -> command type of the log the events stand for
_COMMANDS = {"purchase": "ALTER_INDEX", "view": "UPDATE_STATISTICS", "click": "BACKUP_DATABASE", "signup": "BACKUP_LOG",
             "error": "DBCC_CHECKDB"}


def _command_type():
    return F.coalesce(*[F.when(F.col("event_type") == e, F.lit(c)) for e, c in _COMMANDS.items()])


def _plain_log_sql(types):
    return f"""
SELECT event_id AS id, user_id AS database_name, ts AS start_time, ts + to_seconds(event_id % 100000) AS end_time,
  CASE event_type WHEN 'click' THEN 'BACKUP_DATABASE' WHEN 'signup' THEN 'BACKUP_LOG' ELSE 'DBCC_CHECKDB' END AS command_type,
  CASE WHEN s // 86400 <> 0 THEN CAST(s // 86400 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST((s // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration
FROM (SELECT *, event_id % 100000 AS s FROM events WHERE event_type IN ({types})) x
"""


def _plain_log(t):
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("database_name"),
                           F.col("ts").alias("start_time"),
                           F.timestamp_add("SECOND", F.col("event_id") % 100000, F.col("ts")).alias("end_time"),
                           _command_type().alias("command_type"))


@query("d14_command_log_backup", _plain_log_sql("'click', 'signup'"))
def d14_command_log_backup(t):
    """Database and log backups of the whole command log."""
    return W.command_log_report(_plain_log(t), "backup")


@query("d14_command_log_check", _plain_log_sql("'error'"))
def d14_command_log_check(t):
    """Consistency checks of the whole command log."""
    return W.command_log_report(_plain_log(t), "check")


@query("d14_command_log_index", """
WITH l AS (SELECT event_id AS id, user_id AS database_name, ts AS start_time,
                  ts + to_microseconds(CAST(CAST(value AS DECIMAL(15,2)) * 1000000 AS BIGINT)) AS end_time,
                  CASE WHEN value > 50 THEN 'ALTER INDEX ix ON t REBUILD' ELSE 'ALTER INDEX ix ON t REORGANIZE' END AS command,
                  user_id * 100 AS pc, value AS fr
           FROM events WHERE event_type = 'purchase')
SELECT id, database_name, start_time, end_time, command, 'ALTER_INDEX' AS command_type,
  CASE WHEN s // 86400 <> 0 THEN CAST(s // 86400 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST((s // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration,
  pc AS page_count, fr AS fragmentation, pc * 8 / 1024.0 AS size_mb,
  CASE WHEN value_gt THEN 'REBUILD' ELSE 'REORGANIZE' END AS operation
FROM (SELECT *, CAST(floor(epoch(end_time)) - floor(epoch(start_time)) AS BIGINT) AS s, fr > 50 AS value_gt FROM l) x
""")
def d14_command_log_index(t):
    """Purchase events as index maintenance commands with XML extended info."""
    e = t.events
    micros = (F.col("value").cast("decimal(15,2)") * 1000000).cast("bigint")
    xml = F.concat(F.lit("<ExtendedInfo><PageCount>"), (F.col("user_id") * 100).cast("string"),
                   F.lit("</PageCount><Fragmentation>"), F.col("value").cast("string"),
                   F.lit("</Fragmentation></ExtendedInfo>"))
    log = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("database_name"),
                   F.col("ts").alias("start_time"),
                   F.timestamp_add("MICROSECOND", micros, F.col("ts")).alias("end_time"),
                   F.when(F.col("value") > 50, F.lit("ALTER INDEX ix ON t REBUILD"))
                   .otherwise(F.lit("ALTER INDEX ix ON t REORGANIZE")).alias("command"),
                   _command_type().alias("command_type"), xml.alias("extended_info"))
    return W.command_log_report(log, "index").drop("extended_info")


WAITS_SQL = """
SELECT l_linestatus AS db, l_partkey AS plan_id,
  CASE l_returnflag WHEN 'A' THEN 'CPU' WHEN 'N' THEN 'Network IO' ELSE 'Lock' END AS wait_category_desc,
  CAST(round(l_tax * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS total_query_wait_time_ms,
  CAST(round(l_tax * 100) AS BIGINT) AS avg_query_wait_time_ms
FROM lineitem
"""


def waits(t):
    rf = F.col("l_returnflag")
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    return t.lineitem.select(
        F.col("l_linestatus").alias("db"), F.col("l_partkey").alias("plan_id"),
        F.when(rf == "A", "CPU").when(rf == "N", "Network IO").otherwise("Lock").alias("wait_category_desc"),
        (tax * F.col("l_quantity").cast("bigint")).alias("total_query_wait_time_ms"),
        tax.alias("avg_query_wait_time_ms"))


@query("d2_top_workload_with_waits", f"""
WITH base AS ({_TOP_SQL.replace("{order}", "total_duration")}),
w AS ({WAITS_SQL}),
chosen AS (SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM base b WHERE b.db = w.db AND b.plan_id = w.plan_id)),
cat AS (SELECT db, plan_id, wait_category_desc, SUM(total_query_wait_time_ms) AS ct,
               CAST(SUM(avg_query_wait_time_ms) AS DOUBLE) / COUNT(avg_query_wait_time_ms) AS cm,
               CAST(trunc(CAST(SUM(avg_query_wait_time_ms) AS DOUBLE) / COUNT(avg_query_wait_time_ms)) AS BIGINT) AS ca
        FROM chosen GROUP BY ALL),
pp AS (SELECT db, plan_id, SUM(ct) AS total_query_wait_time_ms,
              string_agg(wait_category_desc || ' (Total: ' || CAST(ct AS VARCHAR) || ' - Avg: ' || CAST(ca AS VARCHAR) || ')',
                         ', ' ORDER BY ct DESC, wait_category_desc) AS total_query_wait_time_ms_breakdown
       FROM cat GROUP BY db, plan_id),
mm AS (SELECT db, plan_id, list_sum(list_sort(list(cm))) / COUNT(cm) AS avg_query_wait_time_ms
       FROM cat GROUP BY db, plan_id),
per AS (SELECT db, SUM(total_query_wait_time_ms) AS wp FROM w GROUP BY db)
SELECT base.*, CAST(COALESCE(pp.total_query_wait_time_ms, 0) AS BIGINT) AS total_query_wait_time_ms,
  COALESCE(pp.total_query_wait_time_ms_breakdown, '-') AS total_query_wait_time_ms_breakdown, mm.avg_query_wait_time_ms,
  CAST(COALESCE(CAST(CAST(COALESCE(pp.total_query_wait_time_ms, 0) AS DECIMAL(38,4)) * 100 / NULLIF(per.wp, 0)
    AS DECIMAL(5,2)), 0) AS DECIMAL(5,2)) AS percent_query_wait_time
FROM base LEFT JOIN pp ON pp.db = base.db AND pp.plan_id = base.plan_id
LEFT JOIN mm ON mm.db = base.db AND mm.plan_id = base.plan_id
LEFT JOIN per ON per.db = base.db
""")
def d2_top_workload_with_waits(t):
    """D2+D3+D5: the flagship with wait totals, mean, per-category breakdown and wait percent."""
    stats = runtime_stats(t.lineitem)
    part = t.part.select(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"))
    return W.top_workload(stats, group_cols=["db"], plan_col="plan_id", count_col="count_executions",
                          measures=MEASURES, outcome_col="execution_type_desc", n=10,
                          lookup=part, lookup_key="p_partkey", waits=waits(t))


@query("d14_command_log_statistics", """
WITH l AS (SELECT event_id AS id, user_id AS database_name, ts AS start_time, ts + INTERVAL 90 SECOND AS end_time,
                  'UPDATE STATISTICS t s' || CAST(user_id AS VARCHAR) AS command, 'UPDATE_STATISTICS' AS command_type,
                  CAST(user_id * 1000 + 1000 AS BIGINT) AS row_count, CAST(floor(value * 10) AS BIGINT) AS modification_counter
           FROM events WHERE event_type = 'view')
SELECT id, database_name, start_time, end_time, command, command_type, '00:01:30' AS duration, row_count,
  modification_counter,
  CAST(CAST((modification_counter * 20000 + row_count) // (2 * row_count) AS DOUBLE) / 100 AS DECIMAL(15,2))
    AS modification_percent
FROM l
""")
def d14_command_log_statistics(t):
    """View events as statistics updates with row and modification counts in XML."""
    e = t.events
    rows = (F.col("user_id") * 1000 + 1000).cast("bigint")
    mods = F.floor(F.col("value") * 10).cast("bigint")
    xml = F.concat(F.lit("<ExtendedInfo><RowCount>"), rows.cast("string"), F.lit("</RowCount><ModificationCounter>"),
                   mods.cast("string"), F.lit("</ModificationCounter></ExtendedInfo>"))
    log = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("database_name"),
                   F.col("ts").alias("start_time"), F.timestamp_add("SECOND", F.lit(90), F.col("ts")).alias("end_time"),
                   F.concat(F.lit("UPDATE STATISTICS t s"), F.col("user_id").cast("string")).alias("command"),
                   _command_type().alias("command_type"), xml.alias("extended_info"))
    return W.command_log_report(log, "statistics").drop("extended_info")


def _index_kinds(t):
    p = t.part.select(F.substring_index("p_brand", "#", -1).cast("int").alias("object_id"),
                      F.col("p_partkey").alias("index_id"), F.col("p_name").alias("name"), "p_type")
    kinds = {"CLUSTERED": F.col("p_type") == "ECONOMY", "XML": F.col("p_type") == "PROMO",
             "SPATIAL": F.col("p_type") == "SMALL",
             "NONCLUSTERED": ~F.col("p_type").isin("ECONOMY", "PROMO", "SMALL")}
    return {k: p.filter(c).drop("p_type") for k, c in kinds.items()}


@query("d10_describe_items", """
WITH p AS (SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS object_id, p_partkey AS index_id, p_name AS name,
                  p_type, p_size FROM part),
items AS (SELECT object_id, index_id, name,
            CASE WHEN p_type = 'ECONOMY' THEN 'CLUSTERED' WHEN p_type = 'PROMO' THEN 'XML'
                 WHEN p_type = 'SMALL' THEN 'SPATIAL' ELSE 'NONCLUSTERED' END AS kind FROM p),
c AS (SELECT object_id, index_id, w.column_name, w.key_ordinal,
             w.key_ordinal > 1 AND p_size % 2 = 0 AS is_included, p_size % 3 = 0 AS is_descending
      FROM p, LATERAL (SELECT unnest(string_split(name, ' ')) AS column_name,
                              CAST(generate_subscripts(string_split(name, ' '), 1) AS INTEGER) AS key_ordinal) w),
l AS (SELECT object_id, index_id,
        string_agg(CASE WHEN NOT is_included THEN column_name || CASE WHEN is_descending THEN ' DESC' ELSE '' END END,
                   ', ' ORDER BY key_ordinal, column_name) AS key_columns,
        string_agg(CASE WHEN is_included THEN column_name END, ', ' ORDER BY column_name) AS included_columns
      FROM c GROUP BY object_id, index_id),
li AS (SELECT p.object_id, l.l_partkey AS index_id, CAST(l.l_quantity AS BIGINT) AS used_pages, l.l_linestatus,
              l.l_returnflag, l.l_discount
       FROM lineitem l JOIN p ON p.index_id = l.l_partkey),
s AS (SELECT object_id, index_id, SUM(used_pages) * 8 / 1024.0 AS size_mb,
        CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS user_seeks,
        CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS user_scans,
        CAST(0 AS BIGINT) AS user_lookups,
        CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS user_updates,
        MAX(l_discount * 100) AS fragmentation
      FROM li GROUP BY object_id, index_id)
SELECT items.*, l.key_columns, l.included_columns, s.size_mb, s.user_seeks, s.user_scans, s.user_lookups,
       s.user_updates, s.fragmentation
FROM items LEFT JOIN l USING (object_id, index_id) LEFT JOIN s USING (object_id, index_id)
""")
def d10_describe_items(t):
    """Parts as indexes of four kinds (by type) on their brand's 'table'; the words of the
    name are the index columns; line items give size, usage and fragmentation."""
    kinds = _index_kinds(t)
    p = t.part.select(F.substring_index("p_brand", "#", -1).cast("int").alias("object_id"),
                      F.col("p_partkey").alias("index_id"), "p_name", "p_size")
    cols = p.select("object_id", "index_id", "p_size",
                    F.posexplode(F.split("p_name", " ")).alias("pos", "column_name")).select(
        "object_id", "index_id", "column_name", (F.col("pos") + 1).cast("int").alias("key_ordinal"),
        ((F.col("pos") + 1 > 1) & (F.col("p_size") % 2 == 0)).alias("is_included"),
        (F.col("p_size") % 3 == 0).alias("is_descending"))
    li = t.lineitem.join(p.select("object_id", F.col("index_id").alias("l_partkey")), "l_partkey").select(
        "object_id", F.col("l_partkey").alias("index_id"), F.col("l_quantity").cast("bigint").alias("used_pages"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("user_seeks"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("user_scans"),
        F.lit(0).alias("user_lookups"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("user_updates"),
        (F.col("l_discount") * 100).alias("avg_fragmentation_in_percent"))
    out = W.describe_items(kinds, cols, sizes=li, usage=li, frag=li)
    return out.select("object_id", "index_id", "name", "kind", "key_columns", "included_columns", "size_mb",
                      F.col("user_seeks").cast("bigint").alias("user_seeks"),
                      F.col("user_scans").cast("bigint").alias("user_scans"),
                      F.col("user_lookups").cast("bigint").alias("user_lookups"),
                      F.col("user_updates").cast("bigint").alias("user_updates"), "fragmentation")


_SEL_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]


@query("d9_rank_missing_index", """
WITH f AS (SELECT l_suppkey AS item_id, CAST(SUM(l_quantity) AS BIGINT) AS impact,
                  MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_r,
                  MAX(CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END) AS has_new,
                  MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS has_a
           FROM lineitem GROUP BY l_suppkey),
d AS (SELECT f.item_id, s.s_nationkey AS database_id, f.impact FROM f JOIN supplier s ON s.s_suppkey = f.item_id),
u AS (SELECT item_id, 'l_returnflag' AS column_name, 'EQUALITY' AS usage FROM f WHERE has_r = 1
      UNION ALL SELECT item_id, 'l_partkey', 'EQUALITY' FROM f
      UNION ALL SELECT item_id, 'l_shipdate', 'INEQUALITY' FROM f WHERE has_new = 1
      UNION ALL SELECT item_id, 'l_orderkey', 'INCLUDE' FROM f
      UNION ALL SELECT item_id, 'l_partkey', 'INCLUDE' FROM f WHERE has_a = 1),
c AS (SELECT item_id, item_id % 2 AS object_id, substr(column_name, 3) AS column_name, usage FROM u),
sel AS (SELECT 0 AS object_id, substr(column_name, 3) AS column_name, 1.0 / n_distinct AS density FROM (
          SELECT COUNT(DISTINCT l_orderkey) AS a, COUNT(DISTINCT l_partkey) AS b, COUNT(DISTINCT l_suppkey) AS c,
                 COUNT(DISTINCT l_returnflag) AS d, COUNT(DISTINCT l_shipdate) AS e FROM lineitem) w,
        LATERAL (VALUES ('l_orderkey', a), ('l_partkey', b), ('l_suppkey', c), ('l_returnflag', d), ('l_shipdate', e))
          v(column_name, n_distinct)
        UNION ALL SELECT 1, 'orderkey', 1.0 / COUNT(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 1, 'partkey', 1.0 / COUNT(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 1, 'returnflag', 1.0 / COUNT(DISTINCT o_orderdate) FROM orders
        UNION ALL SELECT 1, 'shipdate', 1.0 / COUNT(DISTINCT o_orderstatus) FROM orders),
cs AS (SELECT c.*, sel.density FROM c LEFT JOIN sel USING (object_id, column_name)),
k AS (SELECT item_id, string_agg(column_name, ', ' ORDER BY CASE usage WHEN 'EQUALITY' THEN 0 ELSE 1 END, density, column_name)
        AS key_columns FROM cs WHERE usage IN ('EQUALITY', 'INEQUALITY') GROUP BY item_id),
i AS (SELECT item_id, string_agg(column_name, ', ' ORDER BY column_name) AS include_columns FROM cs x
      WHERE usage = 'INCLUDE' AND NOT EXISTS (SELECT 1 FROM cs y WHERE y.item_id = x.item_id
        AND y.column_name = x.column_name AND y.usage IN ('EQUALITY', 'INEQUALITY')) GROUP BY item_id)
SELECT d.item_id, d.database_id, d.impact, k.key_columns, i.include_columns,
  CAST(DENSE_RANK() OVER (PARTITION BY d.database_id ORDER BY d.impact DESC) AS INTEGER) AS impact_rank
FROM d LEFT JOIN k USING (item_id) LEFT JOIN i USING (item_id)
""")
def d9_rank_missing_index(t):
    """One missing-index suggestion per supplier (impact = quantity supplied) with
    equality/inequality/include columns derived from its lines, ordered by the
    measured densities of their own table's columns (two tables that name
    their columns alike), ranked per nation."""
    li, other = t.lineitem, _other_table(t)
    sel = W.column_selectivity(li, _SEL_COLS).withColumn("object_id", F.lit(0).cast("bigint")).unionByName(
        W.column_selectivity(other, other.columns).withColumn("object_id", F.lit(1).cast("bigint")))
    return _missing_indexes(t, sel)


def _other_table(t):
    """Another table with the same column names and other densities."""
    return t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"),
                           F.col("o_orderdate").alias("l_returnflag"), F.col("o_orderstatus").alias("l_shipdate"))


def _missing_indexes(t, sel):
    li = t.lineitem
    f = li.groupBy(F.col("l_suppkey").alias("item_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("impact"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_r"),
        F.max(F.when(F.col("l_shipdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), 1).otherwise(0))
        .alias("has_new"),
        F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("has_a"))
    details = f.join(t.supplier.select(F.col("s_suppkey").alias("item_id"), F.col("s_nationkey").alias("database_id")),
                     "item_id").select("item_id", "database_id", "impact")
    entry = lambda name, usage, cond: F.when(cond, F.struct(F.lit(name).alias("column_name"),
                                                           F.lit(usage).alias("usage")))
    arr = F.array(entry("l_returnflag", "EQUALITY", F.col("has_r") == 1), entry("l_partkey", "EQUALITY", F.lit(True)),
                  entry("l_shipdate", "INEQUALITY", F.col("has_new") == 1), entry("l_orderkey", "INCLUDE", F.lit(True)),
                  entry("l_partkey", "INCLUDE", F.col("has_a") == 1))
    cols = f.select("item_id", F.explode(arr).alias("c")).filter(F.col("c").isNotNull()).select(
        "item_id", (F.col("item_id") % 2).alias("object_id"),
        F.substring("c.column_name", 3, 20).alias("column_name"), "c.usage")
    sel = sel.select("object_id", F.substring("column_name", 3, 20).alias("column_name"), "density")
    out = W.rank_missing_index(details, cols, sel)
    return out.select("item_id", "database_id", "impact", "key_columns", "include_columns", "impact_rank")


@query("d2_top_workload_in_intervals", f"""
WITH s AS (SELECT r.*, r.l_shipdate AS ts FROM ({RUNTIME_SQL.replace("AS avg_logical_io_reads", "AS avg_logical_io_reads, l_shipdate")}) r
           WHERE interval_id IN (SELECT year(l_shipdate) * 100 + month(l_shipdate) FROM lineitem GROUP BY 1
                                 HAVING MIN(l_shipdate) <= TIMESTAMP '1998-06-30' AND MAX(l_shipdate) >= TIMESTAMP '1997-12-15')
             AND execution_type_desc <> 'Aborted'),
p AS (SELECT db, plan_id, CAST(SUM(count_executions) AS BIGINT) AS total_executions, MIN(ts) AS first_start, MAX(ts) AS last_end,
        CAST(SUM(avg_duration) AS DOUBLE) / COUNT(avg_duration) AS avg_duration,
        CAST(SUM(CAST(count_executions AS HUGEINT) * avg_duration) AS DECIMAL(38,0)) AS total_duration FROM s GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY db ORDER BY total_duration DESC, db, plan_id) AS rn FROM p),
t AS (SELECT db, SUM(total_duration) AS pd FROM p GROUP BY db)
SELECT r.db, r.plan_id, r.total_executions, r.first_start, r.last_end, r.avg_duration, r.total_duration,
  CAST(r.rn AS INTEGER) AS rn,
  CAST(COALESCE(CAST(CAST(r.total_duration AS DECIMAL(38,4)) * 100 / NULLIF(t.pd, 0) AS DECIMAL(5,2)), 0) AS DECIMAL(5,2)) AS percent_duration
FROM r JOIN t ON r.db = t.db WHERE r.rn <= 5
""")
def d2_top_workload_in_intervals(t):
    """D1+D2+D3: the statistics of the intervals that touch a date range, without aborted executions, with the first
    start and last end of each plan."""
    li = t.lineitem
    iv = li.groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("interval_id")).agg(
        F.min("l_shipdate").alias("start_time"), F.max("l_shipdate").alias("end_time"))
    chosen = W.interval_overlap(iv, "start_time", "end_time", F.lit("1997-12-15 00:00:00").cast("timestamp_ntz"),
                                F.lit("1998-06-30 00:00:00").cast("timestamp_ntz"))
    return W.top_workload(runtime_stats(li, "l_shipdate"), group_cols=["db"], plan_col="plan_id",
                          count_col="count_executions", measures={"duration": "avg_duration"}, interval_col="interval_id",
                          n=5, intervals=chosen, filters=F.col("execution_type_desc") != "Aborted",
                          start_col="l_shipdate", end_col="l_shipdate")


@query("d11_describe_columns", """
WITH c AS (SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS object_id, unnest(string_split(p_name, ' ')) AS column_name,
                  p_partkey FROM part),
x AS (SELECT object_id, column_name, string_agg(DISTINCT 'ix_' || CAST(p_partkey % 50 AS VARCHAR), ', '
        ORDER BY 'ix_' || CAST(p_partkey % 50 AS VARCHAR)) AS used_by_indexes FROM c GROUP BY ALL)
SELECT d.object_id, d.column_name, d.max_length, d.is_nullable, x.used_by_indexes
FROM (SELECT object_id, column_name, CAST(MAX(length(column_name)) AS INTEGER) AS max_length, MIN(p_partkey) % 2 = 0 AS is_nullable
      FROM c GROUP BY ALL) d LEFT JOIN x USING (object_id, column_name)
""")
def d11_describe_columns(t):
    """The words of the part names as columns of their brand's table, with the indexes that use them."""
    c = t.part.select(F.substring_index("p_brand", "#", -1).cast("int").alias("object_id"),
                      F.explode(F.split("p_name", " ")).alias("column_name"), "p_partkey")
    cols = c.groupBy("object_id", "column_name").agg(F.max(F.length("column_name")).alias("max_length"),
                                                     (F.min("p_partkey") % 2 == 0).alias("is_nullable"))
    ix = c.select("object_id", "column_name", F.concat(F.lit("ix_"), (F.col("p_partkey") % 50).cast("string"))
                  .alias("index_name"))
    return W.describe_columns(cols, ix)


@query("d9_rank_missing_index_sketched", ORACLE["d9_rank_missing_index"])
def d9_rank_missing_index_sketched(t):
    """The same suggestions with densities from sketches that were kept per load (here per ship year) and
    merged: no load's rows are read twice and no column is counted exactly."""
    spark = t.lineitem.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/d9-sketches-{uuid.uuid4().hex}"
    loads = column_sketches(t.lineitem.withColumn("load", F.year("l_shipdate")), _SEL_COLS, by=["load"])
    write_version(loads.withColumn("object_id", F.lit(0).cast("bigint")), base, 1)
    other = _other_table(t)
    write_version(column_sketches(other, other.columns).select(
        F.lit(None).cast("int").alias("load"), "*", F.lit(1).cast("bigint").alias("object_id")), base, 2)
    merged = merge_sketches(read_below(spark, base, 3), by=["object_id"])
    return _missing_indexes(t, sketched_selectivity(merged).select("object_id", "column_name", "density"))


_SPANS_SQL = """
SELECT o.o_custkey AS cust, o.o_orderkey, o.o_orderdate AS ordered, o.o_orderdate + INTERVAL 30 DAY AS due,
       min(l.l_shipdate) AS first_ship, max(l.l_shipdate) AS last_ship
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL
"""


@query("d1_interval_join", f"""
WITH s AS ({_SPANS_SQL})
SELECT a.cust, a.o_orderkey AS order_key, a.ordered, a.due, b.o_orderkey AS shipped_key, b.first_ship, b.last_ship
FROM s a JOIN s b ON a.cust = b.cust AND a.ordered <= b.last_ship AND b.first_ship <= a.due
""")
def d1_interval_join(t):
    """Order spans (order date and 30 days) of a customer with the ship spans (first to last ship date) of
    the customer's orders that they touch."""
    span = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("cust"), "o_orderkey", "o_orderdate").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    orders = span.select("cust", F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("ordered"),
                         (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due"))
    ships = span.select("cust", F.col("o_orderkey").alias("shipped_key"), "first_ship", "last_ship")
    return interval_join(orders, ships, ("ordered", "due"), ("first_ship", "last_ship"), ["cust"])


@query("d1_interval_join_unkeyed", """
WITH m AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS interval_id,
                  min(l_shipdate) AS start_time, max(l_shipdate) AS end_time FROM lineitem GROUP BY 1),
p AS (SELECT l_partkey AS part, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem
      WHERE l_quantity > 45 GROUP BY 1)
SELECT interval_id, count(*) AS parts, min(first_ship) AS earliest, max(last_ship) AS latest
FROM m JOIN p ON start_time <= last_ship AND first_ship <= end_time GROUP BY 1
""")
def d1_interval_join_unkeyed(t):
    """For every interval (ship month) the parts whose span of large shipments touches it, without a key."""
    li = t.lineitem
    months = li.groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("interval_id")).agg(
        F.min("l_shipdate").alias("start_time"), F.max("l_shipdate").alias("end_time"))
    parts = li.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("part")).agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    return interval_join(months, parts, ("start_time", "end_time"), ("first_ship", "last_ship")).groupBy(
        "interval_id").agg(F.count(F.lit(1)).alias("parts"), F.min("first_ship").alias("earliest"),
                           F.max("last_ship").alias("latest"))
