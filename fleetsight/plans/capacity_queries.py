"""Registered queries for capacity, counters and time series (C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetsight.operators import capacity as C
from fleetsight.operators.rollup import RollupStore, rollup_from_states
from fleetsight.plans.registry import query
from fleetsight.session import checkpoint_dir


def _orders_sizes(t):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate",
                           F.col("o_totalprice").cast("decimal(15,2)").alias("size"))


@query("c1_growth_daily", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(15,2)) AS size FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate, size,
  size - COALESCE(LAG(size) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS size_growth,
  strftime(o_orderdate, '%d/%m/%Y') AS data_collection_date
FROM o
""")
def c1_growth_daily(t):
    """Order value minus the previous order's, per customer in time order."""
    return C.growth_report(_orders_sizes(t), ["o_custkey"], "o_orderdate", ["size"], "day", ["o_orderkey"])


_SAMPLE_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(15,2)) AS size FROM orders),
r AS (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY o_custkey, year(o_orderdate){m} ORDER BY o_orderdate, o_orderkey) AS rp,
  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rl FROM o),
s AS (SELECT o_custkey, o_orderkey, o_orderdate, size FROM r WHERE rp = 1 OR rl = 1)
"""


@query("c2_sample_month", _SAMPLE_SQL.replace("{m}", ", month(o_orderdate)") + "SELECT * FROM s")
def c2_sample_month(t):
    """First order of each month per customer plus the last one."""
    return C.sample_period(_orders_sizes(t), ["o_custkey"], "o_orderdate", "month", ["o_orderkey"])


@query("c1_growth_yearly", _SAMPLE_SQL.replace("{m}", "") + """
SELECT o_custkey, o_orderkey, o_orderdate, size,
  size - COALESCE(LAG(size) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS size_growth,
  strftime(o_orderdate, '%d/%m/%Y') AS data_collection_date
FROM s
""")
def c1_growth_yearly(t):
    """C1+C2: growth over the yearly samples (first of each year plus the last)."""
    return C.growth_report(_orders_sizes(t), ["o_custkey"], "o_orderdate", ["size"], "year", ["o_orderkey"])


@query("c3_disk_alarm", """
WITH d AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(15,2)) AS size_mb, CAST(p_size * 5 AS DECIMAL(15,2)) AS free_mb FROM part)
SELECT p_partkey, size_mb, free_mb, CAST(free_mb * 100 / NULLIF(size_mb, 0) AS DECIMAL(4,1)) AS free_pct,
  CASE WHEN free_mb * 100 < size_mb * 10 THEN 'Alarm!!!' WHEN free_mb * 100 < size_mb * 20 THEN 'Warning!!!' ELSE '' END AS alarm
FROM d
""")
def c3_disk_alarm(t):
    """Parts as disks (size = retail price, free = size * 5 MB)."""
    d = t.part.select("p_partkey", F.col("p_retailprice").cast("decimal(15,2)").alias("size_mb"),
                      (F.col("p_size") * 5).cast("decimal(15,2)").alias("free_mb"))
    return C.disk_alarm(d, "free_mb", "size_mb")


@query("c4_size_by_type", """
WITH d AS (SELECT l_returnflag, CASE l_linestatus WHEN 'O' THEN 'ROWS' ELSE 'LOG' END AS type_desc,
                  CAST(l_extendedprice AS DECIMAL(15,2)) AS size, CAST(l_quantity AS DECIMAL(15,2)) AS used FROM lineitem)
SELECT CASE WHEN GROUPING(l_returnflag) = 1 THEN '***Total***' ELSE l_returnflag END AS l_returnflag,
  CAST(COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN size END), 0) AS DECIMAL(25,2)) AS rows_size,
  CAST(COALESCE(SUM(CASE WHEN type_desc = 'LOG' THEN size END), 0) AS DECIMAL(25,2)) AS log_size,
  CAST(COALESCE(SUM(CASE WHEN type_desc = 'FILESTREAM' THEN size END), 0) AS DECIMAL(25,2)) AS filestream_size,
  CAST(COALESCE(SUM(CASE WHEN type_desc = 'FULLTEXT' THEN size END), 0) AS DECIMAL(25,2)) AS fulltext_size,
  CAST(SUM(size) AS DECIMAL(25,2)) AS total_size,
  CAST(COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN used END), 0) AS DECIMAL(25,2)) AS used_size,
  CAST(COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN size END), 0)
       - COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN used END), 0) AS DECIMAL(26,2)) AS free_size,
  -- exact half-up rounding of free * 100 / data to a whole percent (values in cents)
  CAST((CAST((COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN size END), 0)
              - COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN used END), 0)) * 100 AS HUGEINT) * 200
        + CAST(COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN size END), 0) * 100 AS HUGEINT))
       // (2 * NULLIF(CAST(COALESCE(SUM(CASE WHEN type_desc = 'ROWS' THEN size END), 0) * 100 AS HUGEINT), 0))
       AS DECIMAL(10,0)) AS free_percent
FROM d GROUP BY ROLLUP (l_returnflag)
""")
def c4_size_by_type(t):
    """C4: price by 'allocation type' (line status O = ROWS, F = LOG) per return flag, with a grand total."""
    d = t.lineitem.select("l_returnflag",
                          F.when(F.col("l_linestatus") == "O", F.lit("ROWS")).otherwise(F.lit("LOG")).alias("type_desc"),
                          F.col("l_extendedprice").cast("decimal(15,2)").alias("size"),
                          F.col("l_quantity").cast("decimal(15,2)").alias("used"))
    return C.size_by_type(d, "l_returnflag", "type_desc", "size", "used")


@query("c5_space_used", """
WITH u AS (SELECT l_suppkey, l_linenumber % 3 AS index_id,
                  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS type,
                  CASE WHEN l_linenumber = 7 THEN 202 END AS internal_type,
                  CAST(l_quantity AS BIGINT) * 10 AS total_pages, CAST(l_quantity AS BIGINT) * 8 AS used_pages,
                  CAST(l_quantity AS BIGINT) * 5 AS data_pages FROM lineitem),
a AS (SELECT l_suppkey, SUM(total_pages) AS r, SUM(used_pages) AS u,
             SUM(CASE WHEN internal_type IN (202, 204, 211, 212, 213, 214, 215, 216) THEN 0
                      WHEN type <> 1 THEN used_pages WHEN index_id < 2 THEN data_pages ELSE 0 END) AS d
      FROM u GROUP BY l_suppkey),
f AS (SELECT s_suppkey AS l_suppkey, CAST((s_suppkey % 7 + 1) * 100000 AS BIGINT) AS db, CAST(20000 AS BIGINT) AS lg
      FROM supplier)
SELECT a.l_suppkey, CAST(r * 8 AS BIGINT) AS reserved_kb, CAST(d * 8 AS BIGINT) AS data_kb,
       CAST((u - d) * 8 AS BIGINT) AS index_kb, CAST(u * 8 AS BIGINT) AS used_kb,
       CAST((r - u) * 8 AS BIGINT) AS unused_kb, (f.db + f.lg) * 8 AS database_size_kb, f.lg * 8 AS log_kb,
       CAST(greatest(f.db - r, 0) * 8 AS BIGINT) AS unallocated_kb
FROM a LEFT JOIN f ON f.l_suppkey = a.l_suppkey
""")
def c5_space_used(t):
    """Space report per supplier 'database': line items as allocation units (flag = unit
    type, line 7 = XML index internals), a data and a log file per supplier."""
    li = t.lineitem
    q = F.col("l_quantity").cast("bigint")
    rf = F.col("l_returnflag")
    units = li.select("l_suppkey", (F.col("l_linenumber") % 3).alias("index_id"),
                      F.when(rf == "A", 1).when(rf == "N", 2).otherwise(3).alias("type"),
                      F.when(F.col("l_linenumber") == 7, F.lit(202)).alias("internal_type"),
                      (q * 10).alias("total_pages"), (q * 8).alias("used_pages"), (q * 5).alias("data_pages"))
    files = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(
        F.struct(((F.col("s_suppkey") % 7 + 1) * 100000).cast("bigint").alias("size"), F.lit(False).alias("is_log")),
        F.struct(F.lit(20000).cast("bigint").alias("size"), F.lit(True).alias("is_log")))).alias("f")) \
        .select("l_suppkey", "f.size", "f.is_log")
    return C.space_used(units, ["l_suppkey"], files)


def counter_tables(t):
    """Events as performance-counter exports: one counter per event type on one
    machine; readings carry a time text longer than 23 characters."""
    e = t.events
    types = e.select("event_type").distinct()
    details = types.select(F.col("event_type").alias("counter_id"),
                           F.lit("\\\\SRV01").alias("machine_name"), F.lit("Events").alias("object_name"),
                           F.col("event_type").alias("counter_name"), F.lit(None).cast("string").alias("instance_name"))
    data = e.select(
        F.col("event_type").alias("counter_id"), F.col("event_id").alias("record_index"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("000")).alias("counter_date_time"),
        F.col("value").cast("decimal(15,2)").alias("counter_value"))
    return data, details


@query("c7_pivot_counters", """
WITH e AS (SELECT event_type, date_trunc('millisecond', ts) AS counter_ts, CAST(value AS DECIMAL(15,2)) AS v FROM events)
SELECT 'SRV01' AS machine_name, counter_ts,
  CAST(SUM(CASE WHEN event_type = 'click' THEN v END) AS DECIMAL(25,2)) AS "Events\\click",
  CAST(SUM(CASE WHEN event_type = 'error' THEN v END) AS DECIMAL(25,2)) AS "Events\\error",
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN v END) AS DECIMAL(25,2)) AS "Events\\purchase",
  CAST(SUM(CASE WHEN event_type = 'signup' THEN v END) AS DECIMAL(25,2)) AS "Events\\signup",
  CAST(SUM(CASE WHEN event_type = 'view' THEN v END) AS DECIMAL(25,2)) AS "Events\\view",
  CAST(counter_ts AS DATE) AS counter_date, strftime(counter_ts, '%H:%M:%S.%g') AS counter_time
FROM e GROUP BY counter_ts
""".replace("\\\\", "\\"))
def c7_pivot_counters(t):
    """Events as counter readings (counter per event type), pivoted wide by time."""
    data, details = counter_tables(t)
    return C.pivot_counters(data, details, ["Events\\" + n for n in ("click", "error", "purchase", "signup", "view")])


@query("c7_counter_readings", """
SELECT 'SRV01' AS machine_name, counter_ts, 'Events\\' || event_type AS counter, CAST(SUM(v) AS DECIMAL(25,2)) AS counter_value,
  CAST(counter_ts AS DATE) AS counter_date, strftime(counter_ts, '%H:%M:%S.%g') AS counter_time
FROM (SELECT event_type, date_trunc('millisecond', ts) AS counter_ts, CAST(value AS DECIMAL(15,2)) AS v FROM events
      WHERE event_type LIKE '%r%') e
GROUP BY counter_ts, event_type
""".replace("\\\\", "\\"))
def c7_counter_readings(t):
    """The counters whose name holds an 'R' (case ignored) after the object, as rows."""
    data, details = counter_tables(t)
    return C.counter_readings(data, details, "events_%R%")


def _event_values(t, *more):
    return t.events.select("ts", "user_id", "event_type", *more, F.col("value").cast("decimal(15,2)").alias("value"))


@query("c8_rollup_dow_ampm", """
SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS am_pm,
  CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DOUBLE) / COUNT(value) AS avg_value,
  MAX(CAST(value AS DECIMAL(15,2))) AS max_value, COUNT(*) AS n_readings
FROM events GROUP BY 1, 2
""")
def c8_rollup_dow_ampm(t):
    """Mean and max event value by weekday and AM/PM."""
    return C.calendar_rollup(_event_values(t), "ts", ["value"], ["day_of_week", "am_pm"])


_PARTS_SQL = {
    "year": "CAST(year(ts) AS INTEGER)", "quarter": "CAST(quarter(ts) AS INTEGER)", "month": "CAST(month(ts) AS INTEGER)",
    "week": "CAST((dayofyear(ts) + dayofweek(make_date(year(ts), 1, 1)) + 1 - 2) // 7 + 1 AS INTEGER)",
    "day": "CAST(ts AS DATE)", "day_of_month": "CAST(day(ts) AS INTEGER)",
    "day_of_week": "CAST(dayofweek(ts) + 1 AS INTEGER)", "am_pm": "CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END",
    "hour": "CAST(hour(ts) AS INTEGER)", "minute": "strftime(ts, '%H:%M')"}


def _rollup_sql(by):
    keys = ", ".join(f"{_PARTS_SQL[b]} AS {b}" for b in by)
    return f"""
SELECT {keys}, CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DOUBLE) / COUNT(value) AS avg_value,
  MAX(CAST(value AS DECIMAL(15,2))) AS max_value, COUNT(*) AS n_readings
FROM events GROUP BY {", ".join(str(i + 1) for i in range(len(by)))}
"""


@query("c8_rollup_minute", _rollup_sql(["minute"]))
def c8_rollup_minute(t):
    """By minute of the day (HH:mm)."""
    return C.calendar_rollup(_event_values(t), "ts", ["value"], ["minute"])


@query("c8_rollup_all_parts", _rollup_sql(list(_PARTS_SQL)))
def c8_rollup_all_parts(t):
    """By all ten calendar and clock parts."""
    return C.calendar_rollup(_event_values(t), "ts", ["value"], list(_PARTS_SQL))


@query("c1_growth_options", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS size
           FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '2001-12-31'
             AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0))
SELECT o_custkey, o_orderkey, o_orderdate, size,
  size - COALESCE(LAG(size) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS size_growth,
  strftime(o_orderdate, '%d/%m/%Y') AS data_collection_date
FROM o WHERE size IS NOT NULL
""")
def c1_growth_options(t):
    """NULL sizes left out, a date range, and only customers that are still there (balance of 0 or more)."""
    d = _orders_sizes(t).withColumn("size", F.when(F.col("o_orderkey") % 7 != 0, F.col("size")))
    ts = lambda v: F.lit(v).cast("timestamp_ntz")
    return C.growth_report(d, ["o_custkey"], "o_orderdate", ["size"], "day", ["o_orderkey"],
                           date_from=ts("1994-01-01 00:00:00"), date_to=ts("2001-12-31 00:00:00"),
                           current=t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey")),
                           include_deleted=False)


@query("c8_rollup_week_hour_working", """
SELECT event_type, CAST(year(ts) AS INTEGER) AS year,
  CAST((dayofyear(ts) + dayofweek(make_date(year(ts), 1, 1)) + 1 - 2) // 7 + 1 AS INTEGER) AS week,
  CAST(hour(ts) AS INTEGER) AS hour,
  CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DOUBLE) / COUNT(value) AS avg_value,
  MIN(CAST(value AS DECIMAL(15,2))) AS min_value, COUNT(*) AS n_readings
FROM events
WHERE hour(ts) >= 7 AND hour(ts) < 19 AND dayofweek(ts) NOT IN (0, 6)
  AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00'
GROUP BY 1, 2, 3, 4
""")
def c8_rollup_week_hour_working(t):
    """Per event type, year, week and hour over working hours of weekdays in a range (min measure)."""
    return C.calendar_rollup(_event_values(t), "ts", ["value"], ["year", "week", "hour"],
                             date_from=F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"),
                             date_to=F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"),
                             working_hours=True, weekend=False, min_measures=["value"], extra_keys=["event_type"])


_LOG_SQL = """
WITH e AS (SELECT user_id, event_type, ts, event_id, CAST(COALESCE(value, 0) AS DECIMAL(15,2)) AS value FROM events {where}),
l AS (SELECT *, LAG(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM e),
a AS (SELECT user_id, event_type,
        CAST(SUM(CASE WHEN prev IS NULL THEN value WHEN prev > value THEN value ELSE value - prev END) AS DECIMAL(26,2))
          AS total_value,
        COUNT(CASE WHEN prev > value THEN 1 END) AS resets_value,
        arg_max(value, (ts, event_id)) AS value, MAX(ts) AS last_reading_time
      FROM l GROUP BY user_id, event_type)
"""


@query("c9_accumulate_log", _LOG_SQL.replace("{where}", "") + "SELECT * FROM a")
def c9_accumulate_log(t):
    """C9 (log form): cumulative counter totals per (user, event type) over the
    ordered readings; a lower reading is a reset."""
    ev = t.events.select("ts", "user_id", "event_type", "event_id",
                         F.col("value").cast("decimal(15,2)").alias("value"))
    return C.accumulate_log(ev, ["user_id", "event_type"], "ts", ["value"], ["event_id"])


@query("c9_accumulate_state", _LOG_SQL.replace("{where}", "WHERE ts < TIMESTAMP '2024-01-20 00:00:00'") + """,
r AS (SELECT user_id, event_type, arg_max(CAST(value AS DECIMAL(15,2)), (ts, event_id)) AS rv FROM events
      WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id, event_type)
SELECT COALESCE(a.user_id, r.user_id) AS user_id, COALESCE(a.event_type, r.event_type) AS event_type,
  CASE WHEN r.rv IS NOT NULL THEN r.rv ELSE a.value END AS value,
  CAST(CASE WHEN r.rv IS NOT NULL THEN COALESCE(a.total_value, 0) +
         CASE WHEN a.value IS NULL THEN r.rv WHEN a.value > r.rv THEN r.rv ELSE r.rv - a.value END
       ELSE a.total_value END AS DECIMAL(27,2)) AS total_value
FROM a FULL OUTER JOIN r ON a.user_id = r.user_id AND a.event_type = r.event_type
""")
def c9_accumulate_state(t):
    """C9 (state form): state from readings before Jan 20, merged with one
    snapshot (latest reading per key since then)."""
    ev = t.events.select("ts", "user_id", "event_type", "event_id", F.col("value").cast("decimal(15,2)").alias("value"))
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    state = C.accumulate_log(ev.filter(F.col("ts") < cut), ["user_id", "event_type"], "ts", ["value"], ["event_id"])
    snap = ev.filter(F.col("ts") >= cut).groupBy("user_id", "event_type").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return C.accumulate_counters(state.select("user_id", "event_type", "value", "total_value"), snap,
                                 ["user_id", "event_type"], ["value"])


@query("c10_share_of_total", """
WITH d AS (SELECT l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS bytes_read,
                  CAST(l_quantity AS BIGINT) * 1048576 AS size_bytes FROM lineitem WHERE l_returnflag <> 'R'),
a AS (SELECT l_suppkey, SUM(bytes_read) AS r, SUM(size_bytes) AS s FROM d GROUP BY l_suppkey),
t AS (SELECT SUM(bytes_read) AS total FROM d)
SELECT l_suppkey, CAST(r AS DOUBLE) / 1024 / 1024 AS mb_read, CAST(r AS DOUBLE) / 1024 / 1024 / 1024 AS gb_read,
  CAST(r AS DOUBLE) / 1024 / 1024 / 1024 / 1024 AS tb_read, CAST(s AS DOUBLE) / 1024 / 1024 AS size_on_disk_mb,
  CAST(r AS DOUBLE) / 720.0 / 1024 / 1024 / 1024 AS gb_read_hour, CAST(r AS DOUBLE) / 720.0 / CAST(s AS DOUBLE) AS ratio_read_hour,
  CAST(r AS DOUBLE) * 100 / CAST(t.total AS DOUBLE) AS percentage_reads
FROM a, t
""")
def c10_share_of_total(t):
    """C10: 'bytes read' (price in cents) per supplier, returned lines excluded as log files; 30 days since start."""
    d = t.lineitem.select("l_suppkey", "l_returnflag",
                          (F.col("l_extendedprice").cast("decimal(15,2)") * 100).cast("bigint").alias("bytes_read"),
                          (F.col("l_quantity").cast("bigint") * 1048576).alias("size_bytes"))
    return C.share_of_total(d, ["l_suppkey"], "bytes_read", "size_bytes", 30 * 86400 * 1000,
                            exclude=F.col("l_returnflag") == "R")


@query("c11_execution_rate", """
WITH p AS (SELECT user_id, MIN(ts) AS cached_time, MAX(ts) AS last_execution_time, COUNT(*) AS execution_count,
                  CAST(SUM(CAST(CAST(value AS DECIMAL(15,2)) * 100 AS BIGINT)) AS BIGINT) AS total_worker_time FROM events GROUP BY user_id),
g AS (SELECT *, CAST(epoch(date_trunc('second', last_execution_time)) - epoch(date_trunc('second', cached_time)) AS BIGINT) AS secs FROM p)
SELECT user_id, cached_time, last_execution_time, execution_count, total_worker_time,
  CASE WHEN (secs // execution_count) // 86400 <> 0 THEN CAST((secs // execution_count) // 86400 AS VARCHAR) || '.' ELSE '' END
  || lpad(CAST(((secs // execution_count) // 3600) % 24 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(((secs // execution_count) // 60) % 60 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST((secs // execution_count) % 60 AS VARCHAR), 2, '0') || '.'
  || lpad(CAST(CAST(trunc((CAST(secs AS DOUBLE) / execution_count - floor(CAST(secs AS DOUBLE) / execution_count)) * 1000) AS INTEGER) AS VARCHAR), 3, '0')
  AS executes_every,
  CAST(secs AS DOUBLE) / execution_count AS gap_seconds,
  total_worker_time // execution_count AS avg_cpu
FROM g
""")
def c11_execution_rate(t):
    """C11: users as procedures: mean gap between events, CPU (value) per execution."""
    p = t.events.groupBy("user_id").agg(
        F.min("ts").alias("cached_time"), F.max("ts").alias("last_execution_time"),
        F.count(F.lit(1)).alias("execution_count"),
        F.sum((F.col("value").cast("decimal(15,2)") * 100).cast("bigint")).cast("bigint").alias("total_worker_time"))
    return C.execution_rate(p, "cached_time", "last_execution_time", "execution_count", {"cpu": "total_worker_time"})


@query("c13_reclaim_candidates", """
WITH d AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / 1000 AS data_mb,
                  CAST(COUNT(*) * 100 AS DOUBLE) AS log_mb,
                  CAST(COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100 AS DOUBLE) / COUNT(*) AS log_used_pct
           FROM orders GROUP BY o_custkey)
SELECT *, greatest(least(log_mb * 0.5, data_mb * 0.2), 500.0) AS target_mb FROM d
WHERE log_mb > 1000.0 AND log_used_pct < 40.0
""")
def c13_reclaim_candidates(t):
    """Customers as databases: data = order value / 1000, log = 100 MB per order,
    log used = share of finished orders."""
    d = t.orders.groupBy("o_custkey").agg(
        (F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / 1000).alias("data_mb"),
        (F.count(F.lit(1)) * 100).cast("double").alias("log_mb"),
        ((F.count(F.when(F.col("o_orderstatus") == "F", 1)) * 100).cast("double") / F.count(F.lit(1))).alias("log_used_pct"))
    return C.reclaim_candidates(d, ["o_custkey"], "data_mb", "log_mb", "log_used_pct", 1000.0, 40.0, 500.0)


@query("c14_fragment_stats", """
SELECT l_suppkey, l_linenumber % 10 AS status_code, CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total_row_count,
  COUNT(*) AS n_fragments,
  CAST(trunc(CASE WHEN COUNT(l_quantity) > 1 THEN sqrt(CAST(COUNT(l_quantity) * SUM(CAST(l_quantity AS DECIMAL(20,4)) * CAST(l_quantity AS DECIMAL(20,4)))
       - SUM(CAST(l_quantity AS DECIMAL(20,4))) * SUM(CAST(l_quantity AS DECIMAL(20,4))) AS DOUBLE)
       / CAST(COUNT(l_quantity) * (COUNT(l_quantity) - 1) AS DOUBLE)) END) AS INTEGER) AS stdev_row_count,
  MAX(CAST(l_quantity AS DECIMAL(15,2))) AS max_row_count, MIN(CAST(l_quantity AS DECIMAL(15,2))) AS min_row_count,
  CASE l_linenumber % 10 WHEN 0 THEN 'Idle' WHEN 1 THEN 'Full population in progress' WHEN 2 THEN 'Paused'
    WHEN 3 THEN 'Throttled' WHEN 4 THEN 'Recovering' WHEN 5 THEN 'Shutdown' WHEN 6 THEN 'Incremental population in progress'
    WHEN 7 THEN 'Building index' WHEN 8 THEN 'Disk is full. Paused.' WHEN 9 THEN 'Change tracking' END AS status
FROM lineitem GROUP BY l_suppkey, l_linenumber % 10
""")
def c14_fragment_stats(t):
    """C14: per supplier and line-number status code: fragment (quantity) statistics."""
    d = t.lineitem.select("l_suppkey", (F.col("l_linenumber") % 10).alias("status_code"),
                          F.col("l_quantity").cast("decimal(15,2)").alias("rows"))
    out = C.fragment_stats(d, ["l_suppkey", "status_code"], "rows", status="status_code")
    return out


FILES_SQL = r"""
SELECT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS database_id, p_partkey AS file_id, p_name AS logical_name,
  CASE WHEN p_size % 2 = 0 THEN 'ROWS' ELSE 'LOG' END AS type_desc, CAST(p_size * 20000 AS BIGINT) AS size,
  CAST(floor(p_retailprice * 10) AS BIGINT) AS space_used,
  CASE WHEN p_size % 5 = 0 THEN 10 ELSE p_size * 128 END AS growth, p_size % 5 = 0 AS is_percent_growth,
  CASE p_size % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE p_size * 100000 END AS max_size,
  CASE p_size % 3 WHEN 0 THEN 'C:' WHEN 1 THEN 'D:' ELSE 'E:' END || '\data\' || p_type || '\' || replace(p_name, ' ', '_') || '.mdf'
    AS physical_name
FROM part
"""


def data_files(t):
    """Parts as data/log files: brand = database, size from p_size, used pages
    from the retail price, growth and cap rules by p_size, three drives."""
    p = t.part
    sz = F.col("p_size")
    drive = F.when(sz % 3 == 0, "C:").when(sz % 3 == 1, "D:").otherwise("E:")
    return p.select(
        F.substring_index("p_brand", "#", -1).cast("int").alias("database_id"), F.col("p_partkey").alias("file_id"),
        F.col("p_name").alias("logical_name"), F.when(sz % 2 == 0, "ROWS").otherwise("LOG").alias("type_desc"),
        (sz * 20000).cast("bigint").alias("size"), F.floor(F.col("p_retailprice") * 10).cast("bigint").alias("space_used"),
        F.when(sz % 5 == 0, 10).otherwise(sz * 128).alias("growth"), (sz % 5 == 0).alias("is_percent_growth"),
        F.when(sz % 3 == 0, -1).when(sz % 3 == 1, 0).otherwise(sz * 100000).alias("max_size"),
        F.concat(drive, F.lit("\\data\\"), F.col("p_type"), F.lit("\\"), F.regexp_replace("p_name", " ", "_"),
                 F.lit(".mdf")).alias("physical_name"))


def volumes(files):
    """Volume size and free space per drive, derived from the files on it."""
    from fleetsight.functions.scalar import file_drive, int_div
    v = files.groupBy(file_drive("physical_name").alias("drive")).agg(
        F.sum("size").alias("__s"), F.sum("space_used").alias("__u"))
    size_mb = int_div(F.col("__s") * 16, 1024)
    return v.select("drive", size_mb.alias("size_mb"), (size_mb - int_div(F.col("__u") * 8, 1024)).alias("free_mb"))


@query("c6_file_usage", f"""
WITH f AS ({FILES_SQL}),
v AS (SELECT split_part(physical_name, '\\', 1) AS drive, SUM(size) * 16 // 1024 AS size_mb,
             SUM(size) * 16 // 1024 - SUM(space_used) * 8 // 1024 AS free_mb FROM f GROUP BY 1)
SELECT f.*, CAST(CAST(size AS DECIMAL(20,0)) * 8 / 1024 AS DECIMAL(10,2)) AS size_mb,
  CAST(CAST(space_used AS DECIMAL(20,0)) * 8 / 1024 AS DECIMAL(10,2)) AS used_mb,
  CAST(CAST(size AS DECIMAL(20,0)) * 8 / 1024 AS DECIMAL(10,2)) - CAST(CAST(space_used AS DECIMAL(20,0)) * 8 / 1024 AS DECIMAL(10,2)) AS free_mb,
  -- exact half-up rounding of space_used * 100 / size to 2 decimals
  CAST(CAST((space_used * 20000 + size) // (2 * NULLIF(size, 0)) AS DOUBLE) / 100 AS DECIMAL(10,2)) AS percentage_used,
  CASE WHEN growth = 0 THEN 'None' ELSE 'By ' || CASE WHEN is_percent_growth THEN CAST(growth AS VARCHAR) || '%'
       ELSE CAST(CAST(trunc(growth * 8 / 1024) AS BIGINT) AS VARCHAR) || ' MB' END || ', ' ||
       CASE WHEN max_size = 0 THEN 'No' WHEN max_size = -1 THEN 'Unlimited'
            ELSE 'Limited to ' || CAST(CAST(trunc(CAST(max_size AS BIGINT) * 8 / 1024) AS BIGINT) AS VARCHAR) || ' MB' END END
    AS autogrowth_maxsize,
  substr(physical_name, 1, length(physical_name) - length(split_part(physical_name, '\\', -1))) AS path,
  split_part(physical_name, '\\', -1) AS file_name, split_part(physical_name, '\\', 1) AS drive,
  CASE WHEN size * 8 // 1024 < 1024 THEN NULL WHEN space_used * 8 // 1024 < 1024 THEN 1024
       WHEN space_used * 8 // 1024 < 2048 THEN 2048 ELSE CAST(ceil(space_used * 8 / 1024 / 1024) AS BIGINT) * 1024 END
    AS shrink_target_mb,
  CASE WHEN is_percent_growth OR CAST(trunc(growth * 8 / 1024) AS BIGINT) <
       (CASE WHEN size * 8.0 / 1024 > 10000 THEN 4000 WHEN size * 8.0 / 1024 > 4000 THEN 1000
             WHEN size * 8.0 / 1024 > 1000 THEN 500 ELSE 100 END)
       THEN (CASE WHEN size * 8.0 / 1024 > 10000 THEN 4000 WHEN size * 8.0 / 1024 > 4000 THEN 1000
                  WHEN size * 8.0 / 1024 > 1000 THEN 500 ELSE 100 END) END AS suggested_growth_mb,
  CAST(v.size_mb / 1024 AS DECIMAL(10,2)) AS drive_size_gb, CAST(v.free_mb / 1024 AS DECIMAL(10,2)) AS drive_free_gb,
  CAST(trunc(v.free_mb * 100 / v.size_mb) AS BIGINT) AS drive_free_percent
FROM f LEFT JOIN v ON v.drive = split_part(f.physical_name, '\\', 1)
""".replace("\\\\", "\\"))
def c6_file_usage(t):
    """Parts as data/log files on three drives; volumes derived per drive."""
    f = data_files(t)
    return C.file_usage(f, volumes(f))


@query("c6_one_file_per_drive", f"""
WITH f AS ({FILES_SQL})
SELECT split_part(physical_name, '\\', 1) AS drive, arg_min(database_id, (database_id, file_id)) AS database_id,
  arg_min(file_id, (database_id, file_id)) AS file_id, arg_min(logical_name, (database_id, file_id)) AS logical_name,
  arg_min(type_desc, (database_id, file_id)) AS type_desc, arg_min(size, (database_id, file_id)) AS size,
  arg_min(space_used, (database_id, file_id)) AS space_used, arg_min(growth, (database_id, file_id)) AS growth,
  arg_min(is_percent_growth, (database_id, file_id)) AS is_percent_growth,
  arg_min(max_size, (database_id, file_id)) AS max_size, arg_min(physical_name, (database_id, file_id)) AS physical_name
FROM f GROUP BY 1
""".replace("\\\\", "\\"))
def c6_one_file_per_drive(t):
    """One file per drive (smallest database id, then file id)."""
    return C.one_file_per_drive(data_files(t))


def requests_from_turns(t):
    c = t.conversations
    sid = F.col("conv_id") * 100 + F.col("turn")
    return c.select(
        sid.alias("session_id"), sid.alias("sql_handle"), F.col("text"),
        F.timestamp_add("MINUTE", F.col("conv_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("start_time"),
        ((F.col("turn") + 1) * 10 % 100).alias("percent_complete"),
        (F.col("turn") * 2).alias("statement_start_offset"),
        F.when(F.col("turn") % 2 == 0, F.lit(-1)).otherwise(F.col("turn") * 2 + 40).alias("statement_end_offset"),
        F.when(F.col("turn") > 0, sid - 1).alias("blocking_session_id"))


@query("c12_running_report", """
WITH r AS (
  SELECT conv_id * 100 + turn AS session_id, conv_id * 100 + turn AS sql_handle, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) AS start_time, (turn + 1) * 10 % 100 AS percent_complete,
    turn * 2 AS statement_start_offset, CASE WHEN turn % 2 = 0 THEN -1 ELSE turn * 2 + 40 END AS statement_end_offset,
    CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS blocking_session_id
  FROM conversations),
s AS (SELECT *, CAST(epoch(TIMESTAMP '2024-01-02 00:00:00') - epoch(start_time) AS BIGINT) AS el,
        substr(text, CAST(statement_start_offset // 2 + 1 AS INTEGER),
               CAST(CASE WHEN statement_end_offset = -1 THEN length(text) + 1
                         ELSE (statement_end_offset - statement_start_offset) // 2 + 1 END AS INTEGER)) AS statement
      FROM r)
SELECT s.sql_handle, s.session_id, s.text, s.start_time, s.percent_complete, s.statement_start_offset,
  s.statement_end_offset, s.blocking_session_id,
  CASE WHEN s.el // 86400 <> 0 THEN CAST(s.el // 86400 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST((s.el // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((s.el // 60) % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(s.el % 60 AS VARCHAR), 2, '0') AS elapsed,
  s.statement,
  CASE WHEN s.percent_complete > 0 THEN s.start_time + to_seconds(s.el * 100 // s.percent_complete) END AS estimated_end,
  b.statement AS blocking_statement
FROM s LEFT JOIN s b ON b.session_id = s.blocking_session_id
""")
def c12_running_report(t):
    """Conversation turns as running requests (turn n blocked by turn n-1)."""
    r = requests_from_turns(t)
    texts = r.select("sql_handle", "text")
    return C.running_report(r.drop("text"), texts, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))


_SESSIONS_SQL = """
WITH r AS (
  SELECT conv_id * 100 + turn AS session_id, role AS login_name, 'conv_' || CAST(conv_id % 7 AS VARCHAR) AS program_name,
    turn % 5 <> 4 AS is_user_process, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) AS start_time,
    CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS blocking_session_id,
    substr(text, CAST(turn + 1 AS INTEGER),
           CAST(CASE WHEN turn % 2 = 0 THEN length(text) + 1 ELSE 21 END AS INTEGER)) AS statement
  FROM conversations)
SELECT r.session_id, r.start_time, r.statement, b.statement AS blocking_statement, r.login_name, r.program_name
FROM r LEFT JOIN r b ON b.session_id = r.blocking_session_id
"""


def _running_sessions(t, **options):
    """Turns as requests, their speakers as logins; every fifth turn is a system session."""
    r = requests_from_turns(t)
    report = C.running_report(r.drop("text"), r.select("sql_handle", "text"),
                              F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    sessions = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("session_id"), F.col("role").alias("login_name"),
        F.concat(F.lit("conv_"), (F.col("conv_id") % 7).cast("string")).alias("program_name"),
        (F.col("turn") % 5 != 4).alias("is_user_process"))
    return C.running_sessions(report, sessions, **options).select(
        "session_id", "start_time", "statement", "blocking_statement", "login_name", "program_name")


@query("c12_running_sessions", _SESSIONS_SQL + "WHERE r.is_user_process AND r.login_name = 'user' AND r.session_id <> 100")
def c12_running_sessions(t):
    """Requests with their sessions: one login's user sessions without the asking one."""
    return _running_sessions(t, own=100, login="USER")


@query("c12_running_sessions_top", _SESSIONS_SQL + "WHERE r.is_user_process ORDER BY r.start_time, r.session_id LIMIT 25")
def c12_running_sessions_top(t):
    """The 25 requests that have run longest."""
    return _running_sessions(t, n=25)


@query("c12_blocked_by_session", _SESSIONS_SQL
       + "WHERE r.is_user_process AND (r.session_id = 101 OR r.blocking_session_id = 101)")
def c12_blocked_by_session(t):
    """One session and those that it blocks."""
    return _running_sessions(t, session=101)


@query("c10_share_of_total_top", """
WITH d AS (SELECT l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS bytes_read,
                  CAST(l_quantity AS BIGINT) * 1048576 AS size_bytes FROM lineitem WHERE l_returnflag <> 'R'),
a AS (SELECT l_partkey, SUM(bytes_read) AS r, SUM(size_bytes) AS s FROM d GROUP BY l_partkey
      ORDER BY r DESC, l_partkey LIMIT 20),
t AS (SELECT SUM(bytes_read) AS total FROM d)
SELECT l_partkey, CAST(r AS DOUBLE) / 1024 / 1024 AS mb_read, CAST(r AS DOUBLE) / 1024 / 1024 / 1024 AS gb_read,
  CAST(r AS DOUBLE) / 1024 / 1024 / 1024 / 1024 AS tb_read, CAST(s AS DOUBLE) / 1024 / 1024 AS size_on_disk_mb,
  CAST(r AS DOUBLE) / 720.0 / 1024 / 1024 / 1024 AS gb_read_hour, CAST(r AS DOUBLE) / 720.0 / CAST(s AS DOUBLE) AS ratio_read_hour,
  CAST(r AS DOUBLE) * 100 / CAST(t.total AS DOUBLE) AS percentage_reads
FROM a, t
""")
def c10_share_of_total_top(t):
    """The 20 parts that are read most, with their share of all reads."""
    d = t.lineitem.select("l_partkey", "l_returnflag",
                          (F.col("l_extendedprice").cast("decimal(15,2)") * 100).cast("bigint").alias("bytes_read"),
                          (F.col("l_quantity").cast("bigint") * 1048576).alias("size_bytes"))
    return C.share_of_total(d, ["l_partkey"], "bytes_read", "size_bytes", 30 * 86400 * 1000,
                            exclude=F.col("l_returnflag") == "R", n=20)


_STATE_SETS = [["day"], ["minute"], ["day_of_week", "am_pm"], ["year", "week", "hour"], list(_PARTS_SQL), []]


def _states_sql():
    out = []
    for parts in _STATE_SETS:
        cols = ", ".join(f"{_PARTS_SQL[p]} AS {p}" if p in parts else f"NULL AS {p}" for p in _PARTS_SQL)
        name = ",".join(p for p in _PARTS_SQL if p in parts)
        out.append(f"""
SELECT '{name}' AS part_set, event_type, {cols}, COUNT(*) AS n_readings,
  CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DOUBLE) / COUNT(value) AS avg_value,
  MAX(CAST(value AS DECIMAL(15,2))) AS max_value FROM events GROUP BY ALL""")
    return " UNION ALL ".join(out)


def _rollup_store(t):
    spark = t.events.sparkSession
    return RollupStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/c8-states-{uuid.uuid4().hex}", ["value"],
                       ["event_type"])


@query("c8_rollup_from_states", _states_sql())
def c8_rollup_from_states(t):
    """Six sets of parts in one pass over states merged from three loads: readings up to Jan 20, the later
    ones (loaded twice, the second time after the first load was compacted), and late readings of both times."""
    ev, store = _event_values(t, "event_id"), _rollup_store(t)
    late, cut = F.col("event_id") % 10 == 3, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    store.load(ev.filter(~late & (F.col("ts") < cut)), "ts", 1)
    store.load(ev.filter(~late & (F.col("ts") >= cut)), "ts", 2)
    store.compact(1)
    store.load(ev.filter(~late & (F.col("ts") >= cut)), "ts", 2)
    store.load(ev.filter(late), "ts", 3)
    out = rollup_from_states(store.states(), ["value"], _STATE_SETS, keys=["event_type"])
    return out.select("part_set", "event_type", *_PARTS_SQL, "n_readings", "avg_value",
                      F.col("max_value").cast("decimal(15,2)").alias("max_value"))
