"""Registered queries for backup and job compliance (E).

Orders stand in for backup sets of customer 'databases' (1-URGENT orders
are log backups, 2-HIGH differentials, the rest full), their line items for
the media families; events stand in for backup files and chains.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.operators import compliance as E
from fleetsight.plans.registry import query

SETS_SQL = """
SELECT o_orderkey AS backup_set_id, o_orderkey AS media_set_id, o_custkey AS database_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'L' WHEN '2-HIGH' THEN 'I' ELSE 'D' END AS type,
  o_orderdate AS backup_start_date,
  o_orderdate + to_seconds(CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) // 1000) AS backup_finish_date,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) * 1024 AS backup_size,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) * 600 AS compressed_backup_size
FROM orders
"""


def backup_sets(t):
    """Orders as backup sets of customer databases (type by priority, size from
    the price, duration in whole seconds)."""
    o = t.orders
    cents = (F.col("o_totalprice").cast("decimal(15,2)") * 100).cast("bigint")
    typ = (F.when(F.col("o_orderpriority") == "1-URGENT", "L").when(F.col("o_orderpriority") == "2-HIGH", "I")
           .otherwise("D"))
    return o.select(F.col("o_orderkey").alias("backup_set_id"), F.col("o_orderkey").alias("media_set_id"),
                    F.col("o_custkey").alias("database_id"), typ.alias("type"),
                    F.col("o_orderdate").alias("backup_start_date"),
                    (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (cents / 1000).cast("bigint")))
                    .alias("backup_finish_date"),
                    (cents * 1024).alias("backup_size"), (cents * 600).alias("compressed_backup_size"))


def backup_media(t):
    return t.lineitem.select(F.col("l_orderkey").alias("media_set_id"),
                             F.concat(F.lit("\\\\nas\\dev"), F.col("l_linenumber").cast("string"), F.lit("_"),
                                      F.col("l_suppkey").cast("string")).alias("physical_device_name"),
                             F.col("l_linenumber").alias("family_sequence_number"))


DEV = r"""'\\nas\dev' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR)"""

def _measures_sql(b):
    secs = (f"CAST(epoch(date_trunc('second', {b}.backup_finish_date)) - epoch(date_trunc('second', {b}.backup_start_date)) "
            "AS BIGINT)")
    return f"""CAST(trunc({b}.backup_size / 1048576) AS BIGINT) AS size_mb,
  CAST(trunc({b}.compressed_backup_size / 1048576) AS BIGINT) AS compressed_size_mb,
  CAST({b}.backup_size / 1073741824 AS DECIMAL(10,2)) AS size_gb,
  CAST({b}.compressed_backup_size / 1073741824 AS DECIMAL(10,2)) AS compressed_size_gb,
  100.0 - CAST({b}.compressed_backup_size AS DOUBLE) * 100 / NULLIF(CAST({b}.backup_size AS DOUBLE), 0.0) AS compression_pct,
  CAST({b}.compressed_backup_size AS DOUBLE) / 1048576 / CAST({secs} + 1 AS DOUBLE) AS mb_per_sec,
  CASE WHEN {secs} // 86400 <> 0 THEN CAST({secs} // 86400 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST(({secs} // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({secs} // 60) % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST({secs} % 60 AS VARCHAR), 2, '0') AS duration"""


_E1_SQL = f"""
WITH s AS ({SETS_SQL}),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY database_id ORDER BY backup_set_id DESC) AS backup_rank
                       FROM s WHERE type <> 'L') x WHERE backup_rank <= 3),
dev AS (SELECT l_orderkey AS media_set_id,
               string_agg({DEV}, ', ' ORDER BY l_linenumber, {DEV}) AS devices
        FROM lineitem GROUP BY l_orderkey),
m AS (SELECT top.*, CAST(epoch(date_trunc('second', backup_finish_date)) - epoch(date_trunc('second', backup_start_date)) AS BIGINT) AS secs
      FROM top)
SELECT m.backup_set_id, m.media_set_id, m.database_id, m.type, m.backup_start_date, m.backup_finish_date, m.backup_size,
  m.compressed_backup_size, CAST(m.backup_rank AS INTEGER) AS backup_rank,
  CAST(trunc(m.backup_size / 1048576) AS BIGINT) AS size_mb, CAST(trunc(m.compressed_backup_size / 1048576) AS BIGINT) AS compressed_size_mb,
  CAST(m.backup_size / 1073741824 AS DECIMAL(10,2)) AS size_gb,
  CAST(m.compressed_backup_size / 1073741824 AS DECIMAL(10,2)) AS compressed_size_gb,
  100.0 - CAST(m.compressed_backup_size AS DOUBLE) * 100 / NULLIF(CAST(m.backup_size AS DOUBLE), 0.0) AS compression_pct,
  CAST(m.compressed_backup_size AS DOUBLE) / 1048576 / CAST(m.secs + 1 AS DOUBLE) AS mb_per_sec,
  CASE WHEN m.secs // 86400 <> 0 THEN CAST(m.secs // 86400 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST((m.secs // 3600) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((m.secs // 60) % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(m.secs % 60 AS VARCHAR), 2, '0') AS duration,
  CASE m.type WHEN 'D' THEN 'Database' WHEN 'I' THEN 'Differential database' WHEN 'L' THEN 'Log' END AS backup_type,
  dev.devices
FROM m LEFT JOIN dev ON dev.media_set_id = m.media_set_id
"""


@query("e1_last_n_backups", _E1_SQL)
def e1_last_n_backups(t):
    """Last 3 non-log backups per customer with measures and device lists."""
    return E.last_n_backups(backup_sets(t), backup_media(t), 3, key=["database_id"])


@query("e1_last_n_backups_all_entities", """
WITH s AS (""" + SETS_SQL + """),
top AS (SELECT backup_set_id, database_id, type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY database_id
          ORDER BY backup_set_id DESC) AS rn FROM s WHERE type = 'D') x WHERE rn <= 2)
SELECT c.c_custkey AS database_id, c.c_name, top.backup_set_id,
  COALESCE(CASE top.type WHEN 'D' THEN 'Database' END, '-') AS backup_type
FROM customer c LEFT JOIN top ON top.database_id = c.c_custkey
""")
def e1_last_n_backups_all_entities(t):
    """E1 variant: last 2 full backups per customer, customers without any shown with '-'."""
    ent = t.customer.select(F.col("c_custkey").alias("database_id"), "c_name")
    out = E.last_n_backups(backup_sets(t), None, 2, key=["database_id"], backup_type="D", entities=ent)
    return out.select("database_id", "c_name", "backup_set_id", "backup_type")


SCHEDULE_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN 'DIIIIII' WHEN 'MACHINERY' THEN 'D-D-D-D' ELSE 'DDDDDDD' END"""


def schedules(t):
    seg = F.col("c_mktsegment")
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                             F.when(seg == "BUILDING", "DIIIIII").when(seg == "MACHINERY", "D-D-D-D")
                             .otherwise("DDDDDDD").alias("backup_schedule"))


@query("e2_schedule_compliance", f"""
WITH s AS ({SETS_SQL}),
d AS (SELECT CAST(g AS DATE) AS date FROM generate_series(TIMESTAMP '1998-07-02', TIMESTAMP '1998-07-31', INTERVAL 1 DAY) t(g)),
e AS (SELECT c_custkey, {SCHEDULE_SQL} AS backup_schedule FROM customer),
b AS (SELECT *, CAST(backup_start_date AS DATE) AS bd FROM s WHERE type IN ('D', 'I')
      AND backup_start_date >= TIMESTAMP '1998-07-02' AND backup_start_date < TIMESTAMP '1998-08-01')
SELECT e.c_custkey, e.backup_schedule, d.date, substr(e.backup_schedule, dayofweek(d.date) + 1, 1) AS scheduled_type,
  b.backup_set_id, b.media_set_id, b.database_id, b.type, b.backup_start_date, b.backup_finish_date, b.backup_size,
  b.compressed_backup_size, CASE b.type WHEN 'D' THEN 'Database' WHEN 'I' THEN 'Differential database' END AS backup_type,
  {_measures_sql("b")}
FROM e CROSS JOIN d LEFT JOIN b ON b.database_id = e.c_custkey AND b.bd = d.date
""")
def e2_schedule_compliance(t):
    """30-day spine per customer with the planned backup type and the orders ('backups') of that day."""
    ent = schedules(t).select("c_custkey", "backup_schedule")
    return E.schedule_compliance(ent, backup_sets(t), key="c_custkey", schedule="backup_schedule",
                                 today=F.lit("1998-08-01").cast("date"), days=30, event_key="database_id",
                                 event_ts="backup_start_date", event_type="type", finish="backup_finish_date",
                                 size="backup_size", compressed="compressed_backup_size")


@query("e1_last_n_backups_all_types", f"""
WITH s AS ({SETS_SQL}),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY database_id ORDER BY backup_set_id DESC) AS backup_rank
                       FROM s) x WHERE backup_rank <= 2)
SELECT top.* EXCLUDE (backup_rank), CAST(backup_rank AS INTEGER) AS backup_rank, {_measures_sql("top")},
  CASE type WHEN 'D' THEN 'Database' WHEN 'I' THEN 'Differential database' WHEN 'L' THEN 'Log' END AS backup_type
FROM top
""")
def e1_last_n_backups_all_types(t):
    """Last 2 backups of any type per customer."""
    return E.last_n_backups(backup_sets(t), None, 2, key=["database_id"], backup_type=None)


@query("e3_due_by_name", f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, {SCHEDULE_SQL} AS backup_schedule,
  substr({SCHEDULE_SQL}, 2, 1) AS scheduled_type
FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000070')
""")
def e3_due_by_name(t):
    """Explicit names override schedule and batch."""
    return E.due_today(schedules(t).withColumn("b", F.lit(1)), schedule="backup_schedule", weekday=2, batch_col="b",
                       names=["Customer#000000007", "Customer#000000070"], name_col="c_name").drop("b")


@query("e3_due_today", f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, {SCHEDULE_SQL} AS backup_schedule,
  substr({SCHEDULE_SQL}, 3, 1) AS scheduled_type,
  CASE WHEN c_acctbal > 9000 THEN 'PHYSICAL_ONLY' ELSE 'FULL' END AS check_type
FROM customer
WHERE substr({SCHEDULE_SQL}, 3, 1) IN ('D') AND COALESCE(c_nationkey % 4, 0) = 1
""")
def e3_due_today(t):
    """Customers with a full backup due on Tuesday in batch 1 (nation % 4);
    big accounts get the light check outside every fourth week."""
    s = schedules(t).withColumn("batch_no", F.col("c_nationkey") % 4)
    out = E.due_today(s, schedule="backup_schedule", weekday=3, wanted=["D"], batch_col="batch_no", batch=1,
                      size_col="c_acctbal", big_size=9000, week_of_year=1)
    return out.drop("batch_no")


FILES_SQL = """
SELECT user_id, event_id AS file_id,
  'db' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d%H') || '_' || CAST(event_id AS VARCHAR) ||
  CASE event_type WHEN 'purchase' THEN '.bak' WHEN 'error' THEN '.bak' WHEN 'view' THEN '.trn'
                  WHEN 'click' THEN '.diff' ELSE '.log' END AS file_name
FROM events
"""


def backup_files(t):
    et = F.col("event_type")
    ext = (F.when(et.isin("purchase", "error"), ".bak").when(et == "view", ".trn").when(et == "click", ".diff")
           .otherwise(".log"))
    return t.events.select("user_id", F.col("event_id").alias("file_id"),
                           F.concat(F.lit("db"), F.col("user_id").cast("string"), F.lit("_"),
                                    F.date_format("ts", "yyyyMMddHH"), F.lit("_"), F.col("event_id").cast("string"), ext)
                           .alias("file_name"))


@query("e4_retention_expired", f"""
WITH f AS ({FILES_SQL}),
g AS (SELECT user_id, split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) AS prefix, MIN(file_id) AS min_id
      FROM f WHERE file_name LIKE '%.bak' GROUP BY 1, 2),
k AS (SELECT user_id, min_id AS min_id_to_keep FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY min_id DESC) AS rn FROM g) x WHERE rn = 5)
SELECT f.user_id, f.file_id, f.file_name, k.min_id_to_keep FROM f JOIN k ON k.user_id = f.user_id
WHERE (f.file_name LIKE '%.bak' OR f.file_name LIKE '%.trn' OR f.file_name LIKE '%.diff') AND f.file_id < k.min_id_to_keep
""")
def e4_retention_expired(t):
    """Per user 'database', files older than the 5th newest full-backup
    group (grouped by name prefix up to the hour) expire."""
    prefix = F.concat(F.substring_index("file_name", "_", 2))
    return E.retention_expired(backup_files(t), key=["user_id"], file_id="file_id", file_name="file_name",
                               prefix=prefix, keep_n=5)


CHAIN_SQL = """
SELECT user_id, event_id AS backup_set_id, ts AS backup_start_date,
  CASE event_type WHEN 'signup' THEN 'D' WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'I' ELSE 'L' END AS type,
  event_type = 'error' AS is_copy_only
FROM events
"""


@query("e5_restore_chain", f"""
WITH b AS ({CHAIN_SQL}), c AS (SELECT * FROM b WHERE backup_start_date <= TIMESTAMP '2024-01-20 00:00:00'),
f AS (SELECT user_id, MAX(backup_start_date) AS fmax FROM c WHERE type = 'D' AND NOT is_copy_only GROUP BY user_id),
j AS (SELECT c.*, f.fmax FROM c JOIN f ON f.user_id = c.user_id WHERE c.backup_start_date >= f.fmax),
d AS (SELECT user_id, MAX(backup_start_date) AS dmax FROM j WHERE type = 'I' GROUP BY user_id)
SELECT j.user_id, j.backup_set_id, j.backup_start_date, j.type, j.is_copy_only,
  CASE WHEN j.type = 'D' THEN 1 WHEN j.type = 'I' THEN 2 ELSE 3 END AS step
FROM j LEFT JOIN d ON d.user_id = j.user_id
WHERE (j.type = 'D' AND j.backup_start_date = j.fmax AND NOT j.is_copy_only)
   OR (j.type = 'I' AND j.backup_start_date = d.dmax)
   OR (j.type = 'L' AND j.backup_start_date > COALESCE(d.dmax, j.fmax))
""")
def e5_restore_chain(t):
    """E5: per user the chain full -> differential -> logs needed for a restore to Jan 20."""
    et = F.col("event_type")
    b = t.events.select("user_id", F.col("event_id").alias("backup_set_id"), F.col("ts").alias("backup_start_date"),
                        F.when(et.isin("signup", "error"), "D").when(et == "purchase", "I").otherwise("L").alias("type"),
                        (et == "error").alias("is_copy_only"))
    return E.restore_chain(b, key=["user_id"], target=F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("e6_last_n_checks", """
SELECT * REPLACE (CAST(check_rank AS INTEGER) AS check_rank) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS check_rank
  FROM orders) x WHERE check_rank <= 2
""")
def e6_last_n_checks(t):
    """Last 2 'checks' (orders) per (status as server, customer as database)."""
    return E.last_n_checks(t.orders, ["o_orderstatus", "o_custkey"], "o_orderdate", 2, "o_orderkey")


@query("e6_last_check", """
SELECT o_orderstatus, o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice,
  arg_max(o_orderdate, o_orderkey) AS o_orderdate, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority
FROM orders GROUP BY o_orderstatus, o_custkey
""")
def e6_last_check(t):
    """Latest check by id per (server, database)."""
    return E.last_check(t.orders, ["o_orderstatus", "o_custkey"], "o_orderkey")


@query("e8_align_steps_to_run", """
WITH runs AS (SELECT user_id, event_id AS run_first_id, ts AS run_start FROM events WHERE event_type = 'signup'),
steps AS (SELECT DISTINCT user_id, event_type FROM events),
r AS (SELECT runs.*, steps.event_type FROM runs JOIN steps ON steps.user_id = runs.user_id),
h AS (SELECT user_id, event_type, event_id, ts, value FROM events)
SELECT r.user_id, r.run_first_id, r.run_start, r.event_type,
  (SELECT MIN(h.event_id) FROM h WHERE h.user_id = r.user_id AND h.event_type = r.event_type AND h.event_id >= r.run_first_id) AS step_event_id,
  (SELECT arg_min(h.ts, h.event_id) FROM h WHERE h.user_id = r.user_id AND h.event_type = r.event_type AND h.event_id >= r.run_first_id) AS step_ts
FROM r WHERE EXISTS (SELECT 1 FROM h WHERE h.user_id = r.user_id AND h.event_type = r.event_type AND h.event_id >= r.run_first_id)
""")
def e8_align_steps_to_run(t):
    """For each 'run' (signup event) and 'step' (event type), the first event of that
    type with id >= the run's first id (forward as-of)."""
    e = t.events
    runs = e.filter(F.col("event_type") == "signup").select("user_id", F.col("event_id").alias("run_first_id"),
                                                            F.col("ts").alias("run_start"))
    # one row per run and step of that job: the steps are the user's own event types
    steps = e.select("user_id", "event_type").distinct()
    runs = runs.join(steps, "user_id")
    hist = e.select("user_id", "event_type", "event_id", "ts", "value")
    out = E.align_steps_to_run(runs, hist, keys=["user_id", "event_type"], run_first_id="run_first_id",
                               hist_id="event_id", hist_cols=["ts"], bucket_width=512)
    return out.select("user_id", "run_first_id", "run_start", "event_type",
                      F.col("step_row.event_id").alias("step_event_id"), F.col("step_row.ts").alias("step_ts"))


def job_tables(t):
    """Events as a job system: a job per event type (plus one idle job per type
    that never ran), steps 1-3 per job, every event a history row whose step is
    user_id % 4 (step 0 rows have no step definition)."""
    e = t.events
    types = e.select(F.col("event_type").alias("job_id")).distinct()
    jobs = types.select("job_id", F.upper("job_id").alias("job_name"), F.lit(True).alias("enabled")).unionByName(
        types.select(F.concat(F.lit("idle_"), F.col("job_id")).alias("job_id"),
                     F.upper(F.concat(F.lit("idle_"), F.col("job_id"))).alias("job_name"), F.lit(False).alias("enabled")))
    steps = (e.select(F.col("event_type").alias("job_id"), (F.col("user_id") % 4).cast("int").alias("step_id"))
             .filter(F.col("step_id") > 0).distinct()
             .withColumn("step_name", F.concat(F.lit("step "), F.col("step_id").cast("string"))))
    hist = e.select(F.col("event_type").alias("job_id"), (F.col("user_id") % 4).cast("int").alias("step_id"),
                    F.col("event_id").alias("instance_id"),
                    F.date_format("ts", "yyyyMMdd").cast("int").alias("run_date"),
                    F.date_format("ts", "HHmmss").cast("int").alias("run_time"),
                    F.floor(F.col("value") * 100).cast("int").alias("run_duration"),
                    (F.col("event_id") % 5).cast("int").alias("run_status"))
    return jobs, steps, hist


_STATUS_SQL = ("CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' "
               "WHEN 3 THEN 'Canceled' WHEN 4 THEN 'In Progress' ELSE '-' END")


@query("e7_job_history", f"""
WITH jobs AS (SELECT DISTINCT event_type AS job_id, upper(event_type) AS job_name, true AS enabled FROM events
              UNION ALL SELECT DISTINCT 'idle_' || event_type, upper('idle_' || event_type), false FROM events),
steps AS (SELECT DISTINCT event_type AS job_id, CAST(user_id % 4 AS INTEGER) AS step_id,
                 'step ' || CAST(user_id % 4 AS VARCHAR) AS step_name FROM events WHERE user_id % 4 > 0),
h AS (SELECT event_type AS job_id, CAST(user_id % 4 AS INTEGER) AS step_id, event_id AS instance_id,
             CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS run_date, CAST(strftime(ts, '%H%M%S') AS INTEGER) AS run_time,
             CAST(floor(value * 100) AS INTEGER) AS run_duration, CAST(event_id % 5 AS INTEGER) AS run_status,
             date_trunc('second', ts) AS run_datetime FROM events),
h2 AS (SELECT *, {_STATUS_SQL} AS run_status_text,
         CASE WHEN COALESCE(run_date, 0) > 0 THEN
           substr(lpad(CAST(run_date AS VARCHAR), 8, '0'), 1, 4) || '-' || substr(lpad(CAST(run_date AS VARCHAR), 8, '0'), 5, 2)
           || '-' || substr(lpad(CAST(run_date AS VARCHAR), 8, '0'), 7, 2) || ' ' ||
           CASE WHEN run_time // 10000 // 24 <> 0 THEN CAST(run_time // 10000 // 24 AS VARCHAR) || '.' ELSE '' END
           || lpad(CAST((run_time // 10000) % 24 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST((run_time // 100) % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(run_time % 100 AS VARCHAR), 2, '0')
         ELSE '-' END AS run_text,
         CASE WHEN run_duration // 10000 // 24 <> 0 THEN CAST(run_duration // 10000 // 24 AS VARCHAR) || '.' ELSE '' END
         || lpad(CAST((run_duration // 10000) % 24 AS VARCHAR), 2, '0') || ':'
         || lpad(CAST((run_duration // 100) % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(run_duration % 100 AS VARCHAR), 2, '0')
           AS run_duration_text,
         CAST(ROW_NUMBER() OVER (PARTITION BY job_id, step_id ORDER BY run_datetime DESC, instance_id DESC) AS INTEGER) AS run_rank
       FROM h),
sh AS (SELECT COALESCE(s.job_id, h2.job_id) AS job_id, COALESCE(s.step_id, h2.step_id) AS step_id, s.step_name,
         h2.* EXCLUDE (job_id, step_id)
       FROM steps s FULL OUTER JOIN (SELECT * FROM h2 WHERE run_rank <= 3) h2
         ON h2.job_id = s.job_id AND h2.step_id = s.step_id)
SELECT COALESCE(j.job_id, sh.job_id) AS job_id, j.job_name, j.enabled, sh.* EXCLUDE (job_id)
FROM jobs j FULL OUTER JOIN sh ON sh.job_id = j.job_id
""")
def e7_job_history(t):
    """Last 3 runs per job and step, with never-run jobs and step-less history kept."""
    jobs, steps, hist = job_tables(t)
    return E.job_history(jobs, steps, hist, 3)


@query("e9_job_activity", f"""
WITH s AS (SELECT event_type AS job_id, 'srv' || CAST(user_id % 3 AS VARCHAR) AS server_name,
                  CAST(strftime(MAX(ts), '%Y%m%d') AS INTEGER) AS last_run_date,
                  CAST(strftime(MAX(ts), '%H%M%S') AS INTEGER) AS last_run_time,
                  CAST(arg_max(event_id, ts) % 5 AS INTEGER) AS last_run_outcome
           FROM events GROUP BY 1, 2),
l AS (SELECT job_id, arg_max(last_run_outcome, (CAST(last_run_date AS BIGINT) * 1000000 + last_run_time, server_name)) AS o,
             arg_max(server_name, (CAST(last_run_date AS BIGINT) * 1000000 + last_run_time, server_name)) AS srv,
             arg_max(last_run_date, (CAST(last_run_date AS BIGINT) * 1000000 + last_run_time, server_name)) AS d,
             arg_max(last_run_time, (CAST(last_run_date AS BIGINT) * 1000000 + last_run_time, server_name)) AS t,
             COUNT(*) AS n_servers, bool_or(server_name <> 'srv0') AS remote
      FROM s GROUP BY job_id),
j AS (SELECT event_type AS job_id, upper(event_type) AS job_name, CAST([0, 1, 2, 4, 4][MIN(user_id) % 5 + 1] AS INTEGER) AS st,
             CAST(MIN(user_id) % 3 AS INTEGER) AS category_id FROM events GROUP BY ALL),
c(i, n) AS (VALUES (0, 'Maintenance'), (1, 'Reports'))
SELECT j.job_id, j.job_name, l.n_servers, l.srv = 'srv0' AS is_local,
  CASE l.o WHEN 0 THEN 'Fail' WHEN 1 THEN 'Succeed' WHEN 3 THEN 'Cancel' ELSE 'Unknown' END AS last_outcome,
  CASE j.st WHEN 0 THEN 'Not idle or suspended' WHEN 1 THEN 'Executing (Step:0 (unknown))' WHEN 2 THEN 'Waiting For Thread'
            WHEN 4 THEN CASE WHEN l.remote THEN 'Not idle or suspended' ELSE 'Idle' END END AS execution_status,
  CASE j.st WHEN 0 THEN 'not scheduled' ELSE '0' || CAST(j.st AS VARCHAR) || '/02/2024 @ 06:15:00' END AS next_run,
  j.st AS current_execution_status, CASE j.st WHEN 0 THEN 0 ELSE 20240200 + j.st END AS next_run_date, 61500 AS next_run_time,
  j.category_id, COALESCE(c.n, '(unknown)') AS category,
  CASE WHEN COALESCE(l.d, 0) = 0 THEN 'never' ELSE
    substr(lpad(CAST(l.d AS VARCHAR), 8, '0'), 7, 2) || '/' || substr(lpad(CAST(l.d AS VARCHAR), 8, '0'), 5, 2) || '/' ||
    substr(lpad(CAST(l.d AS VARCHAR), 8, '0'), 1, 4) || ' @ ' || substr(lpad(CAST(l.t AS VARCHAR), 6, '0'), 1, 2) || ':' ||
    substr(lpad(CAST(l.t AS VARCHAR), 6, '0'), 3, 2) || ':' || substr(lpad(CAST(l.t AS VARCHAR), 6, '0'), 5, 2) END AS last_run
FROM j LEFT JOIN l ON l.job_id = j.job_id LEFT JOIN c ON c.i = j.category_id
""")
def e9_job_activity(t):
    """Per job the last outcome over its servers (greatest date*10^6+time); local = srv0."""
    e = t.events
    srv = (e.groupBy(F.col("event_type").alias("job_id"),
                     F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string")).alias("server_name"))
           .agg(F.max("ts").alias("__ts"), F.max_by("event_id", "ts").alias("__id")))
    srv = srv.select("job_id", "server_name", F.date_format("__ts", "yyyyMMdd").cast("int").alias("last_run_date"),
                     F.date_format("__ts", "HHmmss").cast("int").alias("last_run_time"),
                     (F.col("__id") % 5).cast("int").alias("last_run_outcome"))
    status = F.element_at(F.array(*[F.lit(v) for v in (0, 1, 2, 4, 4)]), (F.min("user_id") % 5 + 1).cast("int"))
    jobs = e.groupBy(F.col("event_type").alias("job_id"), F.upper("event_type").alias("job_name")).agg(
        status.alias("current_execution_status"), (F.min("user_id") % 3).cast("int").alias("category_id"))
    # jobs wait for the day of February that their state names, idle and running ones included
    jobs = jobs.withColumn("next_run_date", F.when(F.col("current_execution_status") == 0, 0)
                           .otherwise(20240200 + F.col("current_execution_status"))).withColumn("next_run_time", F.lit(61500))
    cats = t.region.select(F.col("r_regionkey").cast("int").alias("category_id"),
                           F.when(F.col("r_regionkey") == 0, "Maintenance").when(F.col("r_regionkey") == 1, "Reports")
                           .alias("name")).filter(F.col("name").isNotNull())
    return E.job_activity(jobs, srv, local_server="srv0", categories=cats)


SCHED_SQL = """
SELECT p_partkey // 2 AS job_id, p_partkey AS schedule_id,
  CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 32 ELSE 64 END AS freq_type,
  CASE p_size % 6 WHEN 1 THEN p_size % 3 + 1 WHEN 2 THEN p_size WHEN 3 THEN p_size % 28 + 1 WHEN 4 THEN p_size % 10 + 1
       ELSE 0 END AS freq_interval,
  CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS freq_relative_interval,
  CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 0 END AS freq_subday_type,
  p_size % 12 + 1 AS freq_subday_interval, (p_size % 24) * 10000 AS active_start_time, 235959 AS active_end_time,
  20240101 + p_size % 28 AS active_start_date, p_partkey % 5 <> 0 AS enabled
FROM part
"""


def job_schedules(t):
    """Parts as job schedules, two per job; frequency fields derived from p_size."""
    sz = F.col("p_size")
    ft = (F.when(sz % 6 == 0, 1).when(sz % 6 == 1, 4).when(sz % 6 == 2, 8).when(sz % 6 == 3, 16)
          .when(sz % 6 == 4, 32).otherwise(64))
    fi = (F.when(sz % 6 == 1, sz % 3 + 1).when(sz % 6 == 2, sz).when(sz % 6 == 3, sz % 28 + 1)
          .when(sz % 6 == 4, sz % 10 + 1).otherwise(0))
    rel = F.when(sz % 5 == 0, 1).when(sz % 5 == 1, 2).when(sz % 5 == 2, 4).when(sz % 5 == 3, 8).otherwise(16)
    sub = F.when(sz % 5 == 0, 1).when(sz % 5 == 1, 2).when(sz % 5 == 2, 4).when(sz % 5 == 3, 8).otherwise(0)
    return t.part.select((F.col("p_partkey") / 2).cast("bigint").alias("job_id"), F.col("p_partkey").alias("schedule_id"),
                         ft.alias("freq_type"), fi.alias("freq_interval"), rel.alias("freq_relative_interval"),
                         sub.alias("freq_subday_type"), (sz % 12 + 1).alias("freq_subday_interval"),
                         ((sz % 24) * 10000).alias("active_start_time"), F.lit(235959).alias("active_end_time"),
                         (sz % 28 + 20240101).alias("active_start_date"), (F.col("p_partkey") % 5 != 0).alias("enabled"))


def _hms(c):
    return (f"substr(lpad(CAST({c} AS VARCHAR), 6, '0'), 1, 2) || ':' || substr(lpad(CAST({c} AS VARCHAR), 6, '0'), 3, 2)"
            f" || ':' || substr(lpad(CAST({c} AS VARCHAR), 6, '0'), 5, 2)")


@query("e10_job_description", f"""
WITH s AS ({SCHED_SQL}),
d AS (SELECT s.*, COALESCE((SELECT string_agg(name, ', ' ORDER BY bit) FROM (VALUES (1, 'Sunday'), (2, 'Monday'),
        (4, 'Tuesday'), (8, 'Wednesday'), (16, 'Thursday'), (32, 'Friday'), (64, 'Saturday')) w(bit, name)
        WHERE (s.freq_interval & bit) = bit), 'None') AS days FROM s),
x AS (SELECT job_id,
  CASE freq_type
    WHEN 1 THEN 'Once on ' || substr(CAST(active_start_date AS VARCHAR), 7, 2) || '/' ||
         substr(CAST(active_start_date AS VARCHAR), 5, 2) || '/' || substr(CAST(active_start_date AS VARCHAR), 1, 4)
         || ' @ ' || {_hms('active_start_time')}
    WHEN 4 THEN CASE WHEN freq_interval > 1 THEN 'Every ' || CAST(freq_interval AS VARCHAR) || ' Days' ELSE 'Every Day' END
    WHEN 8 THEN days
    WHEN 16 THEN 'Every ' || CAST(freq_interval AS VARCHAR) || ' of the month'
    WHEN 32 THEN CASE freq_relative_interval WHEN 1 THEN 'First' WHEN 2 THEN 'Second' WHEN 4 THEN 'Third'
         WHEN 8 THEN 'Fourth' WHEN 16 THEN 'Last' END || ' ' ||
         CASE freq_interval WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday' WHEN 4 THEN 'Wednesday'
         WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' WHEN 7 THEN 'Saturday' WHEN 8 THEN 'Day' WHEN 9 THEN 'Weekday'
         WHEN 10 THEN 'Weekend day' END || ' of the month'
    WHEN 64 THEN 'Starts when SQL Server Agent service starts' WHEN 128 THEN 'Runs when computer is idle' ELSE 'None' END
  || CASE WHEN freq_subday_type = 1 THEN ' @ ' || {_hms('active_start_time')}
          WHEN freq_subday_type IN (2, 4, 8) THEN '. Every ' || CAST(freq_subday_interval AS VARCHAR) || ' ' ||
            CASE freq_subday_type WHEN 2 THEN 'second' WHEN 4 THEN 'minute' ELSE 'hour' END
            || CASE WHEN freq_subday_interval > 1 THEN 's' ELSE '' END ELSE '' END
  || CASE WHEN freq_subday_type IN (4, 8) THEN ', From ' || {_hms('active_start_time')} || ' till ' || {_hms('active_end_time')}
          ELSE '' END
  || CASE WHEN enabled THEN '' ELSE ' (Disabled)' END AS schedule_text FROM d),
j AS (SELECT DISTINCT p_partkey // 2 AS job_id FROM part)
SELECT j.job_id, (SELECT string_agg(schedule_text, ' [AND] ' ORDER BY schedule_text) FROM x WHERE x.job_id = j.job_id) AS schedules
FROM j
""")
def e10_job_description(t):
    """Every job (two parts per job) with its schedules as text."""
    s = job_schedules(t)
    jobs = s.select("job_id").distinct()
    return E.job_description(jobs, s)


@query("e10_job_steps", """
WITH j AS (SELECT DISTINCT event_type AS job_id FROM events),
n AS (SELECT job_id, CAST(length(job_id) % 4 AS INTEGER) AS lv, 'op_' || job_id AS op FROM j)
SELECT n.job_id, lv AS notify_level_email, op AS email_operator, lv AS delete_level,
  CASE WHEN lv BETWEEN 1 AND 3 THEN 'Email: [' || op || '] ' || w.t || ';' ELSE '' END AS notify_actions,
  CASE WHEN lv BETWEEN 1 AND 3 THEN 'Automatically delete job: ' || w.t ELSE '' END AS autodelete,
  CAST(NULL AS VARCHAR) AS schedules, s.step_id, s.step_id AS on_success_action, s.step_id + 1 AS on_success_step_id,
  5 - s.step_id AS on_fail_action, s.step_id + 2 AS on_fail_step_id,
  CASE s.step_id WHEN 1 THEN 'Quit the job reporting success' WHEN 2 THEN 'Quit the job reporting failure'
       WHEN 3 THEN 'Go to the next step' END AS on_success,
  CASE 5 - s.step_id WHEN 4 THEN 'Go to the step [' || CAST(s.step_id + 2 AS VARCHAR) || ']'
       WHEN 3 THEN 'Go to the next step' WHEN 2 THEN 'Quit the job reporting failure' END AS on_failure
FROM n LEFT JOIN (VALUES (1, 'When the job succeeds'), (2, 'When the job fails'), (3, 'When the job completes')) w(k, t)
  ON w.k = lv
LEFT JOIN (SELECT DISTINCT event_type AS job_id, CAST(user_id % 4 AS INTEGER) AS step_id FROM events WHERE user_id % 4 > 0) s
  ON s.job_id = n.job_id
""")
def e10_job_steps(t):
    """Event types as jobs with notification, auto-delete and one row per step with its action texts."""
    _, steps, _ = job_tables(t)
    steps = steps.select("job_id", "step_id", F.col("step_id").alias("on_success_action"),
                         (F.col("step_id") + 1).alias("on_success_step_id"), (5 - F.col("step_id")).alias("on_fail_action"),
                         (F.col("step_id") + 2).alias("on_fail_step_id"))
    jobs = t.events.select(F.col("event_type").alias("job_id")).distinct().select(
        "job_id", (F.length("job_id") % 4).alias("notify_level_email"),
        F.concat(F.lit("op_"), F.col("job_id")).alias("email_operator"), (F.length("job_id") % 4).alias("delete_level"))
    none = job_schedules(t).withColumn("job_id", F.concat(F.lit("part "), F.col("job_id").cast("string")))
    return E.job_description(jobs, none, steps=steps)
