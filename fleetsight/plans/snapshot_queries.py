"""Registered queries for snapshots and change capture (A).

The "loading" snapshot is the customer table with deterministic edits: keys
divisible by 10 are missing, balances of keys divisible by 7 change, names
of keys divisible by 11 are lower-cased, of others divisible by 13 changed, nation 3 did not report, and keys
with remainder 1 mod 50 come back as new entities. Region 4 is unmonitored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.operators import snapshot as A
from fleetsight.plans.registry import query
from fleetsight.session import checkpoint_dir
from fleetsight.sources.bucketed import BucketedHistory

FEED_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN lower(c_name) WHEN c_custkey % 13 = 0 THEN c_name || ' renamed'
                       ELSE c_name END AS c_name, c_nationkey,
       CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal
FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey <> 3
UNION ALL
SELECT c_custkey + 10000000, 'New#' || CAST(c_custkey AS VARCHAR), c_nationkey, c_acctbal
FROM customer WHERE c_custkey % 50 = 1 AND c_nationkey <> 3
"""


def feed(t):
    """The loaded snapshot: customer with the deterministic edits described above."""
    c = t.customer
    k = F.col("c_custkey")
    edited = c.filter((k % 10 != 0) & (F.col("c_nationkey") != 3)).select(
        k, F.when(k % 11 == 0, F.lower("c_name")).when(k % 13 == 0, F.concat("c_name", F.lit(" renamed")))
        .otherwise(F.col("c_name")).alias("c_name"), "c_nationkey",
        F.when(k % 7 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    new = c.filter((k % 50 == 1) & (F.col("c_nationkey") != 3)).select(
        (k + 10000000).alias("c_custkey"), F.concat(F.lit("New#"), k.cast("string")).alias("c_name"),
        "c_nationkey", "c_acctbal")
    return edited.unionByName(new)


def monitored(t):
    return t.nation.filter(F.col("n_regionkey") != 4).select("n_nationkey")


def _merge_sql(policy: str) -> str:
    if policy == "reported":
        missing = ("WHEN cnk NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4) "
                   "OR cnk IN (SELECT c_nationkey FROM feed) THEN 'DELETE' ELSE 'KEEP'")
    elif policy == "flag":
        missing = "WHEN cnk NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4) THEN 'DELETE' ELSE 'FLAG'"
    elif policy == "unmonitored":
        missing = "WHEN cnk NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4) THEN 'DELETE' ELSE 'KEEP'"
    else:
        missing = "ELSE 'KEEP'"
    return f"""
WITH feed AS ({FEED_SQL}),
j AS (SELECT c.c_custkey AS ck, c.c_name AS cn, c.c_nationkey AS cnk, c.c_acctbal AS ca, c.c_mktsegment AS cm,
             f.c_custkey AS fk, f.c_name AS fn, f.c_nationkey AS fnk, f.c_acctbal AS fa
      FROM customer c FULL OUTER JOIN feed f ON c.c_custkey = f.c_custkey)
SELECT COALESCE(fk, ck) AS c_custkey,
  CASE WHEN fk IS NOT NULL THEN fn ELSE cn END AS c_name,
  CASE WHEN fk IS NOT NULL THEN fnk ELSE cnk END AS c_nationkey,
  CASE WHEN fk IS NOT NULL THEN fa ELSE ca END AS c_acctbal,
  CASE WHEN ck IS NOT NULL THEN cm ELSE 'UNASSIGNED' END AS c_mktsegment,
  CASE WHEN ck IS NOT NULL AND fk IS NOT NULL THEN 'UPDATE' WHEN fk IS NOT NULL THEN 'INSERT'
       {missing} END AS action
FROM j
"""


def _merge(t, policy):
    tagged = A.snapshot_merge(t.customer, feed(t), ["c_custkey"], custom_defaults={"c_mktsegment": "UNASSIGNED"},
                              monitored=monitored(t), source_col="c_nationkey", policy=policy)
    return tagged


@query("a1_snapshot_merge_reported", _merge_sql("reported"))
def a1_snapshot_merge_reported(t):
    """A1: merge with the 'delete if unmonitored or its source reported' policy."""
    return _merge(t, "reported").drop("pre")


@query("a1_snapshot_merge_flag", _merge_sql("flag"))
def a1_snapshot_merge_flag(t):
    """A1: merge with the 'delete if unmonitored, else flag' policy."""
    return _merge(t, "flag").drop("pre")


@query("a1_snapshot_merge_keep", _merge_sql("keep"))
def a1_snapshot_merge_keep(t):
    """A1: merge with the 'keep missing rows' policy."""
    return _merge(t, "keep").drop("pre")


HISTORY_SQL = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal - 1, c_mktsegment FROM customer WHERE c_custkey % 3 = 1
"""


def history(t):
    c = t.customer
    k = F.col("c_custkey")
    return c.filter(k % 3 == 0).unionByName(
        c.filter(k % 3 == 1).withColumn("c_acctbal", F.col("c_acctbal") - 1))


CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("a2_append_history", f"""
WITH feed AS ({FEED_SQL}),
pre AS (
  SELECT c.*, CASE WHEN f.c_custkey IS NOT NULL THEN 'UPDATE' ELSE 'DELETE' END AS action
  FROM customer c LEFT JOIN feed f ON c.c_custkey = f.c_custkey
  WHERE f.c_custkey IS NOT NULL
     OR c.c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4)
     OR c.c_nationkey IN (SELECT c_nationkey FROM feed)),
h AS ({HISTORY_SQL})
SELECT p.c_custkey, p.c_name, p.c_nationkey, p.c_acctbal, p.c_mktsegment, p.action FROM pre p
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.c_custkey = p.c_custkey AND h.c_name IS NOT DISTINCT FROM p.c_name
  AND h.c_nationkey IS NOT DISTINCT FROM p.c_nationkey AND h.c_acctbal IS NOT DISTINCT FROM p.c_acctbal
  AND h.c_mktsegment IS NOT DISTINCT FROM p.c_mktsegment)
""")
def a2_append_history(t):
    """A2: pre-images of UPDATE/DELETE not yet in history (by key and checksum)."""
    pre = A.pre_images(_merge(t, "reported"))
    h = history(t).withColumn("row_checksum", A.row_checksum(CUST_COLS[1:]))
    return A.append_history(h, pre, ["c_custkey"], CUST_COLS[1:]).drop("row_checksum")


@query("a4_change_report", f"""
WITH feed AS ({FEED_SQL}),
j AS (SELECT c.c_custkey, c.c_name AS bn, f.c_name AS an, c.c_nationkey AS bk, f.c_nationkey AS ak,
             c.c_acctbal AS ba, f.c_acctbal AS aa
      FROM customer c JOIN feed f ON c.c_custkey = f.c_custkey)
SELECT c_custkey, 'c_name' AS column_name, COALESCE(bn, '') AS previous_value, COALESCE(an, '') AS current_value
FROM j WHERE lower(bn) IS DISTINCT FROM lower(an)
UNION ALL
SELECT c_custkey, 'c_nationkey', COALESCE(CAST(bk AS VARCHAR), ''), COALESCE(CAST(ak AS VARCHAR), '')
FROM j WHERE bk IS DISTINCT FROM ak
UNION ALL
SELECT c_custkey, 'c_acctbal', COALESCE(CAST(ba AS VARCHAR), ''), COALESCE(CAST(aa AS VARCHAR), '')
FROM j WHERE ba IS DISTINCT FROM aa
""")
def a4_change_report(t):
    """A4: one row per customer and changed column between the snapshot and the feed."""
    return A.change_report(t.customer, feed(t), ["c_custkey"])


@query("a5_status_change_report", f"""
WITH feed AS ({FEED_SQL})
SELECT c.c_custkey, c.c_name AS old_c_name, f.c_name AS new_c_name, lower(c.c_name) IS DISTINCT FROM lower(f.c_name) AS c_name_changed,
       c.c_acctbal AS old_c_acctbal, f.c_acctbal AS new_c_acctbal, c.c_acctbal IS DISTINCT FROM f.c_acctbal AS c_acctbal_changed
FROM customer c JOIN feed f ON c.c_custkey = f.c_custkey
WHERE lower(c.c_name) IS DISTINCT FROM lower(f.c_name) OR c.c_acctbal IS DISTINCT FROM f.c_acctbal
""")
def a5_status_change_report(t):
    """A5: old/new side by side with changed flags."""
    return A.status_change_report(t.customer, feed(t), ["c_custkey"], ["c_name", "c_acctbal"])


@query("a6_append_if_changed", """
WITH lo AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders
            WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'),
h AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00')
SELECT * FROM lo WHERE dayofmonth(o_orderdate) = 1 OR NOT EXISTS (
  SELECT 1 FROM h WHERE h.o_custkey = lo.o_custkey AND h.o_orderstatus IS NOT DISTINCT FROM lo.o_orderstatus
    AND h.o_orderpriority IS NOT DISTINCT FROM lo.o_orderpriority)
""")
def a6_append_if_changed(t):
    """Orders since 1998 as measurements appended only when their (status,
    priority) is new for the customer, or on day 1 of a month."""
    o = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return A.append_if_changed(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut),
                               ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")


@query("a7_upsert_with_change_date", """
WITH feed AS (
  SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey
  FROM customer
  UNION ALL
  SELECT c_custkey + 20000000, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 40 = 3)
SELECT f.c_custkey, f.c_mktsegment, f.c_nationkey, TIMESTAMP '2024-02-01 12:00:00' AS change_date,
  CASE WHEN s.c_custkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action
FROM feed f LEFT JOIN customer s ON s.c_custkey = f.c_custkey
WHERE s.c_custkey IS NULL OR s.c_mktsegment IS DISTINCT FROM f.c_mktsegment
   OR s.c_nationkey IS DISTINCT FROM f.c_nationkey
""")
def a7_upsert_with_change_date(t):
    """Upsert a role feed; changed rows stamped with the run time."""
    c = t.customer
    k = F.col("c_custkey")
    fd = c.select(k, F.when(k % 13 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
                  "c_nationkey").unionByName(
        c.filter(k % 40 == 3).select((k + 20000000).alias("c_custkey"), "c_mktsegment", "c_nationkey"))
    state = c.select("c_custkey", "c_mktsegment", "c_nationkey")
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    return A.upsert_with_change_date(state, fd, ["c_custkey"], ["c_mktsegment", "c_nationkey"], now)


@query("a8_current_plus_history", f"""
SELECT DISTINCT * FROM (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
  UNION ALL {HISTORY_SQL}) u
WHERE c_mktsegment = 'BUILDING'
""")
def a8_current_plus_history(t):
    """Distinct union of current and history rows of one segment."""
    return A.current_plus_history(t.customer, history(t), F.col("c_mktsegment") == "BUILDING")


@query("a9_freshness", """
SELECT 'orders' AS table_name, MIN(o_orderdate) AS oldest_collection_time FROM orders
UNION ALL SELECT 'lineitem', MIN(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', MIN(ts) FROM events
""")
def a9_freshness(t):
    """Oldest collection time per table."""
    return A.freshness({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate"),
                        "events": (t.events, "ts")})


@query("a10_stale_sources", """
SELECT 'perfmon_' || CAST(user_id AS VARCHAR) AS source_name, MAX(ts) AS last_data_collection
FROM events GROUP BY user_id
HAVING MAX(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3 HOUR
   AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE')
""")
def a10_stale_sources(t):
    """A10: users (as 'perfmon_<id>' sources) with no event in the 3 hours before
    a fixed 'now', restricted to monitored machines (customers outside one segment)."""
    e = t.events.select(F.concat(F.lit("perfmon_"), F.col("user_id").cast("string")).alias("source_name"), "ts")
    mon = t.customer.filter(F.col("c_mktsegment") != "AUTOMOBILE").select(
        F.col("c_custkey").cast("string").alias("machine"))
    machine = F.substring_index(F.col("source_name"), "_", -1)
    return A.stale_sources(e, "source_name", "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 3.0,
                           monitored=mon, monitored_col="machine", source_machine=machine)


@query("a11_missing_or_failed", """
WITH last AS (
  SELECT o_custkey AS c_custkey, o_orderstatus AS last_run_status FROM (
    SELECT o_custkey, o_orderstatus,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) x WHERE rn = 1)
SELECT c.c_custkey, c.c_name, l.last_run_status,
       COALESCE(CASE WHEN l.last_run_status = 'F' THEN 'Failed' ELSE l.last_run_status END, '-') IN ('-', 'Failed') AS flagged
FROM customer c LEFT JOIN last l ON l.c_custkey = c.c_custkey
""")
def a11_missing_or_failed(t):
    """Every customer with the status of its latest order; flagged when it
    has none or it is 'F' (failed)."""
    from fleetsight.operators.reference import latest_per_group
    last = latest_per_group(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    last = last.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("last_run_status"))
    last = last.withColumn("__st", F.when(F.col("last_run_status") == "F", F.lit("Failed"))
                           .otherwise(F.col("last_run_status")))
    out = A.missing_or_failed(t.customer.select("c_custkey", "c_name"), last, "c_custkey", "__st")
    return out.drop("__st")


TARGET = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_phone", T.StringType()),
    T.StructField("c_mktsegment", T.StringType()),
])


@query("a12_load_with_drift", """
SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS c_phone, CAST(NULL AS VARCHAR) AS c_mktsegment,
  c_nationkey
FROM customer
""")
def a12_load_with_drift(t):
    """A feed with an extra column (added) and two missing ones aligned to the target schema."""
    fd = t.customer.select("c_custkey", F.col("c_name").alias("C_NAME"), "c_acctbal", "c_nationkey")
    return A.load_with_drift(fd, TARGET)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("a13_pivot_settings", """
SELECT user_id,
  MAX(CASE WHEN event_type = 'click' THEN value END) AS click,
  MAX(CASE WHEN event_type = 'error' THEN value END) AS error,
  MAX(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
  MAX(CASE WHEN event_type = 'signup' THEN value END) AS signup,
  MAX(CASE WHEN event_type = 'view' THEN value END) AS "view",
  (SELECT string_agg(DISTINCT e2.event_type, ', ' ORDER BY e2.event_type) FROM events e2
    WHERE e2.user_id = e.user_id AND e2.value > 90) AS enabled_list
FROM events e GROUP BY user_id
""")
def a13_pivot_settings(t):
    """Per user the max value per event type as columns, plus the ordered
    list of types that were 'enabled' (some value above 90)."""
    return A.pivot_settings(t.events, "user_id", "event_type", "value", EVENT_TYPES,
                            enabled=F.col("value") > 90)


@query("a14_last_event_by_type", """
SELECT user_id,
  MAX(CASE WHEN event_type = 'click' THEN ts END) AS last_click,
  MAX(CASE WHEN event_type = 'error' THEN ts END) AS last_error,
  MAX(CASE WHEN event_type = 'purchase' THEN ts END) AS last_purchase,
  MAX(CASE WHEN event_type = 'signup' THEN ts END) AS last_signup,
  MAX(CASE WHEN event_type = 'view' THEN ts END) AS last_view
FROM events GROUP BY user_id
""")
def a14_last_event_by_type(t):
    """Latest time per event type as columns, per user."""
    return A.last_event_by_type(t.events, "user_id", "event_type", "ts", EVENT_TYPES)


@query("a15_assemble_wide", """
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / 1024 AS price_k,
         string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS features
  FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, c.c_name, n.n_name, li.n_lines, li.price_k, li.features
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN li ON li.l_orderkey = o.o_orderkey
""")
def a15_assemble_wide(t):
    """One row per order from four sources; the lineitem part is
    pre-aggregated per order (count, price in thousands, flag list)."""
    from fleetsight.functions.aggregates import ordered_list
    li = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        (F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double") / 1024).alias("price_k"),
        ordered_list("l_returnflag", "l_returnflag", ",", distinct=True).alias("features"))
    cust = t.customer.select("c_custkey", "c_name", "c_nationkey").join(
        t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left") \
        .drop("c_nationkey")
    base = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    out = A.assemble_wide(base, "o_custkey", [(cust, "c_custkey")])
    return A.assemble_wide(out, "o_orderkey", [(li, "l_orderkey")])


@query("a3_row_checksum")
def a3_row_checksum(t):
    """A3: change fingerprint of every customer over the monitored columns
    (xxhash64 has no SQL twin: rows-only check; equality is tested in tests/)."""
    return A.with_row_checksum(t.customer, ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]) \
        .select("c_custkey", "row_checksum")


def _capture(t):
    """Render a 'systeminfo'-like capture text per supplier (derived from the table)."""
    s = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    mem1 = F.floor(F.abs(F.col("s_acctbal"))).cast("bigint")
    hotfixes = F.transform(F.sequence(F.lit(1), F.col("s_nationkey") % 3 + 1),
                           lambda i: F.concat(F.lit("Hotfix:                    KB"), F.col("s_suppkey").cast("string"),
                                              i.cast("string")))
    lines = F.concat(F.array(
        F.concat(F.lit("Host Name:                 "), F.col("s_name")),
        F.concat(F.lit("OS Name:                   Windows Server ("), F.col("n_name"), F.lit(")")),
        F.lit("-----"),
        F.concat(F.lit("Memory Module:             "), mem1.cast("string"), F.lit(" MB")),
        F.concat(F.lit("Memory Module:             "), F.col("s_suppkey").cast("string"), F.lit(" MB")),
        F.lit("")), hotfixes)
    return s.select("s_suppkey", F.array_join(lines, "\n").alias("capture"))


@query("a16_parse_key_value", """
SELECT s.s_suppkey, s.s_name AS host_name, n.n_name AS os_detail,
  CAST(floor(abs(s.s_acctbal)) + s.s_suppkey AS DECIMAL(30,2)) AS memory_mb,
  CAST(s.s_nationkey % 3 + 1 AS BIGINT) AS n_hotfixes
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
""")
def a16_parse_key_value(t):
    """A16: 'Key: value' capture text per supplier parsed back to one record
    (first value, sum of several lines, line count, text in parentheses)."""
    lines = A.capture_lines(_capture(t), "s_suppkey", "capture")
    return A.parse_key_value(lines, "s_suppkey", keys={"Host Name": "host_name"},
                             sum_keys={"Memory Module": "memory_mb"}, count_keys={"Hotfix": "n_hotfixes"},
                             paren_keys={"OS Name": "os_detail"})


def _disk_lines(t):
    """Fixed-width 'logical disk' listing per nation, as (source, line_no, line) rows."""
    s = t.supplier
    free = F.floor(F.abs(F.col("s_acctbal"))).cast("bigint")
    data = s.select(F.col("s_nationkey").alias("source"), (F.col("s_suppkey") + 2).alias("line_no"),
                    F.concat(F.rpad(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), 12, " "),
                             F.rpad(free.cast("string"), 14, " "), (free + 1000).cast("string")).alias("line"))
    nat = t.nation.select(F.col("n_nationkey").alias("source"))
    header = nat.select("source", F.lit(0).cast("bigint").alias("line_no"),
                        F.lit("Caption     FreeSpace     Size").alias("line"))
    junk = nat.select("source", F.lit(1).cast("bigint").alias("line_no"), F.lit("   ").alias("line"))
    return header.unionByName(junk).unionByName(data)


@query("a16_parse_fixed_width", """
SELECT s_nationkey AS source, s_suppkey + 2 AS line_no, 'S' || CAST(s_suppkey AS VARCHAR) AS "Caption",
  CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) AS "FreeSpace",
  CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS VARCHAR) AS "Size"
FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)
""")
def a16_parse_fixed_width(t):
    """Fixed-width disk listing per nation; column offsets from each header line."""
    return A.parse_fixed_width(_disk_lines(t), "source", ["Caption", "FreeSpace", "Size"], r"^Caption")


@query("a3_checksum_classes", """
SELECT CAST(n AS BIGINT) AS class_size, COUNT(*) AS n_classes FROM (
  SELECT COUNT(*) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment,
                                    c_nationkey, floor(c_acctbal / 1000) AS k FROM customer) x
  GROUP BY segment, c_nationkey, k) y GROUP BY 1
""")
def a3_checksum_classes(t):
    """A3: equal fingerprints are equal rows: how many classes of each size the checksums make."""
    rows = t.customer.select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"), "c_nationkey",
                             F.floor(F.col("c_acctbal") / 1000).alias("k"))
    sums = A.with_row_checksum(rows, ["segment", "c_nationkey", "k"])
    return sums.groupBy("row_checksum").agg(F.count("*").alias("class_size")).groupBy("class_size").agg(
        F.count("*").alias("n_classes"))


@query("a1_snapshot_merge_unmonitored", _merge_sql("unmonitored").replace(
    "ELSE 'UNASSIGNED' END", "ELSE COALESCE((SELECT n_name FROM nation WHERE n_regionkey < 2 AND n_nationkey = fnk), "
    "'UNASSIGNED') END"))
def a1_snapshot_merge_unmonitored(t):
    """A1: merge with the 'delete only if unmonitored' policy; new rows take their source's default, else the global one."""
    defaults = t.nation.filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"),
                                                         F.col("n_name").alias("c_mktsegment"))
    return A.snapshot_merge(t.customer, feed(t), ["c_custkey"], custom_defaults={"c_mktsegment": "UNASSIGNED"},
                            monitored=monitored(t), source_col="c_nationkey", policy="unmonitored",
                            source_defaults=defaults).drop("pre")


@query("a1_snapshot_merge_text_keys", f"""
WITH feed AS ({FEED_SQL})
SELECT COALESCE(f.c_name, c.c_name) AS c_name, COALESCE(f.c_custkey, c.c_custkey) AS c_custkey,
  COALESCE(f.c_nationkey, c.c_nationkey) AS c_nationkey, COALESCE(f.c_acctbal, c.c_acctbal) AS c_acctbal,
  CASE WHEN c.c_name IS NULL THEN 'UNASSIGNED' ELSE c.c_mktsegment END AS c_mktsegment,
  CASE WHEN c.c_name IS NULL THEN 'INSERT' WHEN f.c_name IS NULL THEN 'KEEP' ELSE 'UPDATE' END AS action
FROM customer c FULL OUTER JOIN feed f ON lower(c.c_name) = lower(f.c_name)
""")
def a1_snapshot_merge_text_keys(t):
    """A1: merge on the customer's name, which the feed spells in another case for some."""
    return A.snapshot_merge(t.customer, feed(t), ["c_name"], custom_defaults={"c_mktsegment": "UNASSIGNED"},
                            policy="keep").drop("pre")


def _store(t, name: str, keys: list[str]) -> BucketedHistory:
    """An empty bucketed history in the shared folder."""
    spark = t.customer.sparkSession
    return BucketedHistory(spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", keys, 16)


@query("a2_bucketed_history", f"""
WITH feed AS ({FEED_SQL}),
pre AS (
  SELECT c.*, CASE WHEN f.c_custkey IS NOT NULL THEN 'UPDATE' ELSE 'DELETE' END AS action
  FROM customer c LEFT JOIN feed f ON c.c_custkey = f.c_custkey
  WHERE f.c_custkey IS NOT NULL
     OR c.c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4)
     OR c.c_nationkey IN (SELECT c_nationkey FROM feed)),
h AS ({HISTORY_SQL}),
fresh AS (
  SELECT p.c_custkey, p.c_name, p.c_nationkey, p.c_acctbal, p.c_mktsegment, p.action FROM pre p
  WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.c_custkey = p.c_custkey AND h.c_name IS NOT DISTINCT FROM p.c_name
    AND h.c_nationkey IS NOT DISTINCT FROM p.c_nationkey AND h.c_acctbal IS NOT DISTINCT FROM p.c_acctbal
    AND h.c_mktsegment IS NOT DISTINCT FROM p.c_mktsegment))
SELECT 2 AS run, * FROM fresh WHERE c_nationkey = 7
UNION ALL SELECT 3, * FROM fresh WHERE c_nationkey <> 7
""")
def a2_bucketed_history(t):
    """A2 over a history laid out by key hash: run 1 holds the old rows, run 2 loads one source, run 3 all of
    them (of which run 2 has stored one source's already), after the history was compacted."""
    store = _store(t, "a2-history", ["c_custkey"])
    store.write(history(t).withColumn("row_checksum", A.row_checksum(CUST_COLS[1:])), 1)
    pre = A.pre_images(_merge(t, "reported"))
    second = A.append_history_bucketed(store, pre.filter(F.col("c_nationkey") == 7), 2, CUST_COLS[1:])
    store.compact(3)
    third = A.append_history_bucketed(store, pre, 3, CUST_COLS[1:])
    return second.select(F.lit(2).alias("run"), *CUST_COLS, "action").unionByName(
        third.select(F.lit(3).alias("run"), *CUST_COLS, "action"))


@query("a6_bucketed_measurements", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate,
             CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 1
                  WHEN o_orderdate < TIMESTAMP '1998-05-01 00:00:00' THEN 2 ELSE 3 END AS run FROM orders)
SELECT run, o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate FROM o
WHERE run > 1 AND (dayofmonth(o_orderdate) = 1 OR NOT EXISTS (
  SELECT 1 FROM o h WHERE h.run < o.run AND h.o_custkey = o.o_custkey
    AND h.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus
    AND h.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority))
""")
def a6_bucketed_measurements(t):
    """A6 over a history laid out by key hash, in two loads: orders as measurements of their customer, appended
    when their (status, priority) is new for the customer, or on day 1 of a month."""
    store = _store(t, "a6-measurements", ["o_custkey"])
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    o, day = t.orders.select(*cols), F.col("o_orderdate")
    first, mid = (F.lit(f"1998-{m}-01 00:00:00").cast("timestamp_ntz") for m in ("01", "05"))
    values = ["o_orderstatus", "o_orderpriority"]
    out = []
    for run, rows in ((1, o.filter(day < first)), (2, o.filter((day >= first) & (day < mid))), (3, o.filter(day >= mid))):
        new = A.append_if_changed_bucketed(store, rows, run, values, "o_orderdate")
        out.append(new.select(F.lit(run).alias("run"), *cols))
    return out[1].unionByName(out[2])


_CASE_CUR = "SELECT 'srv' || c_nationkey AS server, c_name AS name, c_acctbal AS v FROM customer"
_CASE_FEED = """
SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'SRV' ELSE 'srv' END || c_nationkey AS server,
       CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name,
       CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v
FROM customer WHERE c_custkey % 7 <> 0 AND c_nationkey <> 4
"""
_CASE_MON = "SELECT 'Srv' || n_nationkey AS s FROM nation WHERE n_regionkey <> 4"


def _case_frames(t):
    """Servers and names that change their case between the current state, the feed and the server list."""
    c, k = t.customer, F.col("c_custkey")
    number = F.col("c_nationkey").cast("string")
    cur = c.select(F.concat(F.lit("srv"), number).alias("server"), F.col("c_name").alias("name"),
                   F.col("c_acctbal").alias("v"))
    fd = c.filter((k % 7 != 0) & (F.col("c_nationkey") != 4)).select(
        F.concat(F.when(F.col("c_nationkey") % 2 == 0, "SRV").otherwise("srv"), number).alias("server"),
        F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"))
    mon = t.nation.filter(F.col("n_regionkey") != 4).select(
        F.concat(F.lit("Srv"), F.col("n_nationkey").cast("string")).alias("s"))
    return cur, fd, mon


@query("a1_snapshot_merge_source_case", f"""
WITH c AS ({_CASE_CUR}), f AS ({_CASE_FEED}), m AS ({_CASE_MON}),
j AS (SELECT c.server AS cs, c.name AS cn, c.v AS cv, f.server AS fs, f.name AS fn, f.v AS fv
      FROM c FULL OUTER JOIN f ON lower(c.server) = lower(f.server) AND lower(c.name) = lower(f.name))
SELECT coalesce(fs, cs) AS server, coalesce(fn, cn) AS name, CASE WHEN fs IS NOT NULL THEN fv ELSE cv END AS v,
       CASE WHEN cs IS NOT NULL AND fs IS NOT NULL THEN 'UPDATE' WHEN fs IS NOT NULL THEN 'INSERT'
            WHEN lower(cs) NOT IN (SELECT lower(s) FROM m) OR lower(cs) IN (SELECT lower(server) FROM f) THEN 'DELETE'
            ELSE 'KEEP' END AS action
FROM j
""")
def a1_snapshot_merge_source_case(t):
    """A1: servers and keys whose case differs between feed, current state and the list of monitored servers."""
    cur, fd, mon = _case_frames(t)
    return A.snapshot_merge(cur, fd, ["server", "name"], monitored=mon, source_col="server").drop("pre")


@query("a4_change_report_key_case", f"""
WITH c AS ({_CASE_CUR}), f AS ({_CASE_FEED})
SELECT f.server, f.name, 'v' AS column_name, COALESCE(CAST(c.v AS VARCHAR), '') AS previous_value,
       COALESCE(CAST(f.v AS VARCHAR), '') AS current_value
FROM c JOIN f ON lower(c.server) = lower(f.server) AND lower(c.name) = lower(f.name) WHERE c.v IS DISTINCT FROM f.v
""")
def a4_change_report_key_case(t):
    """A4: changes of keys that come back in another case."""
    cur, fd, _ = _case_frames(t)
    return A.change_report(cur, fd, ["server", "name"])


@query("a5_status_change_key_case", f"""
WITH c AS ({_CASE_CUR}), f AS ({_CASE_FEED})
SELECT f.server, f.name, c.v AS old_v, f.v AS new_v, c.v IS DISTINCT FROM f.v AS v_changed
FROM c JOIN f ON lower(c.server) = lower(f.server) AND lower(c.name) = lower(f.name) WHERE c.v IS DISTINCT FROM f.v
""")
def a5_status_change_key_case(t):
    """A5: old and new value of keys that come back in another case."""
    cur, fd, _ = _case_frames(t)
    return A.status_change_report(cur, fd, ["server", "name"], ["v"])
