"""Registered queries for reference data, names and hierarchy (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.functions.calendar import calendar_dim
from fleetsight.operators import reference as B
from fleetsight.plans.registry import query


@query("b1_latest_order_per_customer", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) x WHERE rn = 1
""")
def b1_latest_order_per_customer(t):
    """B1: newest order per customer (ties by order key)."""
    return B.latest_per_group(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


VERSIONS_SQL = """
SELECT p_type AS product, CAST(p_size AS VARCHAR) || '.0.' || CAST(p_partkey AS VARCHAR) AS resource_version,
  CASE WHEN p_size % 5 = 0 THEN p_type || ' Service pack ' || CAST(p_size AS VARCHAR)
         || CASE WHEN p_partkey % 7 = 0 THEN ' CTP' ELSE '' END
       ELSE p_name END AS description,
  CAST(DATE '2000-01-01' + CAST(p_size * 30 AS INTEGER) AS DATE) AS release_date
FROM part
"""


def versions(t):
    p = t.part
    desc = F.when(F.col("p_size") % 5 == 0,
                  F.concat(F.col("p_type"), F.lit(" Service pack "), F.col("p_size").cast("string"),
                           F.when(F.col("p_partkey") % 7 == 0, F.lit(" CTP")).otherwise(F.lit(""))))
    return p.select(F.col("p_type").alias("product"),
                    F.concat(F.col("p_size").cast("string"), F.lit(".0."), F.col("p_partkey").cast("string"))
                    .alias("resource_version"),
                    desc.otherwise(F.col("p_name")).alias("description"),
                    F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size") * 30).alias("release_date"))


_VORDER = ("release_date DESC, TRY_CAST(split_part(resource_version, '.', 1) AS BIGINT) DESC NULLS LAST, "
           "TRY_CAST(split_part(resource_version, '.', 2) AS BIGINT) DESC NULLS LAST, "
           "TRY_CAST(split_part(resource_version, '.', 3) AS BIGINT) DESC NULLS LAST, "
           "TRY_CAST(NULLIF(split_part(resource_version, '.', 4), '') AS BIGINT) DESC NULLS LAST, resource_version DESC")


def _latest(t):
    return B.latest_per_group(versions(t), ["product"], [F.col("release_date").desc(),
                                                          *B.version_order("resource_version")])


def _latest_sp(t):
    return B.latest_matching(versions(t), ["product"],
                             [F.col("release_date").desc(), *B.version_order("resource_version")],
                             F.concat(F.col("product"), F.lit(" Service pack%")))


@query("b1_latest_version_per_product", f"""
SELECT product, resource_version, description, release_date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY {_VORDER}) AS rn FROM ({VERSIONS_SQL}) v) x
WHERE rn = 1
""")
def b1_latest_version_per_product(t):
    """B1: newest version per product: release date, then numeric version parts."""
    return _latest(t)


_SP_SQL = f"""
SELECT product, resource_version, description, release_date FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY {_VORDER}) AS rn FROM ({VERSIONS_SQL}) v
  WHERE description LIKE product || ' Service pack%' AND description NOT LIKE '%CTP%'
    AND description NOT LIKE '%beta%' AND description NOT LIKE '%unidentified%'
    AND description NOT LIKE '%patch%' AND description NOT LIKE '%issue%') x
WHERE rn = 1
"""


@query("b2_latest_service_pack", _SP_SQL)
def b2_latest_service_pack(t):
    """B2: newest service-pack row per product (pattern from the product column,
    five exclusion patterns)."""
    return _latest_sp(t)


@query("b3_version_status", f"""
WITH v AS ({VERSIONS_SQL}),
c AS (SELECT product, resource_version FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY {_VORDER}) AS rn FROM v) x WHERE rn = 1),
sp AS ({_SP_SQL}),
s AS (SELECT s.s_name AS server_name,
             CAST(p.p_size AS VARCHAR) || '.0.' || CAST(p.p_partkey AS VARCHAR) AS resource_version
      FROM supplier s LEFT JOIN part p ON p.p_partkey = s.s_suppkey * 13)
SELECT s.server_name, s.resource_version, v.product, v.resource_version AS current_resource_version,
  v.description AS current_product_description, c.resource_version AS latest_resource_version,
  vv.description AS latest_resource_description, sp.resource_version AS latest_sp_resource_version,
  sp.description AS latest_sp_resource_description
FROM s LEFT JOIN v ON v.resource_version = s.resource_version
LEFT JOIN c ON c.product = v.product
LEFT JOIN v vv ON vv.resource_version = c.resource_version
LEFT JOIN sp ON sp.product = v.product
""")
def b3_version_status(t):
    """Per supplier 'server' the installed version vs latest service pack
    and latest build of its product."""
    p = t.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".0."),
                                            F.col("p_partkey").cast("string")).alias("resource_version"))
    s = t.supplier.select(F.col("s_name").alias("server_name"), "s_suppkey")
    servers = s.join(p, p["p_partkey"] == s["s_suppkey"] * 13, "left").select("server_name", "resource_version")
    return B.version_status(servers, versions(t), _latest(t), _latest_sp(t))


@query("b5_calendar_dim", """
WITH b AS (SELECT CAST(MIN(o_orderdate) AS DATE) AS s, CAST(MAX(o_orderdate) AS DATE) AS e FROM orders),
d AS (SELECT CAST(g AS DATE) AS full_date FROM b, generate_series(CAST(b.s AS TIMESTAMP), CAST(b.e AS TIMESTAMP), INTERVAL 1 DAY) t(g))
SELECT full_date, strftime(full_date, '%Y-%m-%d') AS date_string,
  CAST(dayofweek(full_date) + 1 AS INTEGER) AS day_of_week, strftime(full_date, '%A') AS day_of_week_name,
  CAST(dayofmonth(full_date) AS INTEGER) AS day_of_month, CAST(dayofyear(full_date) AS INTEGER) AS day_of_year,
  CAST((dayofyear(full_date) + dayofweek(make_date(year(full_date), 1, 1)) + 1 - 2) // 7 + 1 AS INTEGER) AS week_of_year,
  strftime(full_date, '%B') AS month_name, CAST(month(full_date) AS INTEGER) AS month_of_year,
  CAST(quarter(full_date) AS INTEGER) AS calendar_quarter, CAST(year(full_date) AS INTEGER) AS calendar_year,
  dayofweek(full_date) IN (0, 6) AS is_weekend,
  (year(full_date) % 4 = 0 AND year(full_date) % 100 <> 0) OR year(full_date) % 400 = 0 AS is_leap_year
FROM d
""")
def b5_calendar_dim(t):
    """Calendar dimension spanning the order dates."""
    bounds = t.orders.agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return calendar_dim(bounds, "s", "e")


@query("b6_bitmask_names", """
SELECT p_partkey, p_size, COALESCE((
  SELECT string_agg(name, ', ' ORDER BY bit) FROM (VALUES (1, 'Sunday'), (2, 'Monday'), (4, 'Tuesday'),
    (8, 'Wednesday'), (16, 'Thursday'), (32, 'Friday'), (64, 'Saturday')) w(bit, name)
  WHERE (p_size & bit) = bit), 'None') AS day_list
FROM part
""")
def b6_bitmask_names(t):
    """Part size read as a weekday bitmask -> day names."""
    return B.bitmask_names(t.part.select("p_partkey", "p_size"), "p_size")


_INST_SQL = r"""
SELECT page_id, CASE WHEN seg = '' THEN host ELSE host || '\' || seg END AS instance FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS seg FROM pages) x
"""


def instances(t):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    seg = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1)
    return t.pages.select("page_id", F.when(seg == "", host).otherwise(F.concat(host, F.lit("\\"), seg))
                          .alias("instance"))


@query("b7_split_instance", f"""
SELECT page_id, instance,
  CASE WHEN strpos(instance, '\\') > 0 THEN split_part(instance, '\\', 1) ELSE instance END AS machine_name,
  CASE WHEN strpos(instance, '\\') > 0 THEN split_part(instance, '\\', 2) ELSE 'default' END AS instance_name
FROM ({_INST_SQL}) i
""".replace("\\\\", "\\"))
def b7_split_instance(t):
    """B7: "HOST\\INST" -> machine and instance ('default' without one)."""
    return B.split_instance(instances(t), "instance")


@query("b7_distinct_machines", f"""
SELECT DISTINCT split_part(instance, '\\', 1) AS machine_name FROM ({_INST_SQL}) i
""".replace("\\\\", "\\"))
def b7_distinct_machines(t):
    """Distinct machines."""
    return B.distinct_machines(instances(t), "instance")


@query("b7_one_per_machine", f"""
SELECT split_part(instance, '\\', 1) AS machine_name, MIN(instance) AS instance FROM ({_INST_SQL}) i GROUP BY 1
""".replace("\\\\", "\\"))
def b7_one_per_machine(t):
    """Smallest instance name per machine."""
    return B.one_per_machine(instances(t), "instance")


EDGES_SQL = """
SELECT 'CUSTOMER' AS class_desc, c.c_name AS permission_name, p.c_name AS covering_permission_name,
       'NATION' AS parent_class_desc, n.n_name AS parent_covering_permission_name
FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 10 AND p.c_custkey <> c.c_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
UNION ALL
SELECT 'NATION' AS class_desc, n.n_name AS permission_name, c.n_name AS covering_permission_name,
       'REGION' AS parent_class_desc, r.r_name AS parent_covering_permission_name
FROM nation n LEFT JOIN nation c ON c.n_nationkey = n.n_nationkey // 2 AND c.n_nationkey <> n.n_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
UNION ALL
SELECT 'REGION', r.r_name, c.r_name, 'SERVER', 'CONTROL SERVER'
FROM region r LEFT JOIN region c ON c.r_regionkey = r.r_regionkey // 2 AND c.r_regionkey <> r.r_regionkey
UNION ALL SELECT 'SERVER', 'CONTROL SERVER', NULL, NULL, NULL
"""


def edges(t):
    """Permission graph from the tables: a customer is covered by customer
    key // 10 and, one level up, by its nation; a nation by nation key // 2
    and by its region; a region by region key // 2 and by the server."""
    n, r = t.nation, t.region
    cu = t.customer
    cp = cu.select(F.col("c_custkey").alias("ck"), F.col("c_name").alias("covering_permission_name"))
    ce = (cu.join(cp, ((cu["c_custkey"] / 10).cast("bigint") == cp["ck"]) & (cp["ck"] != cu["c_custkey"]), "left")
          .join(n.select("n_nationkey", F.col("n_name").alias("parent_covering_permission_name")),
                F.col("n_nationkey") == cu["c_nationkey"])
          .select(F.lit("CUSTOMER").alias("class_desc"), F.col("c_name").alias("permission_name"),
                  "covering_permission_name", F.lit("NATION").alias("parent_class_desc"),
                  "parent_covering_permission_name"))
    c = n.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("covering_permission_name"))
    ne = (n.join(c, ((n["n_nationkey"] / 2).cast("int") == c["ck"]) & (c["ck"] != n["n_nationkey"]), "left")
          .join(r, r["r_regionkey"] == n["n_regionkey"])
          .select(F.lit("NATION").alias("class_desc"), F.col("n_name").alias("permission_name"),
                  "covering_permission_name", F.lit("REGION").alias("parent_class_desc"),
                  F.col("r_name").alias("parent_covering_permission_name")))
    rc = r.select(F.col("r_regionkey").alias("ck"), F.col("r_name").alias("covering_permission_name"))
    re_ = (r.join(rc, ((r["r_regionkey"] / 2).cast("int") == rc["ck"]) & (rc["ck"] != r["r_regionkey"]), "left")
           .select(F.lit("REGION").alias("class_desc"), F.col("r_name").alias("permission_name"),
                   "covering_permission_name", F.lit("SERVER").alias("parent_class_desc"),
                   F.lit("CONTROL SERVER").alias("parent_covering_permission_name")))
    # the server-level permission: one row (a global aggregate of the region table)
    top = t.region.agg(F.count(F.lit(1)).alias("__n")).select(
        F.lit("SERVER").alias("class_desc"), F.lit("CONTROL SERVER").alias("permission_name"),
                                   F.lit(None).cast("string").alias("covering_permission_name"),
                                   F.lit(None).cast("string").alias("parent_class_desc"),
                                   F.lit(None).cast("string").alias("parent_covering_permission_name"))
    return ce.unionByName(ne).unionByName(re_).unionByName(top)


@query("b8_implied_permissions", f"""
WITH RECURSIVE e AS ({EDGES_SQL}),
steps AS (
  SELECT DISTINCT class_desc, permission_name, covering_permission_name AS np, class_desc AS nc, 0 AS ls
  FROM e WHERE length(covering_permission_name) > 0
  UNION
  SELECT DISTINCT class_desc, permission_name, parent_covering_permission_name, parent_class_desc, 1
  FROM e WHERE length(parent_covering_permission_name) > 0),
r(start_class, start_permission, class_desc, permission_name, level, depth) AS (
  SELECT class_desc, permission_name, class_desc, permission_name, 0, 0 FROM e WHERE class_desc = 'CUSTOMER'
  UNION ALL
  SELECT r.start_class, r.start_permission, s.nc, s.np, r.level + s.ls, r.depth + 1
  FROM r JOIN steps s ON s.class_desc = r.class_desc AND s.permission_name = r.permission_name)
SELECT start_class, start_permission, class_desc, permission_name, CAST(level AS INTEGER) AS level,
       CAST(MAX(depth) AS INTEGER) AS max_depth
FROM r GROUP BY start_class, start_permission, class_desc, permission_name, level
""")
def b8_implied_permissions(t):
    """Permissions implied by every customer 'permission' through customer
    -> customer (key // 10) -> ... and customer -> nation -> region -> server
    edges (one closure per customer, so the work grows with the table)."""
    e = edges(t)
    starts = e.filter(F.col("class_desc") == "CUSTOMER").select("class_desc", "permission_name")
    return B.implied_permissions(e, starts)


@query("b9_resolve_default", r"""
SELECT c.c_custkey, c.c_name, c.c_nationkey,
  COALESCE(CASE WHEN c.c_custkey % 5 = 0 THEN 'D:\cust\' || CAST(c.c_custkey AS VARCHAR) || '\' END,
           p.pv || c.c_name || '\', 'F:\Backup\' || c.c_name || '\') AS resolved
FROM customer c LEFT JOIN (
  SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN 'E:\' || n_name || '\' END AS pv FROM nation) p
  ON p.n_nationkey = c.c_nationkey
""")
def b9_resolve_default(t):
    """Backup path per customer: its own, else the nation's + name, else the default + name."""
    c = t.customer.select("c_custkey", "c_name", "c_nationkey",
                          F.when(F.col("c_custkey") % 5 == 0,
                                 F.concat(F.lit("D:\\cust\\"), F.col("c_custkey").cast("string"), F.lit("\\")))
                          .alias("own_path"))
    parent = t.nation.select(F.col("n_nationkey").alias("c_nationkey"),
                             F.when(F.col("n_regionkey") != 0, F.concat(F.lit("E:\\"), F.col("n_name"), F.lit("\\")))
                             .alias("path"))
    return B.resolve_default(c, "own_path", "c_name", parent, "c_nationkey", "path", "F:\\Backup\\").drop("own_path")


@query("b10_maintenance_candidates", """
WITH d AS (SELECT c_custkey AS database_id, c_name AS name, c_acctbal >= 0 AS is_online,
                  c_mktsegment = 'AUTOMOBILE' AS is_read_only,
                  CASE WHEN c_nationkey = 24 THEN 1 END AS source_database_id, c_nationkey <> 23 AS is_multi_user
           FROM customer),
r AS (SELECT c_custkey AS database_id, 2 AS role, 1 AS secondary_role_allow_connections
      FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1)
SELECT d.*, COALESCE(r.role, 1) AS role, COALESCE(r.secondary_role_allow_connections, 0) AS secondary_role_allow_connections
FROM d LEFT JOIN r ON r.database_id = d.database_id
WHERE is_online AND NOT is_read_only AND source_database_id IS NULL AND is_multi_user
  AND name NOT IN ('Customer#000000007', 'Customer#000000008') AND name NOT LIKE '%99'
""")
def b10_maintenance_candidates(t):
    """Customers as databases eligible for maintenance, with replica roles."""
    d = t.customer.select(F.col("c_custkey").alias("database_id"), F.col("c_name").alias("name"),
                          (F.col("c_acctbal") >= 0).alias("is_online"),
                          (F.col("c_mktsegment") == "AUTOMOBILE").alias("is_read_only"),
                          F.when(F.col("c_nationkey") == 24, F.lit(1)).alias("source_database_id"),
                          (F.col("c_nationkey") != 23).alias("is_multi_user"))
    r = (t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
         .filter(F.col("n_regionkey") == 1)
         .select(F.col("c_custkey").alias("database_id"), F.lit(2).alias("role"),
                 F.lit(1).alias("secondary_role_allow_connections")))
    return B.maintenance_candidates(d, exclude=["Customer#000000007", "Customer#000000008"],
                                    exclude_like="%99", replicas=r)


@query("b11_inventory_report", """
WITH o AS (SELECT * FROM orders WHERE o_orderdate > (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 1 DAY)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority, c.c_name, n.n_name, r.r_name,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS is_urgent
FROM o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def b11_inventory_report(t):
    """Current orders (newer than the latest collection minus one day)
    with customer, nation and region, and a Yes/No flag."""
    o = B.current_rows(t.orders.drop("o_totalprice"), "o_orderdate")
    o = o.withColumn("__urgent", F.col("o_orderpriority") == "1-URGENT")
    out = B.inventory_report(o, [(t.customer.select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"),
                                 (t.nation.select("n_nationkey", "n_name", "n_regionkey"), "c_nationkey", "n_nationkey"),
                                 (t.region, "n_regionkey", "r_regionkey")],
                             flags={"__urgent": "is_urgent"})
    return out.drop("__urgent", "c_nationkey", "n_regionkey")


_INSTANCES_SQL = """
SELECT 'SRV' || CAST(o_custkey AS VARCHAR) AS server_name, 'I' || CAST(o_orderkey AS VARCHAR) AS instance_name,
  o_orderdate AS last_collection_time, CAST(floor(o_totalprice) AS BIGINT) AS max_memory_mb,
  o_orderkey % 5000 AS min_memory_mb, o_orderkey % 8 AS max_dop,
  CASE WHEN o_orderdate > (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 1 DAY THEN 'Yes' ELSE 'No' END AS is_current,
  c_mktsegment AS edition, 'SP' || CAST(c_nationkey % 4 AS VARCHAR) || ' (13.0.' || CAST(c_nationkey AS VARCHAR) || ')' AS product_version,
  n_name AS collation, CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS is_production,
  CAST(floor(o_totalprice) AS BIGINT) // 1024 AS max_memory_gb, (o_orderkey % 5000) // 1024 AS min_memory_gb
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
"""


def _instances(t, **options):
    """Orders as the instances of their customer's server."""
    server = F.concat(F.lit("SRV"), F.col("c_custkey").cast("string")).alias("server_name")
    conf = t.orders.select(
        F.concat(F.lit("SRV"), F.col("o_custkey").cast("string")).alias("server_name"),
        F.concat(F.lit("I"), F.col("o_orderkey").cast("string")).alias("instance_name"),
        F.col("o_orderdate").alias("collection_time"), F.floor("o_totalprice").cast("bigint").alias("max_memory_mb"),
        (F.col("o_orderkey") % 5000).alias("min_memory_mb"), (F.col("o_orderkey") % 8).alias("max_dop"))
    props = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        server, F.col("c_mktsegment").alias("edition"),
        F.concat(F.lit("SP"), (F.col("c_nationkey") % 4).cast("string")).alias("product_level"),
        F.concat(F.lit("13.0."), F.col("c_nationkey").cast("string")).alias("product_version"),
        F.col("n_name").alias("collation"))
    servers = t.customer.select(server, (F.col("c_acctbal") > 0).alias("is_production"))
    return B.instance_inventory(conf, props, servers, **options)


@query("b11_instances", f"SELECT * FROM ({_INSTANCES_SQL}) x WHERE is_current = 'Yes'")
def b11_instances(t):
    """Current instances."""
    return _instances(t)


@query("b11_instances_all", f"SELECT * FROM ({_INSTANCES_SQL}) x WHERE server_name ILIKE 'srv1%'")
def b11_instances_all(t):
    """Instances, current or not, of the servers named like a pattern."""
    return _instances(t, only_current=False, name_like="srv1%")


@query("b11_servers", """
SELECT c_name AS server_name, c_mktsegment AS os, CASE WHEN c_custkey % 2 = 0 THEN '64-bit' ELSE '32-bit' END AS os_architecture,
  CAST(c_nationkey AS VARCHAR) AS os_patch_level, '10.' || CAST(c_nationkey AS VARCHAR) AS os_version,
  c_custkey * 1000 AS usable_memory, c_custkey * 1024 AS installed_memory,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey), '%d/%m/%Y %H:%M:%S') AS last_boot_time,
  strftime(MAX(o_orderdate), '%d/%m/%Y %H:%M:%S') AS last_collection_time
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
""")
def b11_servers(t):
    """Customers as servers, last read at their last order."""
    read = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("collection_time"))
    info = t.customer.join(read, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_name").alias("server_name"), F.col("c_mktsegment").alias("os"),
        F.when(F.col("c_custkey") % 2 == 0, "64-bit").otherwise("32-bit").alias("os_architecture"),
        F.col("c_nationkey").cast("string").alias("os_patch_level"),
        F.concat(F.lit("10."), F.col("c_nationkey").cast("string")).alias("os_version"),
        (F.col("c_custkey") * 1000).alias("total_visible_memory"),
        (F.col("c_custkey") * 1024).alias("total_physical_memory"),
        F.timestamp_add("MINUTE", F.col("c_custkey"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("last_boot_time"), "collection_time")
    return B.server_inventory(info)


@query("b11_disks", """
SELECT 'O' || CAST(l_orderkey AS VARCHAR) AS server_name, l_linenumber AS drive, l_returnflag AS volume_name,
  l_linestatus AS file_system, CAST(l_quantity AS BIGINT) * 1000 AS size_mb, CAST(l_quantity AS BIGINT) * 1000 // 1024 AS size_gb,
  CAST(l_quantity AS BIGINT) * 300 AS free_mb, CAST(l_quantity AS BIGINT) * 300 // 1024 AS free_gb,
  30 AS free_percent, NULL AS message, o_orderdate AS last_collection_time
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def b11_disks(t):
    """Order lines as the drives of their order's server."""
    name = lambda c: F.concat(F.lit("O"), F.col(c).cast("string")).alias("server_name")
    q = F.col("l_quantity").cast("bigint")
    disks = t.lineitem.select(
        name("l_orderkey"), F.col("l_linenumber").alias("drive"), F.col("l_returnflag").alias("volume_name"),
        F.col("l_linestatus").alias("file_system"), (q * 1000).alias("size_mb"), (q * 300).alias("free_mb"),
        F.lit(30).alias("free_percent"), F.lit(None).cast("string").alias("message"))
    return B.disk_inventory(disks, t.orders.select(name("o_orderkey"), F.col("o_orderdate").alias("collection_time")))


@query("b5_clock_dim_events", """
WITH c AS (SELECT CAST(hour(ts) * 3600 + minute(ts) * 60 AS INTEGER) AS second_of_day FROM events)
SELECT lpad(CAST(second_of_day // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST((second_of_day // 60) % 60 AS VARCHAR), 2, '0')
    AS hours_minutes,
  CASE WHEN second_of_day // 3600 < 12 THEN 'AM' ELSE 'PM' END AS am_pm,
  second_of_day // 3600 >= 7 AND second_of_day // 3600 < 19 AS is_working_hours, COUNT(*) AS n_events
FROM c GROUP BY 1, 2, 3
""")
def b5_clock_dim_events(t):
    """The minute clock dimension (1,440 rows, a bounded broadcast) joined
    to the events by minute of day; events counted per clock minute."""
    from fleetsight.functions.calendar import clock_dim
    clock = F.broadcast(clock_dim(t.events.sparkSession, 60))
    e = t.events.select((F.hour("ts") * 3600 + F.minute("ts") * 60).cast("int").alias("second_of_day"))
    j = e.join(clock, "second_of_day")
    return j.groupBy("hours_minutes", "am_pm", "is_working_hours").agg(F.count(F.lit(1)).alias("n_events"))


_DAYS_SQL = ", ".join(f"CASE WHEN o_orderkey & {bit} <> 0 THEN '{name}' END" for bit, name, _ in B.WEEKDAY_BITS)


@query("sql_functions", f"""
WITH o AS (SELECT *, o_orderkey * 977 AS secs, o_custkey * 61 AS dur,
                  'C:\\data\\' || o_orderstatus || '\\' || CAST(o_orderkey AS VARCHAR) || '.mdf' AS path FROM orders)
SELECT o_orderkey,
  CASE WHEN secs // 86400 <> 0 THEN CAST(secs // 86400 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST(secs // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(secs // 60 % 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') AS run_time,
  CASE WHEN dur // 10000 // 24 <> 0 THEN CAST(dur // 10000 // 24 AS VARCHAR) || '.' ELSE '' END
    || lpad(CAST(dur // 10000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dur // 100 % 100 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(dur % 100 AS VARCHAR), 2, '0') AS duration,
  CAST(o_orderkey AS VARCHAR) || '.mdf' AS file, 'C:\\data\\' || o_orderstatus || '\\' AS folder, '.mdf' AS ext,
  'C:' AS drive, CAST(CAST(o_custkey % 15 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) AS DECIMAL(3,1)) AS version,
  COALESCE(NULLIF(concat_ws(', ', {_DAYS_SQL}), ''), 'None') AS day_list
FROM o
""")
def sql_functions(t):
    """2.2 and B6 called in SQL: orders' keys as seconds, durations, files, versions and weekday masks."""
    from fleetsight.functions.sql import register_functions
    spark = t.orders.sparkSession
    register_functions(spark)
    return spark.sql(r"""
        WITH f AS (SELECT *, 'C:\\data\\' || o_orderstatus || '\\' || o_orderkey || '.mdf' AS path FROM {orders})
        SELECT o_orderkey, fmt_seconds(o_orderkey * 977) AS run_time, fmt_hhmmss(o_custkey * 61) AS duration,
          file_name(path) AS file, file_dir(path) AS folder, file_ext(path) AS ext, file_drive(path) AS drive,
          numeric_version((o_custkey % 15) || '.' || (o_orderkey % 10) || '.1') AS version, d.day_list
        FROM f, LATERAL day_names_list(o_orderkey) d""", orders=t.orders)
