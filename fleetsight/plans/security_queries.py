"""Registered queries for the security audit (F).

Suppliers are database users, part brands are roles (a supplier is a member
of every brand it supplied), customers are server logins matched on key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetsight.operators import security as S
from fleetsight.plans.registry import query


def _brand_id(c):
    return F.lit(1000000000) + F.substring_index(c, "#", -1).cast("bigint")


@query("f1_principal_roles", """
WITH m AS (SELECT DISTINCT 1000000000 + CAST(split_part(p.p_brand, '#', 2) AS BIGINT) AS role_id, l.l_suppkey AS member_id,
                  p.p_brand AS role_name
           FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
r AS (SELECT member_id, string_agg(DISTINCT role_name, ', ' ORDER BY role_name) AS role_list FROM m GROUP BY member_id)
SELECT s.s_suppkey AS principal_id, s.s_name AS name, 'S' AS type, s.s_suppkey AS sid, r.role_list,
  CASE WHEN s.s_acctbal > 0 THEN 'Yes' ELSE 'No' END AS has_connect, c.c_name AS login_name
FROM supplier s LEFT JOIN r ON r.member_id = s.s_suppkey
LEFT JOIN customer c ON c.c_custkey = s.s_suppkey
""")
def f1_principal_roles(t):
    """suppliers as users with their brand roles, connect right and matching login."""
    p = t.supplier.select(F.col("s_suppkey").alias("principal_id"), F.col("s_name").alias("name"),
                          F.lit("S").alias("type"), F.col("s_suppkey").alias("sid"), "s_acctbal")
    brands = t.part.select("p_partkey", "p_brand")
    roles = brands.select(_brand_id(F.col("p_brand")).alias("principal_id"), F.col("p_brand").alias("name")).distinct()
    members = (t.lineitem.select("l_partkey", "l_suppkey").join(brands, F.col("p_partkey") == F.col("l_partkey"))
               .select(_brand_id(F.col("p_brand")).alias("role_id"), F.col("l_suppkey").alias("member_id")).distinct())
    connect = p.filter(F.col("s_acctbal") > 0).select("principal_id")
    logins = t.customer.select(F.col("c_custkey").alias("sid"), F.col("c_name").alias("login_name"))
    allp = p.drop("s_acctbal").unionByName(roles, allowMissingColumns=True)
    out = S.principal_roles(allp, members, connect=connect, logins=logins, with_members=False)
    return out.filter(F.col("type") == "S")


@query("f1_role_members", """
SELECT DISTINCT 1000000000 + CAST(split_part(p.p_brand, '#', 2) AS BIGINT) AS role_id, p.p_brand AS role_name,
  s.s_suppkey AS member_id, s.s_name AS member_name
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
""")
def f1_role_members(t):
    """the members of every brand role, one row each."""
    brands = t.part.select("p_partkey", "p_brand")
    people = t.supplier.select(F.col("s_suppkey").alias("principal_id"), F.col("s_name").alias("name")).unionByName(
        brands.select(_brand_id(F.col("p_brand")).alias("principal_id"), F.col("p_brand").alias("name")).distinct())
    members = t.lineitem.join(brands, F.col("p_partkey") == F.col("l_partkey")).select(
        _brand_id(F.col("p_brand")).alias("role_id"), F.col("l_suppkey").alias("member_id"))
    return S.role_members(people, members)


GRANTS_SQL = """
SELECT l_suppkey AS grantee_id, 'part_' || CAST(l_partkey AS VARCHAR) AS object_name,
  CASE l_linestatus WHEN 'O' THEN 'GRANT' ELSE 'DENY' END AS state,
  CASE l_returnflag WHEN 'A' THEN 'SELECT' WHEN 'N' THEN 'INSERT' ELSE 'UPDATE' END AS permission,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'col' || CAST(l_linenumber % 3 AS VARCHAR) END AS column_name
FROM lineitem
"""


@query("f2_principal_permissions", f"""
WITH g AS (SELECT DISTINCT * FROM ({GRANTS_SQL}) x),
p AS (SELECT grantee_id, object_name, state, permission, string_agg(column_name, ', ' ORDER BY column_name) AS cols
      FROM g GROUP BY ALL)
SELECT grantee_id, object_name, state,
  string_agg(CASE WHEN cols IS NULL OR cols = '' THEN permission ELSE permission || ' (' || cols || ')' END, ', ' ORDER BY permission)
    AS permission_list
FROM p GROUP BY grantee_id, object_name, state
""")
def f2_principal_permissions(t):
    """lineitem rows as grants (supplier on part, status as state, flag as permission)."""
    li = t.lineitem
    g = li.select(F.col("l_suppkey").alias("grantee_id"),
                  F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("object_name"),
                  F.when(F.col("l_linestatus") == "O", "GRANT").otherwise("DENY").alias("state"),
                  F.when(F.col("l_returnflag") == "A", "SELECT").when(F.col("l_returnflag") == "N", "INSERT")
                  .otherwise("UPDATE").alias("permission"),
                  F.when(F.col("l_linenumber") % 3 == 0, F.lit(None))
                  .otherwise(F.concat(F.lit("col"), (F.col("l_linenumber") % 3).cast("string"))).alias("column_name"))
    return S.principal_permissions(g)


@query("f2_permissions_by_class", """
WITH g AS (
  SELECT DISTINCT l_suppkey AS grantee_id, [0, 1, 3, 6, 25][l_linenumber % 5 + 1] AS class,
    CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey % 25 WHEN 3 THEN l_partkey % 7
      ELSE l_partkey END AS major_id,
    CASE l_linestatus WHEN 'O' THEN 'GRANT' ELSE 'DENY' END AS state,
    CASE l_returnflag WHEN 'A' THEN 'SELECT' WHEN 'N' THEN 'INSERT' ELSE 'UPDATE' END AS permission
  FROM lineitem),
n AS (
  SELECT g.*, CASE class WHEN 0 THEN '[estate]' WHEN 1 THEN '[' || p_mfgr || '].[' || p_name || ']'
                WHEN 3 THEN '[' || n_name || ']' WHEN 6 THEN '[' || r_name || ']' END AS object_name,
    CASE class WHEN 0 THEN 'DATABASE' WHEN 1 THEN p_type WHEN 3 THEN 'SCHEMA' WHEN 6 THEN 'TYPE' END AS class_desc
  FROM g LEFT JOIN (SELECT p_partkey, p_name, p_type, p_brand AS p_mfgr FROM part) p ON class = 1 AND p_partkey = major_id
  LEFT JOIN nation ON class = 3 AND n_nationkey = major_id LEFT JOIN region ON class = 6 AND r_regionkey = major_id)
SELECT grantee_id, class, class_desc, major_id, object_name, state, string_agg(permission, ', ' ORDER BY permission) AS permission_list
FROM n GROUP BY ALL
""")
def f2_permissions_by_class(t):
    """grants on the database, parts as objects (their brand as schema), nations as schemas, regions as
    types and a class without names."""
    kind = F.col("l_linenumber") % 5
    part = F.col("l_partkey")
    g = t.lineitem.select(
        F.col("l_suppkey").alias("grantee_id"),
        F.element_at(F.array(*[F.lit(c) for c in (0, 1, 3, 6, 25)]), kind + 1).alias("class"),
        F.when(kind == 0, 0).when(kind == 2, part % 25).when(kind == 3, part % 7).otherwise(part).alias("major_id"),
        F.lit("estate").alias("database_name"),
        F.when(F.col("l_linestatus") == "O", "GRANT").otherwise("DENY").alias("state"),
        F.when(F.col("l_returnflag") == "A", "SELECT").when(F.col("l_returnflag") == "N", "INSERT")
        .otherwise("UPDATE").alias("permission"), F.lit(None).cast("string").alias("column_name"))
    named = S.name_grants(
        g, objects=t.part.select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("schema_name"),
                                 F.col("p_name").alias("name"), F.col("p_type").alias("type_desc")),
        schemas=t.nation.select(F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name")),
        types=t.region.select(F.col("r_regionkey").alias("type_id"), F.col("r_name").alias("name")))
    return S.principal_permissions(named, by=("class", "class_desc", "major_id"))


@query("f3_orphan_principals", """
SELECT c_custkey, c_name, c_mktsegment, 'SQL_USER' AS principal_type_desc FROM customer
WHERE c_name NOT IN ('dbo', 'guest', 'INFORMATION_SCHEMA', 'sys') AND c_mktsegment <> 'BUILDING'
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
""")
def f3_orphan_principals(t):
    """customers (SQL users, those of one segment Windows users) without an urgent order (login) of the same key."""
    users = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.when(
        F.col("c_mktsegment") == "BUILDING", "WINDOWS_USER").otherwise("SQL_USER").alias("principal_type_desc"))
    logins = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    return S.orphan_principals(users, logins, sid="c_custkey", login_sid="o_custkey", name="c_name")


@query("f4_login_audit", """
WITH pr AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS permissions
            FROM orders GROUP BY o_custkey),
us AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS mapped_users
       FROM orders GROUP BY o_custkey)
SELECT c.c_custkey AS login_id, c.c_name AS login_name, c.c_acctbal < 0 AS is_disabled,
  CASE WHEN c.c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS disabled, c.c_mktsegment AS server_roles,
  n.n_name AS groups, pr.permissions, us.mapped_users
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN pr ON pr.k = c.c_custkey LEFT JOIN us ON us.k = c.c_custkey
WHERE c.c_name LIKE '%12%' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                                       AND CAST(o.o_orderkey AS VARCHAR) LIKE '%12%')
""")
def f4_login_audit(t):
    """customers as logins: disabled flag, segment as server role, nation as group,
    order priorities as permissions, order statuses as mapped users; name filter
    also matching members (orders)."""
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("login_id"), F.col("c_name").alias("login_name"),
        (F.col("c_acctbal") < 0).alias("is_disabled"), F.col("c_mktsegment").alias("server_roles"),
        F.col("n_name").alias("groups"))
    o = t.orders
    members = o.select(F.col("o_custkey").alias("login_id"), F.col("o_orderkey").cast("string").alias("member_name"))
    return S.login_audit(c, {"permissions": (o, "o_custkey", "o_orderpriority"),
                             "mapped_users": (o, "o_custkey", "o_orderstatus")},
                         name_like="%12%", members=members)


@query("f4_login_entries", """
SELECT n_nationkey AS login_id, n_name AS login_name, 'member' AS kind, c_name AS value
FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL
SELECT DISTINCT n_nationkey, n_name, 'permission', o_orderpriority
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
""")
def f4_login_entries(t):
    """nations as group logins: their members (customers) and permissions (order priorities) as rows."""
    n = t.nation.select(F.col("n_nationkey").alias("login_id"), F.col("n_name").alias("login_name"))
    c = t.customer.select("c_custkey", "c_nationkey", "c_name")
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return S.login_entries(n, {"member": (c, "c_nationkey", "c_name"),
                               "permission": (o, "c_nationkey", "o_orderpriority")})
