"""Reference data, names and hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fleetsight.functions.scalar import fold_case, int_div, split_instance_machine, split_instance_name, yes_no
from fleetsight.plans.strategies import broadcast_if_small, top_n_per_group
from fleetsight.session import cut_lineage

# Weekday bits (bit value, name, day number with Monday = 1).
WEEKDAY_BITS = [(1, "Sunday", 7), (2, "Monday", 1), (4, "Tuesday", 2), (8, "Wednesday", 3),
                (16, "Thursday", 4), (32, "Friday", 5), (64, "Saturday", 6)]
# Description patterns that disqualify a service-pack row.
SERVICE_PACK_EXCLUDES = ["%CTP%", "%beta%", "%unidentified%", "%patch%", "%issue%"]


HOT_NODE = 20_000        # rows of one node that are not left to one task
HOT_STEPS = 500_000      # edges that are broadcast

# --------------------------------------------------------------------- B1
def latest_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order`` (row_number() = 1; partial group limit
    before the shuffle keeps hot keys cheap)."""
    return top_n_per_group(df, keys, order, 1, rank_col="__rn").drop("__rn")


def version_order(version: str, as_text: bool = False) -> list[Column]:
    """Order a dotted version newest first: numerically by part, or as text."""
    v = F.col(version)
    if as_text:
        return [v.desc()]
    parts = F.split(v, r"\.")
    return [F.try_element_at(parts, F.lit(i)).try_cast("bigint").desc_nulls_last() for i in range(1, 5)] + [v.desc()]


# --------------------------------------------------------------------- B2
def latest_matching(df: DataFrame, keys: list[str], order: list[Column], like,
                    not_like: list[str] = SERVICE_PACK_EXCLUDES, text_col: str = "description") -> DataFrame:
    """As B1 over rows whose ``text_col`` matches ``like`` (a pattern string or
    a Column built from other columns) and none of the ``not_like`` patterns."""
    t = F.col(text_col)
    pattern = like if isinstance(like, Column) else F.lit(like)
    filtered = df.filter(F.like(t, pattern))
    for p in not_like:
        filtered = filtered.filter(~t.like(p))
    return latest_per_group(filtered, keys, order)


# --------------------------------------------------------------------- B3
def version_status(servers: DataFrame, versions: DataFrame, latest: DataFrame, latest_sp: DataFrame,
                   server_version: str = "resource_version") -> DataFrame:
    """Installed version vs latest service pack vs latest build per server.

    ``versions`` must be unique per resource_version (checked by the caller's
    data contract) or rows multiply. The lookups are one row per product or
    version: small reference tables, broadcast behind a size check.
    """
    v = broadcast_if_small(versions.select(
        F.col("resource_version").alias("__v"), F.col("product"),
        F.col("resource_version").alias("current_resource_version"),
        F.col("description").alias("current_product_description")))
    c = broadcast_if_small(latest.select(F.col("product").alias("__cp"),
                                         F.col("resource_version").alias("latest_resource_version")))
    vv = broadcast_if_small(versions.select(F.col("resource_version").alias("__vv"),
                                            F.col("description").alias("latest_resource_description")))
    sp = broadcast_if_small(latest_sp.select(F.col("product").alias("__sp"),
                                             F.col("resource_version").alias("latest_sp_resource_version"),
                                             F.col("description").alias("latest_sp_resource_description")))
    out = servers.join(v, servers[server_version] == F.col("__v"), "left")
    out = out.join(c, F.col("__cp") == F.col("product"), "left")
    out = out.join(vv, F.col("__vv") == F.col("latest_resource_version"), "left")
    out = out.join(sp, F.col("__sp") == F.col("product"), "left")
    return out.drop("__v", "__cp", "__vv", "__sp")


# --------------------------------------------------------------------- B6
def bitmask_names(df: DataFrame, mask: str, lookup: DataFrame | list | None = None,
                  out: str = "day_list", sep: str = ", ", none: str = "None") -> DataFrame:
    """Names whose bit is set in ``mask``, joined by ``sep`` in lookup order;
    ``none`` when no bit is set.

    A bitmask over a BIGINT has at most 64 distinct bits, so the lookup is a
    proven-small constant: it is inlined as a literal array and the names are
    picked per row with higher-order functions - a narrow projection, no join
    and no shuffle.
    """
    if lookup is None:
        entries = [(b, n) for b, n, _ in WEEKDAY_BITS]
    elif isinstance(lookup, DataFrame):
        rows = lookup.limit(65).collect()
        if len(rows) > 64:
            raise ValueError("a bitmask lookup has at most 64 bits")
        entries = sorted((int(r[0]), str(r[1])) for r in rows)
    else:
        entries = list(lookup)
    arr = F.array(*[F.struct(F.lit(b).cast("bigint").alias("bit"), F.lit(n).alias("name")) for b, n in entries])
    m = F.col(mask).cast("bigint")
    names = F.transform(F.filter(arr, lambda e: (m.bitwiseAND(e["bit"])) == e["bit"]), lambda e: e["name"])
    return df.withColumn(out, F.when(F.size(names) > 0, F.array_join(names, sep)).otherwise(F.lit(none)))


# --------------------------------------------------------------------- B7
def split_instance(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("machine_name", split_instance_machine(col)) \
             .withColumn("instance_name", split_instance_name(col))


def distinct_machines(df: DataFrame, col: str) -> DataFrame:
    return df.select(split_instance_machine(col).alias("machine_name")).distinct()


def one_per_machine(df: DataFrame, col: str) -> DataFrame:
    """Smallest instance name per machine (partial min aggregation)."""
    return df.groupBy(split_instance_machine(col).alias("machine_name")).agg(F.min(col).alias(col))


# --------------------------------------------------------------------- B8
def implied_permissions(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Closure of permissions implied by each start (class, permission).

    ``edges``: class_desc, permission_name, covering_permission_name,
    parent_class_desc, parent_covering_permission_name. A node is
    (class, permission, level); a "covered by" edge stays in the class at the
    same level, a "parent covered by" edge moves to the parent class one
    level up. For every start and node the greatest path length is kept
    (a node may recur at several levels).

    Nodes are numbered, so the loop moves rows of four numbers. The frontier
    holds the nodes reached by paths of exactly ``depth`` steps, de-duplicated
    per step, so the loop ends when no path is longer. A path of more steps
    than there are nodes repeats one, so the edges hold a cycle and the
    closure has no end: that raises ``ValueError``. Each loop step extends the
    frontier by one edge and is materialised once by a reliable checkpoint
    (shared folder, survives executor loss), so neither the emptiness test nor
    the final union recomputes earlier steps. Nodes that many starts have
    reached (a common parent) meet their edges by broadcast, so none of them
    is one task.
    """
    e = edges.select("class_desc", "permission_name", "covering_permission_name",
                     "parent_class_desc", "parent_covering_permission_name")
    inside = e.filter(F.length("covering_permission_name") > 0).select(
        "class_desc", "permission_name", F.col("class_desc").alias("next_class"),
        F.col("covering_permission_name").alias("next_permission"), F.lit(0).alias("level_step"))
    upward = e.filter(F.length("parent_covering_permission_name") > 0).select(
        "class_desc", "permission_name", F.col("parent_class_desc").alias("next_class"),
        F.col("parent_covering_permission_name").alias("next_permission"), F.lit(1).alias("level_step"))
    named = cut_lineage(inside.unionByName(upward).distinct())
    first = starts.select("class_desc", "permission_name").distinct()
    # the checkpoint fixes the numbers
    nodes = cut_lineage(first.union(named.select("class_desc", "permission_name")).union(
        named.select("next_class", "next_permission")).distinct().select(
            F.monotonically_increasing_id().alias("node"), "class_desc", "permission_name"))

    def number(df: DataFrame, cls: str, permission: str, out: str) -> DataFrame:
        of = nodes.select(F.col("node").alias(out), F.col("class_desc").alias("__c"), F.col("permission_name").alias("__p"))
        return df.join(of, F.col(cls).eqNullSafe(F.col("__c")) & F.col(permission).eqNullSafe(F.col("__p"))).drop(
            "__c", "__p", cls, permission)

    # an edge from a null name is followed by none
    followed = named.filter(F.col("class_desc").isNotNull() & F.col("permission_name").isNotNull())
    steps = cut_lineage(number(number(followed, "class_desc", "permission_name", "node"),
                               "next_class", "next_permission", "next"))
    frontier = cut_lineage(number(first, "class_desc", "permission_name", "start").select(
        "start", F.col("start").alias("node"), F.lit(0).alias("level")))
    n_nodes = named.select("class_desc", "permission_name").union(
        named.select("next_class", "next_permission")).distinct().count()

    def advance(front: DataFrame, by: DataFrame) -> DataFrame:
        return front.join(by, "node").select("start", F.col("next").alias("node"),
                                             (F.col("level") + F.col("level_step")).alias("level"))

    degree = steps.groupBy("node").count().agg(F.max("count")).first()[0] or 0
    reached, depth = [frontier.withColumn("depth", F.lit(0))], 0
    while True:
        n = F.col("count")
        rows, many, hot = frontier.groupBy("node").count().agg(
            F.sum(n), F.sum(F.when(n > HOT_NODE, n)), F.collect_list(F.when(n > HOT_NODE, F.col("node")))).first()
        if not rows:
            break
        if depth > n_nodes:
            raise ValueError("the permission edges hold a cycle; the closure has no end")
        if depth:
            reached.append(frontier.withColumn("depth", F.lit(depth)))
        ahead = []
        if hot:                                            # at most one node per HOT_NODE rows
            by = steps.where(F.col("node").isin(hot))
            ahead.append(advance(frontier.where(F.col("node").isin(hot)),
                                 F.broadcast(by) if len(hot) * degree <= HOT_STEPS else by))
        if rows > (many or 0):
            ahead.append(advance(frontier.where(~F.col("node").isin(hot)), steps) if hot else advance(frontier, steps))
        frontier = cut_lineage(reduce(DataFrame.unionByName, ahead).distinct())
        depth += 1
    longest = reduce(DataFrame.unionByName, reached).groupBy("start", "node", "level").agg(F.max("depth").alias("max_depth"))
    own = nodes.select(F.col("node").alias("start"), F.col("class_desc").alias("start_class"),
                       F.col("permission_name").alias("start_permission"))
    return longest.join(own, "start").join(nodes, "node").select(
        "start_class", "start_permission", "class_desc", "permission_name", "level", "max_depth")


# --------------------------------------------------------------------- B9
def resolve_default(df: DataFrame, entity_value: str, name_col: str, parent: DataFrame, parent_key: str,
                    parent_value: str, default_value: str, sep: str = "\\", out: str = "resolved") -> DataFrame:
    """Value from the entity; else the parent's value + entity name + sep; else
    the global default + entity name + sep."""
    p = parent.select(F.col(parent_key).alias("__pk"), F.col(parent_value).alias("__pv"))
    j = df.join(p, df[parent_key] == F.col("__pk"), "left")
    name = F.col(name_col)
    return j.withColumn(out, F.coalesce(F.col(entity_value), F.concat(F.col("__pv"), name, F.lit(sep)),
                                        F.concat(F.lit(default_value), name, F.lit(sep)))).drop("__pk", "__pv")


# --------------------------------------------------------------------- B10
def maintenance_candidates(df: DataFrame, *, name: str = "name", online: str = "is_online",
                           read_only: str = "is_read_only", snapshot_of: str = "source_database_id",
                           multi_user: str = "is_multi_user", exclude: list[str] = ("model", "tempdb"),
                           exclude_like: str | None = "%checkDB", replicas: DataFrame | None = None,
                           key: str = "database_id") -> DataFrame:
    """Databases eligible for maintenance with their replica role (default 1,
    primary; replaced by the replica's role when it has one)."""
    c = (F.col(online) & ~F.col(read_only) & F.col(snapshot_of).isNull() & F.col(multi_user)
         & ~F.lower(name).isin([x.lower() for x in exclude]))
    if exclude_like:
        c = c & ~F.col(name).ilike(exclude_like)
    out = df.filter(c)
    if replicas is not None:
        r = replicas.select(F.col(key).alias("__k"), F.col("role").alias("__role"),
                            F.col("secondary_role_allow_connections").alias("__allow"))
        out = out.join(r, out[key] == F.col("__k"), "left")
        return out.withColumn("role", F.coalesce("__role", F.lit(1))) \
                  .withColumn("secondary_role_allow_connections", F.coalesce("__allow", F.lit(0))) \
                  .drop("__k", "__role", "__allow")
    return out.withColumn("role", F.lit(1)).withColumn("secondary_role_allow_connections", F.lit(0))


# --------------------------------------------------------------------- B11
def current_rows(df: DataFrame, ts: str, slack_days: int = 1) -> DataFrame:
    """Rows newer than (latest collection time - slack). The max is a scalar
    subquery (computed once, then a constant in the filter; no join)."""
    mx = df.agg(F.max(ts)).scalar()
    return df.filter(F.col(ts) > mx - F.expr(f"INTERVAL {int(slack_days)} DAY"))


def inventory_report(base: DataFrame, lookups: list[tuple[DataFrame, str, str]],
                     flags: dict[str, str] | None = None) -> DataFrame:
    """Join a snapshot table to its lookups (inner joins) and turn flags into
    Yes/No texts. ``lookups``: (df, base_col, lookup_col)."""
    out = base
    for df, bc, lc in lookups:
        out = out.join(df, out[bc] == df[lc], "inner")
        if bc != lc:
            out = out.drop(df[lc])
    for src, name in (flags or {}).items():
        out = out.withColumn(name, yes_no(src))
    return out


def instance_inventory(configurations: DataFrame, properties: DataFrame, servers: DataFrame, *,
                       only_current: bool = True, name_like: str | None = None) -> DataFrame:
    """Instances with their settings, version and whether they are current
    (collected less than a day before the latest collection) and in production.

    configurations: server_name, instance_name, collection_time,
    max_memory_mb, min_memory_mb and any further settings, which pass through;
    properties: server_name, edition, product_level, product_version,
    collation; servers: server_name, is_production. Instances without
    properties or server row are left out. ``name_like`` filters server names,
    without regard to case.
    """
    latest = configurations.agg(F.max("collection_time")).scalar()
    c = configurations.withColumn(
        "is_current", yes_no(F.coalesce(F.col("collection_time") > latest - F.expr("INTERVAL 1 DAY"), F.lit(False))))
    if only_current:
        c = c.filter(F.col("is_current") == "Yes")
    if name_like is not None:
        c = c.filter(F.col("server_name").ilike(name_like))
    p = properties.select("server_name", "edition", F.concat(
        "product_level", F.lit(" ("), "product_version", F.lit(")")).alias("product_version"), "collation")
    s = servers.select("server_name", yes_no(F.coalesce("is_production", F.lit(False))).alias("is_production"))
    out = c.join(broadcast_if_small(p), "server_name").join(broadcast_if_small(s), "server_name")
    return out.withColumn("max_memory_gb", int_div("max_memory_mb", 1024)) \
              .withColumn("min_memory_gb", int_div("min_memory_mb", 1024)) \
              .withColumnRenamed("collection_time", "last_collection_time")


def server_inventory(information: DataFrame) -> DataFrame:
    """Servers with usable and installed memory and their times as
    "dd/MM/yyyy HH:mm:ss" texts. information: server_name, os,
    os_architecture, os_version, os_patch_level, total_visible_memory,
    total_physical_memory, last_boot_time, collection_time."""
    text = "dd/MM/yyyy HH:mm:ss"
    return information.select(
        "server_name", "os", "os_architecture", "os_patch_level", "os_version",
        F.col("total_visible_memory").alias("usable_memory"), F.col("total_physical_memory").alias("installed_memory"),
        F.date_format("last_boot_time", text).alias("last_boot_time"),
        F.date_format("collection_time", text).alias("last_collection_time"))


def disk_inventory(disks: DataFrame, information: DataFrame, server: str | None = None) -> DataFrame:
    """Drives of every known server (or of one) with sizes in MB and whole GB
    and when the server was last read. disks: server_name, drive, volume_name,
    file_system, size_mb, free_mb, free_percent, message; information:
    server_name, collection_time, one row a server."""
    d = disks if server is None else disks.filter(fold_case("server_name", StringType()) == server.lower())
    seen = information.select("server_name", F.col("collection_time").alias("last_collection_time"))
    return d.join(broadcast_if_small(seen), "server_name").select(
        "server_name", "drive", "volume_name", "file_system", "size_mb", int_div("size_mb", 1024).alias("size_gb"),
        "free_mb", int_div("free_mb", 1024).alias("free_gb"), "free_percent", "message", "last_collection_time")
