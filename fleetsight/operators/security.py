"""Security audit.

Lists are aggregated per principal before they are joined, so a join never
multiplies rows; each list is bounded by the roles, permissions or members
of one principal in the data model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.aggregates import ordered_list
from fleetsight.functions.scalar import code_text, yes_no
from fleetsight.plans.strategies import broadcast_if_small, spread_by

# Principal names excluded from orphan checks.
SYSTEM_PRINCIPALS = ["dbo", "guest", "INFORMATION_SCHEMA", "sys"]


# --------------------------------------------------------------------- F1
def principal_roles(principals: DataFrame, members: DataFrame, *, principal_id: str = "principal_id",
                    role_id: str = "role_id", member_id: str = "member_id", name: str = "name",
                    connect: DataFrame | None = None, logins: DataFrame | None = None,
                    sid: str = "sid", with_members: bool = False) -> DataFrame:
    """Principal, connect right (Yes/No), ordered role list and the login
    matched on sid. The members of a role are rows (:func:`role_members`), as
    nothing bounds them; ``with_members`` adds them as an ordered list, for
    roles that are known to be small."""
    names = principals.select(F.col(principal_id).alias("__id"), F.col(name).alias("__name"))
    roles_of = (members.join(names, members[role_id] == F.col("__id"))
                .groupBy(F.col(member_id).alias("__pid"))
                .agg(ordered_list("__name", "__name", ", ", distinct=True).alias("role_list")))
    out = principals.join(roles_of, principals[principal_id] == F.col("__pid"), "left").drop("__pid")
    if with_members:
        members_of = (members.join(names, members[member_id] == F.col("__id"))
                      .groupBy(F.col(role_id).alias("__rid"))
                      .agg(ordered_list("__name", "__name", ", ", distinct=True).alias("member_list")))
        out = out.join(members_of, out[principal_id] == F.col("__rid"), "left").drop("__rid")
    if connect is not None:
        c = connect.select(F.col(connect.columns[0]).alias("__cid")).distinct().withColumn("__c", F.lit(True))
        out = out.join(c, out[principal_id] == F.col("__cid"), "left") \
                 .withColumn("has_connect", yes_no(F.coalesce("__c", F.lit(False)))).drop("__cid", "__c")
    if logins is not None:
        lg = logins.select(F.col(sid).alias("__sid"), F.col("login_name"))
        out = out.join(lg, out[sid] == F.col("__sid"), "left").drop("__sid")
    return out


def role_members(principals: DataFrame, members: DataFrame, *, principal_id: str = "principal_id",
                 role_id: str = "role_id", member_id: str = "member_id", name: str = "name") -> DataFrame:
    """One row per role and member (a role's members are not bounded, so they
    are rows, not a list)."""
    names = principals.select(F.col(principal_id).alias("__id"), F.col(name).alias("__name"))
    pairs = members.select(F.col(role_id).alias("__r"), F.col(member_id).alias("__m")).distinct()
    role = names.select(F.col("__id").alias("__r"), F.col("__name").alias("role_name"))
    member = names.select(F.col("__id").alias("__m"), F.col("__name").alias("member_name"))
    return pairs.join(role, "__r").join(member, "__m").select(
        F.col("__r").alias(role_id), "role_name", F.col("__m").alias(member_id), "member_name")


# --------------------------------------------------------------------- F2
# The classes of what a permission is granted on, and their texts.
CLASS_TEXTS = {0: "DATABASE", 1: "OBJECT_OR_COLUMN", 3: "SCHEMA", 6: "TYPE"}


def quote_name(c) -> Column:
    """Name in brackets, a closing bracket doubled."""
    return F.concat(F.lit("["), F.replace(F.col(c) if isinstance(c, str) else c, F.lit("]"), F.lit("]]")), F.lit("]"))


def name_grants(grants: DataFrame, *, objects: DataFrame, schemas: DataFrame, types: DataFrame,
                database: str = "database_name", cls: str = "class", major: str = "major_id") -> DataFrame:
    """Grants with ``object_name`` and ``class_desc`` of what they are on, by
    class: the database (0), ``[schema].[object]`` with the object's own type
    (1), a schema (3) or a type (6). Other classes, and ids that are not
    there, have a null name.

    objects: object_id, schema_name, name, type_desc; schemas: schema_id,
    name; types: type_id, name. The three lists are one list by (class, id),
    so grants meet them in one join; those on the database meet nothing.
    """
    names = reduce(DataFrame.unionByName, [
        objects.select(F.lit(1).alias("__c"), F.col("object_id").cast("bigint").alias("__i"), F.concat(
            quote_name("schema_name"), F.lit("."), quote_name("name")).alias("__n"), F.col("type_desc").alias("__t")),
        *[df.select(F.lit(code).alias("__c"), F.col(key).cast("bigint").alias("__i"), quote_name("name").alias("__n"),
                    F.lit(None).cast("string").alias("__t"))
          for code, df, key in ((3, schemas, "schema_id"), (6, types, "type_id"))]])
    on = (F.col(cls) == F.col("__c")) & (F.col(major).cast("bigint") == F.col("__i"))
    named = grants.filter(F.coalesce(F.col(cls) != 0, F.lit(True))).join(broadcast_if_small(names), on, "left")
    named = named.withColumn("object_name", F.col("__n")) \
                 .withColumn("class_desc", F.coalesce(F.col("__t"), code_text(cls, CLASS_TEXTS)))
    whole = grants.filter(F.col(cls) == 0).withColumn("object_name", quote_name(database)) \
                  .withColumn("class_desc", F.lit(CLASS_TEXTS[0]))
    return whole.unionByName(named.drop("__c", "__i", "__n", "__t"))


def principal_permissions(grants: DataFrame, *, grantee: str = "grantee_id", obj: str = "object_name",
                          state: str = "state", permission: str = "permission",
                          column: str = "column_name", by: tuple[str, ...] = ()) -> DataFrame:
    """One row per principal x object x state: distinct permissions, each
    followed by "(col, ...)" when granted on columns. ``by``: further columns
    that tell objects apart, as class and id of :func:`name_grants`."""
    # one exchange by the result's key, in partitions of a fixed size, and one aggregation: a group holds the
    # different (permission, column) pairs of one principal, object and state
    key = [grantee, *by, obj, state]
    g = spread_by(grants.select(*key, F.col(permission).alias("__p"), F.col(column).alias("__c")), key)
    pairs = g.groupBy(*key).agg(F.collect_set(F.struct("__p", "__c")).alias("__pairs"))
    permissions = F.array_sort(F.array_compact(F.array_distinct(F.col("__pairs.__p"))))

    def item(p):
        held = F.filter("__pairs", lambda x: (x["__p"] == p) & x["__c"].isNotNull())
        cols = F.array_join(F.transform(F.array_sort(F.transform(held, lambda x: x["__c"])), lambda c: c.cast("string")), ", ")
        return F.when(cols == "", p.cast("string")).otherwise(F.concat(p.cast("string"), F.lit(" ("), cols, F.lit(")")))

    items = F.transform(permissions, item)
    return pairs.select(*key, F.when(F.size(items) > 0, F.array_join(items, ", ")).alias("permission_list"))


# --------------------------------------------------------------------- F3
def orphan_principals(principals: DataFrame, logins: DataFrame, *, sid: str = "sid", login_sid: str = "sid",
                      name: str = "name", exclude: list[str] = SYSTEM_PRINCIPALS,
                      type_filter: Column | None = None, type_col: str = "principal_type_desc") -> DataFrame:
    """Principals with no login of the same sid (anti join), system names
    excluded; SQL users only, where ``type_col`` tells, unless ``type_filter``
    says otherwise."""
    p = principals.filter(~F.lower(name).isin([x.lower() for x in exclude]))
    if type_filter is None and type_col in principals.columns:
        type_filter = F.col(type_col) == "SQL_USER"
    if type_filter is not None:
        p = p.filter(type_filter)
    lg = logins.select(F.col(login_sid).alias("__sid")).filter(F.col("__sid").isNotNull())
    return p.join(lg, p[sid] == F.col("__sid"), "left_anti")


# --------------------------------------------------------------------- F4
def login_audit(logins: DataFrame, lists: dict[str, tuple[DataFrame, str, str]], *, key: str = "login_id",
                disabled: str = "is_disabled", name_like: str | None = None,
                members: DataFrame | None = None, member_name: str = "member_name") -> DataFrame:
    """Login with its disabled flag and one ordered list per entry of
    ``lists`` ({out_col: (pairs_df, key_col, value_col)}); each list is
    pre-aggregated per login, then left-joined, so its values must be few per
    login (roles, permissions, mapped users). What grows without bound, as
    the members of a group, is given as rows by :func:`login_entries`.
    ``name_like`` keeps logins whose name matches or that have a matching
    member (EXISTS)."""
    out = logins.withColumn("disabled", yes_no(disabled))
    # lists read from the same DataFrame and key share one aggregation (one shuffle)
    groups: dict = {}
    for col_name, (pairs, k, v) in lists.items():
        groups.setdefault((id(pairs), k), (pairs, k, []))[2].append((col_name, v))
    for pairs, k, items in groups.values():
        agg = pairs.groupBy(F.col(k).alias("__k")).agg(
            *[ordered_list(f"`{v}`", f"`{v}`", ", ", distinct=True).alias(c) for c, v in items])
        out = out.join(agg, out[key] == F.col("__k"), "left").drop("__k")
    if name_like is not None:
        match = F.col("login_name").ilike(name_like)
        if members is not None:
            m = members.filter(F.col(member_name).ilike(name_like)).select(F.col(key).alias("__mk")).distinct() \
                .withColumn("__m", F.lit(True))
            out = out.join(m, out[key] == F.col("__mk"), "left")
            match = match | F.col("__m").isNotNull()
            out = out.filter(match).drop("__mk", "__m")
        else:
            out = out.filter(match)
    return out


def login_entries(logins: DataFrame, entries: dict[str, tuple[DataFrame, str, str]], *, key: str = "login_id",
                  name: str = "login_name") -> DataFrame:
    """One row per login and entry: (key, name, kind, value), each value once.
    ``entries``: {kind: (pairs_df, key_col, value_col)}, such as the members
    of groups; any number of values per login."""
    parts = [df.select(F.col(k).alias(key), F.lit(kind).alias("kind"), F.col(v).cast("string").alias("value"))
             for kind, (df, k, v) in entries.items()]
    rows = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull()).distinct()
    return logins.select(key, name).join(rows, key).select(key, name, "kind", "value")
