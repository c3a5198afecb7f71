"""Snapshots, change capture and freshness.

Plain Parquet has no MERGE, so a merge is one full outer join of the current
state with the newly loaded snapshot, tagged with an action per row. From
that single tagged frame the new current state, the pre-images for history
and the change report are all projections, so the expensive join runs once
(persist the tagged frame when several outputs are written).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.checksum import row_checksum, with_row_checksum  # noqa: F401
from fleetsight.functions.scalar import fold_case
from fleetsight.plans.strategies import broadcast_if_small

# Merge actions.
INSERT, UPDATE, DELETE, KEEP, FLAG = "INSERT", "UPDATE", "DELETE", "KEEP", "FLAG"
# Missing-row policies: which current rows absent from the feed are deleted.
#   reported    - delete if the source is unmonitored or the source reported (databases, disks)
#   unmonitored - delete only if the source is unmonitored (configurations, properties)
#   flag        - delete if unmonitored, else keep and set the flag column false (servers)
#   keep        - never delete (services)
POLICIES = ("reported", "unmonitored", "flag", "keep")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


# --------------------------------------------------------------------- A1
def snapshot_merge(current: DataFrame, loading: DataFrame, keys: list[str], *,
                   custom_defaults: dict | None = None, monitored: DataFrame | None = None,
                   source_col: str | None = None, policy: str = "reported",
                   flag_col: str | None = None, source_defaults: DataFrame | None = None) -> DataFrame:
    """Upsert ``loading`` into ``current`` by ``keys`` (text without regard to
    case); returns the tagged frame.

    Output: every column of ``current`` holding the *new* value (for DELETE
    rows, the old one), ``action``, and ``pre`` - a struct with the old row
    (NULL for INSERT). Columns of ``current`` that the feed lacks keep their
    value; new rows take them from ``source_defaults`` (one row per source:
    the source column plus per-source values, e.g. the server's retention)
    or else from ``custom_defaults`` (a literal).
    ``monitored`` is a one-column DataFrame of monitored sources (the
    server list, a few rows per server) matched on ``source_col``. Sources,
    like keys, are matched without regard to case.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    custom_defaults = custom_defaults or {}
    cur_cols = current.columns
    feed_cols = set(loading.columns)
    c = _prefixed(current, "c__")
    lo = _prefixed(loading.select(*[x for x in cur_cols if x in feed_cols]), "l__")
    cond = reduce(lambda a, b: a & b, [fold_case("c__" + k, current.schema[k].dataType)
                                       == fold_case("l__" + k, loading.schema[k].dataType) for k in keys])
    j = c.join(lo, cond, "full_outer")
    in_c = F.col("c__" + keys[0]).isNotNull()
    in_l = F.col("l__" + keys[0]).isNotNull()

    delete_cond: Column = F.lit(False)
    if policy != "keep" and source_col:
        src = fold_case("c__" + source_col, current.schema[source_col].dataType)
        if monitored is not None:
            mon_col = monitored.columns[0]
            mon = broadcast_if_small(monitored.select(
                fold_case(mon_col, monitored.schema[mon_col].dataType).alias("__mon")).distinct())
            j = j.join(mon, src == F.col("__mon"), "left")
            unmonitored = F.col("__mon").isNull()
        else:
            unmonitored = F.lit(False)
        if policy == "reported":
            rep = broadcast_if_small(loading.select(
                fold_case(source_col, loading.schema[source_col].dataType).alias("__rep")).distinct())
            j = j.join(rep, src == F.col("__rep"), "left")
            delete_cond = unmonitored | F.col("__rep").isNotNull()
        else:
            delete_cond = unmonitored
    per_source = set()
    if source_defaults is not None and source_col:
        sd_cols = [c for c in source_defaults.columns if c != source_col and c in cur_cols]
        per_source = set(sd_cols)
        sd = source_defaults.select(
            fold_case(source_col, source_defaults.schema[source_col].dataType).alias("__sd_src"),
            *[F.col(c).alias("__sd_" + c) for c in sd_cols])
        j = j.join(broadcast_if_small(sd), fold_case("l__" + source_col, loading.schema[source_col].dataType)
                   == F.col("__sd_src"), "left")
    action = (F.when(in_c & in_l, F.lit(UPDATE)).when(in_l, F.lit(INSERT))
              .when(delete_cond, F.lit(DELETE))
              .otherwise(F.lit(FLAG if policy == "flag" else KEEP)))
    j = j.withColumn("action", action)

    out_cols = []
    for x in cur_cols:
        if x in keys:
            v = F.coalesce(F.col("l__" + x), F.col("c__" + x))
        elif x in feed_cols:
            v = F.when(in_l, F.col("l__" + x)).otherwise(F.col("c__" + x))
        else:
            default = custom_defaults.get(x)
            dv = default if isinstance(default, Column) else F.lit(default)
            if x in per_source:
                dv = F.coalesce(F.col("__sd_" + x), dv)
            v = F.when(in_c, F.col("c__" + x)).otherwise(dv.cast(current.schema[x].dataType))
        if flag_col and x == flag_col:
            v = F.when(F.col("action") == FLAG, F.lit(False)).when(in_l, F.lit(True)).otherwise(v)
        out_cols.append(v.alias(x))
    pre = F.when(in_c, F.struct(*[F.col("c__" + x).alias(x) for x in cur_cols]))
    return j.select(*out_cols, F.col("action"), pre.alias("pre"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Natural keys that occur more than once (or are NULL): the uniqueness a
    merge relies on is checked, not enforced by storage. One aggregation with
    map-side partial counts."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter((F.col("n_rows") > 1) | null_key)


def merged_current(tagged: DataFrame) -> DataFrame:
    """New current state from a tagged merge."""
    return tagged.filter(F.col("action") != DELETE).drop("action", "pre")


def pre_images(tagged: DataFrame) -> DataFrame:
    """Old rows of UPDATE and DELETE actions (what MERGE ... OUTPUT deleted.* gives)."""
    return tagged.filter(F.col("action").isin(UPDATE, DELETE)).select("pre.*", "action")


# --------------------------------------------------------------------- A2
def append_history(history: DataFrame, pre: DataFrame, keys: list[str], checksum_cols: list[str],
                   checksum: str = "row_checksum") -> DataFrame:
    """Rows of ``pre`` to append to history: those whose (key, checksum) is not
    already there. ``history`` carries its stored checksum column."""
    p = pre.withColumn(checksum, row_checksum(checksum_cols))
    h = history.select(*keys, checksum)
    return p.join(h, on=[*keys, checksum], how="left_anti")


def append_history_bucketed(store, pre: DataFrame, version: int, checksum_cols: list[str],
                            checksum: str = "row_checksum") -> DataFrame:
    """:func:`append_history` against a :class:`fleetsight.sources.bucketed.BucketedHistory`: the run reads only
    the buckets of its own keys, and its new rows are written as version ``version``. Returns them."""
    return store.append_new(pre.withColumn(checksum, row_checksum(checksum_cols)), version, [*store.keys, checksum])


# --------------------------------------------------------------------- A4
def _as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _differ(a: str, b: str, dtype: T.DataType) -> Column:
    """NULL-safe inequality, text without regard to case."""
    return ~fold_case(a, dtype).eqNullSafe(fold_case(b, dtype))


def _same_key_pairs(before: DataFrame, after: DataFrame, keys: list[str], b_cols: list[Column],
                    a_cols: list[Column]) -> DataFrame:
    """Rows of both sides with equal keys (text without regard to case, as the merge matches them); the key
    columns are those of ``after``."""
    b = before.select(*[fold_case(k, before.schema[k].dataType).alias(f"__bk{i}") for i, k in enumerate(keys)], *b_cols)
    a = after.select(*keys, *[fold_case(k, after.schema[k].dataType).alias(f"__ak{i}") for i, k in enumerate(keys)],
                     *a_cols)
    on = reduce(lambda x, y: x & y, [F.col(f"__bk{i}") == F.col(f"__ak{i}") for i in range(len(keys))])
    return b.join(a, on, "inner")


def change_report(before: DataFrame, after: DataFrame, keys: list[str], exclude: list[str] = ()) -> DataFrame:
    """One row per key and changed column: column_name, previous_value, current_value.

    Only keys present on both sides (matched without regard to case and shown
    as in ``after``) and whose checksum differs; a change of case alone is none. NULL shows as ''. Columns come from the schema; the unpivot is a per-row array
    explode (no extra shuffle beyond the key join).
    """
    cols = [c for c in before.columns if c not in keys and c not in exclude and c in after.columns]
    j = _same_key_pairs(
        before, after, keys, [*[F.col(c).alias("b__" + c) for c in cols], row_checksum(cols).alias("b__ck")],
        [*[F.col(c).alias("a__" + c) for c in cols], row_checksum(cols).alias("a__ck")],
    ).filter(F.col("b__ck") != F.col("a__ck"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               _as_text(F.col("b__" + c)).alias("previous_value"),
                               _as_text(F.col("a__" + c)).alias("current_value"),
                               _differ("b__" + c, "a__" + c, before.schema[c].dataType).alias("changed"))
                      for c in cols])
    return (j.select(*keys, F.explode(pairs).alias("p"))
             .filter("p.changed")
             .select(*keys, "p.column_name", "p.previous_value", "p.current_value"))


# --------------------------------------------------------------------- A5
def status_change_report(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Old and new value side by side with a changed flag per column, for rows
    present on both sides with a change (of more than case)."""
    j = _same_key_pairs(
        before, after, keys, [*[F.col(c).alias("old_" + c) for c in cols], row_checksum(cols).alias("__bck")],
        [*[F.col(c).alias("new_" + c) for c in cols], row_checksum(cols).alias("__ack")],
    ).filter(F.col("__bck") != F.col("__ack"))
    sel = list(keys)
    for c in cols:
        sel += [F.col("old_" + c), F.col("new_" + c),
                _differ("old_" + c, "new_" + c, before.schema[c].dataType).alias(c + "_changed")]
    changed = reduce(lambda x, y: x | y, [F.col(c + "_changed") for c in cols])
    return j.select(*sel).filter(changed)


# --------------------------------------------------------------------- A6
def append_if_changed(history: DataFrame, loading: DataFrame, keys: list[str], cols: list[str],
                      ts: str) -> DataFrame:
    """Measurements to append: those with no history row of the same key and
    checksum - except on day 1 of a month, when they are always appended."""
    ck = "__ck"
    lo = loading.withColumn(ck, row_checksum(cols))
    h = history.select(*keys, row_checksum(cols).alias(ck)).distinct()
    cond = [lo[k] == h[k] for k in keys] + [lo[ck] == h[ck], F.dayofmonth(lo[ts]) != 1]
    return lo.join(h, on=reduce(lambda x, y: x & y, cond), how="left_anti").drop(ck)


def append_if_changed_bucketed(store, loading: DataFrame, version: int, cols: list[str], ts: str,
                               checksum: str = "row_checksum") -> DataFrame:
    """:func:`append_if_changed` against a bucketed history, which keeps the checksum of each measurement: the
    run reads only the buckets of its own keys. Returns the measurements written as version ``version``."""
    rows = loading.withColumn(checksum, row_checksum(cols))
    return store.append_new(rows, version, [*store.keys, checksum], always=F.dayofmonth(ts) == 1)


# --------------------------------------------------------------------- A7
def upsert_with_change_date(state: DataFrame, feed: DataFrame, keys: list[str], watched: list[str],
                            now, change_col: str = "change_date") -> DataFrame:
    """Insert new keys; update rows whose watched columns changed (NULL-safe)
    and stamp ``now``. Returns the changed rows with their action."""
    s = _prefixed(state, "s__")
    f = _prefixed(feed, "f__")
    cond = reduce(lambda a, b: a & b, [fold_case("s__" + k, state.schema[k].dataType)
                                       == fold_case("f__" + k, feed.schema[k].dataType) for k in keys])
    j = s.join(f, cond, "right")
    in_s = F.col("s__" + keys[0]).isNotNull()
    changed = reduce(lambda a, b: a | b, [_differ("s__" + w, "f__" + w, state.schema[w].dataType) for w in watched])
    j = j.withColumn("action", F.when(~in_s, F.lit(INSERT)).when(changed, F.lit(UPDATE)))
    j = j.filter(F.col("action").isNotNull())
    now_col = now if isinstance(now, Column) else F.lit(now)
    cols = [F.col("f__" + c).alias(c) for c in feed.columns]
    return j.select(*cols, now_col.alias(change_col), "action")


# --------------------------------------------------------------------- A8
def current_plus_history(current: DataFrame, history: DataFrame, where: Column | None = None) -> DataFrame:
    """Distinct union of current and history rows under one filter."""
    u = current.unionByName(history.select(*[c for c in history.columns if c in current.columns]),
                            allowMissingColumns=True)
    if where is not None:
        u = u.filter(where)
    return u.distinct()


# --------------------------------------------------------------------- A9
def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Oldest collection time per table: {name: (df, ts_col)} -> (table_name, oldest)."""
    parts = [df.agg(F.min(ts).cast("timestamp_ntz").alias("oldest_collection_time"))
             .select(F.lit(name).alias("table_name"), "oldest_collection_time")
             for name, (df, ts) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------- A10
def stale_sources(df, source_col: str, ts_col: str, now, max_age_hours: float = 3.0,
                  monitored: DataFrame | None = None, monitored_col: str | None = None,
                  source_machine: Column | None = None) -> DataFrame:
    """Newest time per source, kept when older than ``now`` - max_age; only
    sources whose machine part is in the monitored list (equi-join).

    ``df`` is one DataFrame with a source column, or a dict {source name:
    DataFrame} of per-source tables (one collection database per machine),
    whose newest times are unioned (one global aggregate per table)."""
    if isinstance(df, dict):
        df = reduce(DataFrame.unionByName, [
            t.agg(F.max(ts_col).alias(ts_col)).select(F.lit(name).alias(source_col), ts_col)
            for name, t in df.items()])
    newest = df.groupBy(source_col).agg(F.max(ts_col).alias("last_data_collection"))
    now_col = now if isinstance(now, Column) else F.lit(now)
    limit = now_col - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600))
    out = newest.filter(F.col("last_data_collection") < limit)
    if monitored is not None:
        machine = source_machine if source_machine is not None else F.col(source_col)
        out = out.withColumn("__machine", machine)
        mon = monitored.select(F.col(monitored_col).alias("__machine")).distinct()
        out = out.join(mon, "__machine", "left_semi").drop("__machine")
    return out


# --------------------------------------------------------------------- A11
def missing_or_failed(expected: DataFrame, last_status: DataFrame, key: str, status_col: str,
                      failed_value: str = "Failed") -> DataFrame:
    """Every expected source with its last status; flagged when absent or failed."""
    j = expected.join(last_status, on=key, how="left")
    st = F.coalesce(F.col(status_col), F.lit("-"))
    return j.withColumn("flagged", st.isin("-", failed_value))


# --------------------------------------------------------------------- A12
def load_with_drift(feed: DataFrame, target: T.StructType) -> DataFrame:
    """Align a feed with fewer or more columns to the target schema: missing
    columns become NULL, types are cast, and columns the target lacks are
    added behind its own (the target table grows with the feed)."""
    have = {c.lower(): c for c in feed.columns}
    cols = []
    for f in target.fields:
        src = have.get(f.name.lower())
        v = F.col(f"`{src}`").cast(f.dataType) if src else F.lit(None).cast(f.dataType)
        cols.append(v.alias(f.name))
    known = {f.name.lower() for f in target.fields}
    return feed.select(*cols, *[F.col(f"`{c}`") for c in feed.columns if c.lower() not in known])


# --------------------------------------------------------------------- A13
def pivot_settings(df: DataFrame, key: str, name: str, value: str, names: list[str],
                   enabled: Column | None = None) -> DataFrame:
    """Name/value rows -> one row per key with a column per name (static list,
    so no distinct job), plus the ordered list of enabled names."""
    flag = enabled if enabled is not None else F.col(value).isNotNull()
    # one aggregation with a conditional max per name (a static pivot with
    # map-side partial aggregation) plus the ordered list of enabled names,
    # bounded by the length of ``names``
    cols = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    enabled_list = F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col(name)))), ", ")
    out = df.groupBy(key).agg(*cols, enabled_list.alias("enabled_list"))
    return out.withColumn("enabled_list", F.when(F.col("enabled_list") != "", F.col("enabled_list")))


# --------------------------------------------------------------------- A14
def last_event_by_type(df: DataFrame, key: str, type_col: str, ts: str, types: list[str]) -> DataFrame:
    """Latest time per event type as columns (conditional max per type)."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(type_col) == t, F.col(ts))).alias(f"last_{t}")
                                 for t in types])


# --------------------------------------------------------------------- A15
def assemble_wide(base: DataFrame, key: str, parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """One row per entity: left joins of pre-aggregated parts (one row per key
    each), so a part never multiplies base rows."""
    out = base
    for df, k in parts:
        out = out.join(df, out[key] == df[k], "left")
        if k != key:
            out = out.drop(df[k])
    return out


# --------------------------------------------------------------------- A16
def capture_lines(df: DataFrame, source: str, text: str) -> DataFrame:
    """Captured command output (one text per source, e.g. read with
    ``spark.read.text(path, wholetext=True)``) -> (source, line_no, line).
    A capture is one small file, so splitting it inside a row is bounded."""
    return df.select(source, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def parse_key_value(lines: DataFrame, source: str, keys: dict[str, str] | None = None,
                    sum_keys: dict[str, str] | None = None, count_keys: dict[str, str] | None = None,
                    paren_keys: dict[str, str] | None = None) -> DataFrame:
    """'Key: value' lines -> one record per source.

    ``keys``: {key: out_col} first value of the key; ``sum_keys``: values of
    all lines of a key summed (leading number of the value); ``count_keys``:
    number of lines of a key; ``paren_keys``: the text in parentheses of
    the key's value. Lines without a colon are ignored.
    """
    kv = lines.select(source, "line_no",
                      F.trim(F.regexp_extract("line", r"^([^:]+):", 1)).alias("__k"),
                      F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("__v")).filter(F.col("__k") != "")
    aggs = []
    for k, out in (keys or {}).items():
        aggs.append(F.min_by(F.when(F.col("__k") == k, F.col("__v")),
                             F.when(F.col("__k") == k, F.col("line_no"))).alias(out))
    for k, out in (sum_keys or {}).items():
        num = F.regexp_replace(F.regexp_extract("__v", r"^([0-9][0-9,.]*)", 1), ",", "").try_cast("decimal(20,2)")
        aggs.append(F.sum(F.when(F.col("__k") == k, num)).alias(out))
    for k, out in (count_keys or {}).items():
        aggs.append(F.count(F.when(F.col("__k") == k, 1)).alias(out))
    for k, out in (paren_keys or {}).items():
        aggs.append(F.max(F.when(F.col("__k") == k, F.regexp_extract("__v", r"\(([^)]*)\)", 1))).alias(out))
    return kv.groupBy(source).agg(*aggs)


def parse_fixed_width(lines: DataFrame, source: str, columns: list[str], header_regex: str,
                      keep: str | None = None) -> DataFrame:
    """Fixed-width text whose column offsets come from each source's header line.

    The header line (first line matching ``header_regex``) gives the start
    of every column name; data lines are cut at those offsets and trimmed.
    Blank lines, the header itself and lines not matching ``keep`` are
    dropped as junk. The header offsets are one row per source.
    """
    hdr = lines.filter(F.col("line").rlike(header_regex)).groupBy(source).agg(
        F.min_by("line", "line_no").alias("__h"), F.min("line_no").alias("__hno"))
    starts = [F.instr(F.col("__h"), c) for c in columns]
    hdr = hdr.select(source, "__hno", *[s.alias(f"__s{i}") for i, s in enumerate(starts)])
    d = lines.join(hdr, source).filter((F.col("line_no") > F.col("__hno")) & (F.trim("line") != ""))
    if keep:
        d = d.filter(F.col("line").rlike(keep))
    cols = []
    for i, c in enumerate(columns):
        start = F.col(f"__s{i}")
        length = (F.col(f"__s{i + 1}") - start) if i + 1 < len(columns) else F.length("line") - start + 1
        cols.append(F.trim(F.substring(F.col("line"), start, length)).alias(c))
    return d.select(source, "line_no", *cols)


# ------------------------------------------------------------ lifecycle (3.1)
def process_snapshot(spark, *, current_path: str, history_path: str, report_path: str, loading: DataFrame,
                     keys: list[str], checksum_cols: list[str], version: int,
                     initial: DataFrame | None = None, check_keys: bool = True,
                     history_buckets: int | None = None, **merge_args) -> dict:
    """Load -> merge (A1) -> history (A2) -> change report (A4).

    The new current state is written as a new version and becomes visible
    only when complete; history and report get one partition per version.
    An empty load changes nothing (the reference's guard). A run for version
    n reads the state and history below n and replaces its own partitions,
    so rerunning a failed (or finished) version gives the same tables.

    The tagged merge frame feeds three outputs, so it is checkpointed once
    to the shared checkpoint folder (reliable: survives executor loss).
    With ``history_buckets`` the history is laid out by key hash and a run
    reads only the buckets of its own keys.
    """
    from fleetsight.sources.bucketed import BucketedHistory
    from fleetsight.session import cut_lineage
    from fleetsight.sources.versioned import read_below, read_current, write_version

    if loading.isEmpty():
        return {"status": "empty load", "version": None}
    if check_keys and not duplicate_keys(loading, keys).isEmpty():
        raise ValueError(f"loaded snapshot has duplicate or NULL keys {keys}; nothing merged")
    current = read_current(spark, current_path, below=version)
    if current is None:
        current = initial if initial is not None else loading.limit(0)
    tagged = cut_lineage(snapshot_merge(current, loading, keys, **merge_args))
    pre = pre_images(tagged)
    # a version's folder is replaced whole, so a rerun without changes leaves none of the earlier run's rows
    if history_buckets:
        append_history_bucketed(BucketedHistory(spark, history_path, keys, history_buckets), pre, version, checksum_cols)
    else:
        history = read_below(spark, history_path, version)
        new_hist = (pre.withColumn("row_checksum", row_checksum(checksum_cols)) if history is None
                    else append_history(history, pre, keys, checksum_cols))
        write_version(new_hist, history_path, version)
    write_version(change_report(current, merged_current(tagged), keys), report_path, version)
    write_version(merged_current(tagged), current_path, version)
    return {"status": "merged", "version": version}
