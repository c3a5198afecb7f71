"""Workload and index analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.aggregates import exact_mean, ordered_list
from fleetsight.functions.scalar import fmt_seconds, ratio_half_up
from fleetsight.plans.strategies import top_n_per_group

# Execution outcomes, in report order.
OUTCOMES = ["Regular", "Aborted", "Exception"]


# --------------------------------------------------------------------- D1
def interval_overlap(df: DataFrame, start: str, end: str, frm, to) -> DataFrame:
    """Intervals touching [frm, to]: start <= to and end >= frm."""
    return df.filter((F.col(start) <= F.lit(to)) & (F.col(end) >= F.lit(frm)))


# --------------------------------------------------------------------- D4
def outcome_counts(df: DataFrame, keys: list[str], outcome: str, count: str,
                   outcomes: list[str] = OUTCOMES) -> DataFrame:
    """Executions per outcome as columns (absent -> 0), total and a breakdown text.

    Conditional sums in one aggregation: same result as a static pivot, with
    partial (map-side) aggregation and no extra distinct job.
    """
    sums = [F.coalesce(F.sum(F.when(F.col(outcome) == o, F.col(count))), F.lit(0)).cast("bigint").alias(o)
            for o in outcomes]
    out = df.groupBy(*keys).agg(*sums)
    return out.select(
        *keys, *outcomes,
        sum((F.col(o) for o in outcomes[1:]), F.col(outcomes[0])).alias("total_executions"),
        F.concat(F.lit("(Successful:"), F.col(outcomes[0]).cast("string"),
                 F.lit(", Aborted:"), F.col(outcomes[1]).cast("string"),
                 F.lit(", Exceptions:"), F.col(outcomes[2]).cast("string"), F.lit(")"))
        .alias("total_executions_breakdown"))


# ------------------------------------------------------------------ D2 / D3
# Sort choices: name -> (kind, measure). "total_executions" sorts by the
# execution count; avg_* by the unweighted mean; total_* by the weighted total.
def sort_choices(measures: list[str]) -> dict[str, str]:
    choices = {"total_executions": "total_executions"}
    for m in measures:
        choices[f"avg_{m}"] = f"avg_{m}"
        choices[f"total_{m}"] = f"total_{m}"
    return choices


def top_workload(stats: DataFrame, *, group_cols: list[str], plan_col: str, count_col: str,
                 measures: dict[str, str], outcome_col: str | None = None,
                 interval_col: str | None = None, per_interval: bool = False,
                 order_by: str = "total_duration", n: int = 10,
                 lookup: DataFrame | None = None, lookup_key: str | None = None,
                 intervals: DataFrame | None = None, filters: Column | None = None,
                 start_col: str | None = None, end_col: str | None = None,
                 waits: DataFrame | None = None, wait_category: str = "wait_category_desc",
                 wait_total: str = "total_query_wait_time_ms",
                 wait_avg: str = "avg_query_wait_time_ms") -> DataFrame:
    """Top-n plans per group by a sort choice, with D3 percentages.

    ``measures`` maps a measure name to a per-row average column; the total
    of a measure is SUM(count * avg) (execution weighted), its mean the
    unweighted AVG over the rows. Each outcome count is summed on its own
    rows (no pre-pivot join that would multiply counts). ``intervals`` (a
    column named as ``interval_col``, from :func:`interval_overlap`) and
    ``filters`` (by query, plan, object, hash) choose the statistics before
    ranking and period totals; with ``start_col`` and ``end_col`` a plan
    shows its first start and last end.
    """
    if intervals is not None:
        chosen = intervals.select(interval_col).distinct()
        stats = stats.join(chosen, interval_col, "left_semi")
        if waits is not None and interval_col in waits.columns:
            waits = waits.join(chosen, interval_col, "left_semi")
    if filters is not None:
        stats = stats.filter(filters)
    keys = [*group_cols, plan_col] + ([interval_col] if per_interval and interval_col else [])
    cnt = F.col(count_col)
    aggs: list[Column] = [F.sum(cnt).cast("bigint").alias("total_executions")]
    if outcome_col:
        for o, name in zip(OUTCOMES, ["total_exec_successful", "total_exec_aborted", "total_exec_exceptions"]):
            aggs.append(F.coalesce(F.sum(F.when(F.col(outcome_col) == o, cnt)), F.lit(0)).cast("bigint").alias(name))
    if start_col:
        aggs.append(F.min(start_col).alias("first_start"))
    if end_col:
        aggs.append(F.max(end_col).alias("last_end"))
    for m, c in measures.items():
        aggs.append(exact_mean(c).alias(f"avg_{m}"))
        aggs.append(F.sum(_weighted(stats, cnt, c)).alias(f"total_{m}"))
    per_plan = stats.groupBy(*keys).agg(*aggs)

    choices = sort_choices(list(measures))
    if order_by not in choices:
        raise ValueError(f"order_by must be one of {sorted(choices)}")
    ranked = top_n_per_group(per_plan, group_cols, [F.col(choices[order_by]).desc(), *[F.col(k) for k in keys]], n)

    # D3: period totals per group from the per-plan totals: the same exchange
    # serves the ranking and the totals, so the statistics are scanned once
    totals = per_plan.groupBy(*group_cols).agg(*[F.sum(f"total_{m}").alias(f"period_{m}") for m in measures])
    # one row per group joined to n rows per group; without groups the totals
    # are scalar subqueries (computed once, constants in the projection)
    if group_cols:
        out = ranked.join(totals, on=group_cols, how="inner")
    else:
        out = ranked
        for m in measures:
            out = out.withColumn(f"period_{m}", totals.select(f"period_{m}").scalar())
    # percentages and the breakdown text in one projection
    extra = [F.coalesce(ratio_half_up(F.col(f"total_{m}") * 100, F.col(f"period_{m}"), 2, "decimal(5,2)"),
                        F.lit(0).cast("decimal(5,2)")).alias(f"percent_{m}") for m in measures]
    if outcome_col:
        extra.append(F.concat(
            F.lit("(Successful:"), F.col("total_exec_successful").cast("string"),
            F.lit(", Aborted:"), F.col("total_exec_aborted").cast("string"),
            F.lit(", Exceptions:"), F.col("total_exec_exceptions").cast("string"), F.lit(")"))
            .alias("total_executions_breakdown"))
    keep = [c for c in out.columns if not c.startswith("period_")]
    out = out.select(*keep, *extra)
    if waits is not None:
        out = _with_waits(out, waits, keys, group_cols, wait_category, wait_total, wait_avg)
    if lookup is not None:
        out = out.join(lookup, out[plan_col] == lookup[lookup_key], "left").drop(lookup[lookup_key])
    return out


def _with_waits(top: DataFrame, waits: DataFrame, keys: list[str], group_cols: list[str],
                category: str, total: str, avg: str) -> DataFrame:
    """Wait totals, mean and per-category breakdown of the chosen plans, and
    their percent of the period's waits. Only the waits of the top-n plans
    are aggregated (semi join with the small ranked set)."""
    chosen = waits.join(top.select(*keys), keys, "left_semi")
    per_plan = category_breakdown(chosen, keys, category, total, avg).select(
        *keys, F.col("total").alias("total_query_wait_time_ms"),
        F.col("breakdown").alias("total_query_wait_time_ms_breakdown"),
        F.col("mean").alias("avg_query_wait_time_ms"))
    period = waits.groupBy(*group_cols).agg(F.sum(total).alias("__wait_period"))
    out = top.join(per_plan, keys, "left")
    if group_cols:
        out = out.join(period, group_cols, "left")
    else:
        out = out.withColumn("__wait_period", period.scalar())
    out = out.withColumn("total_query_wait_time_ms", F.coalesce("total_query_wait_time_ms", F.lit(0)))
    out = out.withColumn("total_query_wait_time_ms_breakdown",
                         F.coalesce("total_query_wait_time_ms_breakdown", F.lit("-")))
    out = percent_of_period(out, {"total_query_wait_time_ms": "__wait_period"},
                            {"total_query_wait_time_ms": "percent_query_wait_time"})
    return out.drop("__wait_period")


def _weighted(stats: DataFrame, cnt: Column, c: str) -> Column:
    """count * measure; integral products are 64-bit where they fit and
    decimal(38,0) where they do not, and summed as decimal(38,0), which stays
    exact however many rows a plan has."""
    from pyspark.sql.types import IntegralType
    if not isinstance(stats.schema[c].dataType, IntegralType):
        return cnt * F.col(c)
    wide = (cnt.cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.coalesce(F.try_multiply(cnt.cast("bigint"), F.col(c).cast("bigint")).cast("decimal(38,0)"), wide)


def percent_of_period(df: DataFrame, totals: dict[str, str], names: dict[str, str]) -> DataFrame:
    """D3: each total as a percent of its period total, decimal(5,2), 0 when the period is 0."""
    for part, whole in totals.items():
        pct = ratio_half_up(F.col(part) * 100, F.col(whole), 2, "decimal(5,2)")
        df = df.withColumn(names[part], F.coalesce(pct, F.lit(0).cast("decimal(5,2)")))
    return df


# --------------------------------------------------------------------- D5
def category_breakdown(df: DataFrame, key: list[str], category: str, total: str, avg: str) -> DataFrame:
    """Two-level aggregation: per (key, category) total and mean, then per key
    the sum, the mean of means and "CAT (Total: x - Avg: y), ..." by total desc."""
    per_cat = df.groupBy(*key, category).agg(
        F.sum(F.col(total)).alias("cat_total"),
        exact_mean(avg).alias("cat_avg"))
    per_cat = per_cat.withColumn("cat_avg_int", F.col("cat_avg").cast("bigint"))
    item = (f"concat(`{category}`, ' (Total: ', cast(cat_total as string), ' - Avg: ', "
            f"cast(cat_avg_int as string), ')')")
    return per_cat.groupBy(*key).agg(
        F.sum("cat_total").alias("total"),
        F.count(F.lit(1)).alias("n_categories"),
        # mean of the categories' means, added in ascending order so that task order does not matter
        F.aggregate(F.array_sort(F.collect_list("cat_avg")), F.lit(0.0), lambda a, v: a + v).alias("__sum"),
        F.count("cat_avg").alias("__n"),
        ordered_list(item, ["cat_total DESC", f"`{category}`"], ", ").alias("breakdown")).withColumn(
        "mean", F.col("__sum") / F.nullif(F.col("__n"), F.lit(0))).drop("__sum", "__n")


# --------------------------------------------------------------------- D6
def unused_items(items: DataFrame, usage: DataFrame, item_key: str, usage_key: str,
                 seeks_col: str = "seeks", threshold: int = 100,
                 keep: Column | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Items with at most ``threshold`` uses; an item absent from usage has 0.
    With ``columns`` (item_key, column_name, key_ordinal, is_included) the
    ordered key and included column lists are added for the items kept."""
    use = usage.groupBy(usage_key).agg(F.sum(seeks_col).alias("__seeks"))
    out = items.join(use, items[item_key] == use[usage_key], "left").drop(use[usage_key])
    out = out.withColumn("user_seeks", F.coalesce(F.col("__seeks"), F.lit(0)).cast("bigint")).drop("__seeks")
    out = out.filter(F.col("user_seeks") <= threshold)
    if keep is not None:
        out = out.filter(keep)
    if columns is not None:
        lists = columns.join(out.select(item_key), item_key, "left_semi").groupBy(item_key).agg(
            ordered_list("CASE WHEN NOT is_included THEN column_name END", ["key_ordinal", "column_name"], ", ")
            .alias("key_columns"),
            ordered_list("CASE WHEN is_included THEN column_name END", ["column_name"], ", ").alias("included_columns"))
        out = out.join(lists, item_key, "left")
    return out


# --------------------------------------------------------------------- D7
def totals_with_grand(df: DataFrame, key: str, size: str, total_label: str | None = None) -> DataFrame:
    """Size and count per key plus one overall row (GROUPING SETS ((k), ()))."""
    out = df.rollup(key).agg(F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("n_items"),
                             F.grouping(key).alias("is_total"))
    out = out.withColumn("is_total", F.col("is_total") == 1)
    if total_label is not None:
        out = out.withColumn(key, F.when(F.col("is_total"), F.lit(total_label)).otherwise(F.col(key).cast("string")))
    return out


# --------------------------------------------------------------------- D8
def duplicate_signatures(members: DataFrame, item_key: list[str], member: str, order: str,
                         included: str | None = None, scope: list[str] = ()) -> DataFrame:
    """Items whose ordered member list (and included list) equals another item's
    of the same ``scope`` (database and table of an index).

    Few items repeat, so lists are built for few. First every item gets a
    signature that does not depend on order - the number of its members and
    the sums of their hashes (a hash aggregate with map-side partial sums);
    equal lists have equal signatures. Only items whose signature occurs
    again in the scope have their lists collected (bounded by one item's
    members), compared exactly and counted. The lists are rendered as text
    for the result.
    """
    def sums(c: str, tag: str) -> list[Column]:
        h = F.when(F.col(c).isNotNull(), F.xxhash64(c))          # two halves, so that no sum can overflow
        return [F.count(c).alias(f"__n{tag}"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"__lo{tag}"),
                F.sum(F.shiftrightunsigned(h, 32)).alias(f"__hi{tag}")]

    key = [*scope, *item_key]
    marks = sums(member, "k") + (sums(included, "i") if included else [])
    rough = members.groupBy(*key).agg(*marks)
    rough_cols = [c for c in rough.columns if c not in key]
    again = rough.groupBy(*scope, *rough_cols).agg(F.count(F.lit(1)).alias("__items")).filter("__items > 1")
    same = [rough[c].eqNullSafe(again[c]) for c in [*scope, *rough_cols]]
    likely = rough.join(again, reduce(lambda a, b: a & b, same), "left_semi").select(*key)

    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(member).alias("m"))))
    aggs = [F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda x: x["m"]).alias("__key")]
    if included:
        aggs.append(F.array_sort(F.collect_list(included)).alias("__inc"))
    same = [members[c].eqNullSafe(likely[c]) for c in key]
    sig = members.join(likely, reduce(lambda a, b: a & b, same), "left_semi").groupBy(*key).agg(*aggs)
    sig_cols = [*scope, "__key"] + (["__inc"] if included else [])
    counts = sig.groupBy(*sig_cols).agg(F.count(F.lit(1)).alias("n_duplicates")).filter("n_duplicates > 1")
    out = sig.join(counts, on=sig_cols, how="inner")
    text = [F.array_join(F.col("__key").cast("array<string>"), ",").alias("key_list")]
    if included:
        text.append(F.array_join(F.col("__inc").cast("array<string>"), ",").alias("included_list"))
    return out.select(*text, *scope, *item_key, "n_duplicates")


# --------------------------------------------------------------------- D9
def column_selectivity(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct count and density (1 / distinct) per column, in one aggregation."""
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    wide = df.agg(*[fn(c).alias(c) for c in cols], F.count(F.lit(1)).alias("__rows"))
    stack = F.expr("stack({}, {})".format(len(cols), ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in cols)))
    long = wide.select(F.col("__rows").alias("n_rows"), stack.alias("column_name", "n_distinct"))
    return long.withColumn("density", F.when(F.col("n_distinct") > 0, F.lit(1.0) / F.col("n_distinct")))


def rank_missing_index(details: DataFrame, columns: DataFrame, selectivity: DataFrame,
                       group: list[str] = ("database_id",)) -> DataFrame:
    """Missing-index suggestions: key = equality columns then inequality
    columns, each most selective (lowest density) first; include columns
    that are already in the key are dropped; ranked by impact per group.

    details: item_id, group columns, impact; columns: item_id, column_name,
    usage ('EQUALITY' | 'INEQUALITY' | 'INCLUDE') and, like selectivity, the
    database_id and object_id of the column's table; selectivity: column_name,
    density (from :func:`column_selectivity`), optionally auto_created. A
    column with several statistics takes the auto-created one first, then
    the lowest density. Ids that only one of columns and selectivity has are
    refused: a bare column name would take another table's density.
    """
    lone = [k for k in ("database_id", "object_id") if (k in columns.columns) != (k in selectivity.columns)]
    if lone:
        raise ValueError(f"only one of columns and selectivity has {lone}")
    group = [g for g in group if g in details.columns]
    on = [k for k in ("database_id", "object_id", "column_name")
          if k in columns.columns and k in selectivity.columns]
    first = F.struct(F.lit(0) if "auto_created" not in selectivity.columns
                     else F.when(F.col("auto_created"), 0).otherwise(1), F.col("density"))
    one = selectivity.groupBy(*on).agg(F.min(first)["density"].alias("density"))
    c = columns.join(one, on, "left")
    key = c.filter(F.col("usage").isin("EQUALITY", "INEQUALITY"))
    key_cols = key.groupBy("item_id").agg(ordered_list(
        "column_name", ["CASE usage WHEN 'EQUALITY' THEN 0 ELSE 1 END", "density", "column_name"], ", ")
        .alias("key_columns"))
    inc = c.filter(F.col("usage") == "INCLUDE").join(
        key.select("item_id", "column_name"), ["item_id", "column_name"], "left_anti")
    inc_cols = inc.groupBy("item_id").agg(ordered_list("column_name", "column_name", ", ").alias("include_columns"))
    out = details.join(key_cols, "item_id", "left").join(inc_cols, "item_id", "left")
    if group:
        # ranks over the distinct impacts of a group (partial aggregation first), joined back
        ranks = details.select(*group, "impact").distinct().withColumn("impact_rank", F.dense_rank().over(
            Window.partitionBy(*group).orderBy(F.col("impact").desc())))
        r = ranks.select(*[F.col(k).alias("__r_" + k) for k in [*group, "impact"]], "impact_rank")
        same = [out[k].eqNullSafe(r["__r_" + k]) for k in [*group, "impact"]]
        out = out.join(r, same, "left").drop(*["__r_" + k for k in [*group, "impact"]])
    return out


# --------------------------------------------------------------------- D12
def plan_maintenance(frag: DataFrame, *, frag_col: str = "avg_fragmentation_in_percent",
                     pages_col: str = "page_count", lob_col: str | None = None,
                     view_no_ansi_col: str | None = None, min_reorg: float = 10.0, min_rebuild: float = 30.0,
                     min_pages: int = 1000, enterprise: bool = False,
                     table_key: list[str] | None = None, partitions: DataFrame | None = None) -> DataFrame:
    """Choose REORGANIZE / REBUILD for fragmented items.

    Candidates: fragmentation above ``min_reorg`` and more than ``min_pages``
    pages (heaps, index_id 0, are skipped when the column is there).
    REORGANIZE when fragmentation is within [min_reorg, min_rebuild], or the
    item holds large objects (``lob_col``), or it is an indexed view created
    without ANSI_NULLS (``view_no_ansi_col``); REBUILD otherwise. A
    reorganize is always online; a rebuild is online only on an edition that
    supports it (``enterprise``). With ``table_key`` the number of all
    partitions of the same index is added (from ``partitions``, one row per
    partition, else from ``frag`` before the candidates are chosen): more
    than one means a rebuild by partition.
    """
    f = F.col(frag_col)
    cand = frag.filter(f.isNotNull() & (f > min_reorg) & (F.col(pages_col) > min_pages))
    if "index_id" in frag.columns:
        cand = cand.filter(F.col("index_id") > 0)
    reorg = f.between(min_reorg, min_rebuild)
    if lob_col:
        reorg = reorg | F.coalesce(F.col(lob_col), F.lit(False))
    if view_no_ansi_col:
        reorg = reorg | F.coalesce(F.col(view_no_ansi_col), F.lit(False))
    out = cand.withColumn("operation", F.when(reorg, F.lit("REORGANIZE")).otherwise(F.lit("REBUILD")))
    out = out.withColumn("online", (F.col("operation") == "REORGANIZE") | F.lit(enterprise))
    if table_key:
        parts = (frag if partitions is None else partitions).groupBy(*table_key).agg(
            F.count(F.lit(1)).alias("n_items_in_table"))
        out = out.join(parts, table_key, "left")
    return out


# --------------------------------------------------------------------- D13
def stale_statistics(stats: DataFrame, *, modified_col: str = "modification_counter",
                     rows_col: str = "rows", rows_threshold: int = 100_000, pct_threshold: float = 10.0,
                     exclude: DataFrame | None = None, exclude_keys: list[str] | None = None,
                     sampled_col: str | None = None, table_rows_col: str | None = None) -> DataFrame:
    """Statistics with modified rows > 0 and at least ``rows_threshold``
    modifications or ``pct_threshold`` percent of the table's rows
    (``table_rows_col``, else the statistic's rows). Percentages (modified,
    sampled against the statistic and against the table) are decimal(19,2),
    0 when the base is 0. ``exclude`` drops statistics listed there (NOT
    EXISTS, e.g. those over large-object or MAX columns)."""
    m = F.col(modified_col)
    base = F.col(table_rows_col or rows_col)
    cond = (m > 0) & ((m >= rows_threshold) | (m.cast("double") * 100.0 >= base.cast("double") * pct_threshold))
    out = stats.filter(cond).withColumn("modified_percent", _pct(m, F.col(rows_col)))
    if sampled_col is not None:
        out = out.withColumn("sampled_percent", _pct(F.col(sampled_col), F.col(rows_col)))
        if table_rows_col is not None:
            out = out.withColumn("sampled_percent_of_table", _pct(F.col(sampled_col), F.col(table_rows_col)))
    if exclude is not None:
        out = out.join(exclude, exclude_keys, "left_anti")
    return out


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio_half_up(part * 100, whole, 2, "decimal(19,2)"), F.lit(0).cast("decimal(19,2)"))


# --------------------------------------------------------------------- D14
def command_log_report(log: DataFrame, kind: str) -> DataFrame:
    """Maintenance command log by kind: duration, and for index commands the
    size and fragmentation read from the XML extended info."""
    kinds = {"backup": ["BACKUP_DATABASE", "BACKUP_LOG"], "check": ["DBCC_CHECKDB"],
             "index": ["ALTER_INDEX"], "statistics": ["UPDATE_STATISTICS"]}
    out = log.filter(F.col("command_type").isin(kinds[kind]))
    secs = F.unix_timestamp(F.col("end_time")) - F.unix_timestamp(F.col("start_time"))
    out = out.withColumn("duration", fmt_seconds(secs))
    if kind == "index":
        # one parse of the <ExtendedInfo> document per row
        info = F.from_xml(F.col("extended_info"), "PageCount BIGINT, Fragmentation DOUBLE")
        out = (out.withColumn("__info", info)
               .withColumn("page_count", F.col("__info.PageCount"))
               .withColumn("fragmentation", F.col("__info.Fragmentation")).drop("__info")
               .withColumn("size_mb", (F.col("page_count") * 8 / 1024.0))
               .withColumn("operation", F.when(F.col("command").contains("REBUILD"), F.lit("REBUILD"))
                           .when(F.col("command").contains("REORGANIZE"), F.lit("REORGANIZE"))))
    elif kind == "statistics":
        info = F.from_xml(F.col("extended_info"), "RowCount BIGINT, ModificationCounter BIGINT")
        out = (out.withColumn("__info", info)
               .withColumn("row_count", F.col("__info.RowCount"))
               .withColumn("modification_counter", F.col("__info.ModificationCounter")).drop("__info")
               .withColumn("modification_percent",
                           ratio_half_up(F.col("modification_counter") * 100, F.col("row_count"), 2, "decimal(15,2)")))
    return out


# --------------------------------------------------------------------- D10
def describe_items(kinds: dict[str, DataFrame], index_columns: DataFrame, sizes: DataFrame | None = None,
                   usage: DataFrame | None = None, frag: DataFrame | None = None,
                   key: list[str] = ("object_id", "index_id")) -> DataFrame:
    """One list of all index kinds (rowstore, XML, spatial, full-text...).

    ``kinds``: {kind: df with key columns, name and option columns}; each is
    tagged and unioned by name. Per index the ordered key column list and
    the included column list (bounded by the index's columns), size in MB
    from pages, usage and fragmentation are left-joined, each pre-aggregated
    to one row per index.
    """
    key = list(key)
    parts = [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p, allowMissingColumns=True)
    cols = index_columns.groupBy(*key).agg(
        ordered_list("CASE WHEN NOT is_included THEN column_name || CASE WHEN is_descending THEN ' DESC' ELSE '' END END",
                     ["key_ordinal", "column_name"], ", ").alias("key_columns"),
        ordered_list("CASE WHEN is_included THEN column_name END", ["column_name"], ", ").alias("included_columns"))
    out = items.join(cols, key, "left")
    if sizes is not None:
        s = sizes.groupBy(*key).agg((F.sum("used_pages") * 8 / 1024.0).alias("size_mb"))
        out = out.join(s, key, "left")
    if usage is not None:
        u = usage.groupBy(*key).agg(F.sum("user_seeks").alias("user_seeks"), F.sum("user_scans").alias("user_scans"),
                                    F.sum("user_lookups").alias("user_lookups"),
                                    F.sum("user_updates").alias("user_updates"))
        out = out.join(u, key, "left")
    if frag is not None:
        fr = frag.groupBy(*key).agg(F.max("avg_fragmentation_in_percent").alias("fragmentation"))
        out = out.join(fr, key, "left")
    return out


# --------------------------------------------------------------------- D11
# Allocation unit types of table storage.
ALLOC_TYPES = ["IN_ROW_DATA", "LOB_DATA", "ROW_OVERFLOW_DATA"]


def describe_tables(partitions: DataFrame, usage: DataFrame | None = None, key: str = "object_id") -> DataFrame:
    """Per table: rows, total/used/data/index/unused MB and total MB per
    allocation type (conditional sums = static pivot), and from usage the
    last read (greatest of last seek, scan and lookup) and the reads (sum of
    seeks, scans and lookups)."""
    mb = lambda c: (F.sum(c) * 8 / 1024.0)
    aggs = [F.sum(F.when(F.col("index_id") < 2, F.col("rows"))).alias("rows"),
            mb("total_pages").alias("total_mb"), mb("used_pages").alias("used_mb"),
            mb("data_pages").alias("data_mb"),
            (F.greatest(F.sum("used_pages") - F.sum("data_pages"), F.lit(0)) * 8 / 1024.0).alias("index_mb"),
            (F.greatest(F.sum("total_pages") - F.sum("used_pages"), F.lit(0)) * 8 / 1024.0).alias("unused_mb")]
    for t in ALLOC_TYPES:
        aggs.append((F.coalesce(F.sum(F.when(F.col("type_desc") == t, F.col("total_pages"))), F.lit(0)) * 8 / 1024.0)
                    .alias(t.lower() + "_mb"))
    out = partitions.groupBy(key).agg(*aggs)
    if usage is not None:
        u = usage.groupBy(key).agg(
            F.greatest(F.max("last_user_seek"), F.max("last_user_scan"), F.max("last_user_lookup")).alias("last_read"),
            (F.coalesce(F.sum("user_seeks"), F.lit(0)) + F.coalesce(F.sum("user_scans"), F.lit(0))
             + F.coalesce(F.sum("user_lookups"), F.lit(0))).alias("reads"))
        out = out.join(u, key, "left")
    return out


def describe_columns(columns: DataFrame, index_columns: DataFrame | None = None,
                     key: list[str] = ("object_id", "column_name")) -> DataFrame:
    """Per column: its attributes plus the indexes that use it (distinct,
    ordered; bounded by the table's indexes)."""
    key = list(key)
    out = columns
    if index_columns is not None:
        ix = index_columns.groupBy(*key).agg(
            ordered_list("index_name", "index_name", ", ", distinct=True).alias("used_by_indexes"))
        out = out.join(ix, key, "left")
    return out
