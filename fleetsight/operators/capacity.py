"""Capacity, counters and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.functions.aggregates import exact_mean
from fleetsight.functions.calendar import WORK_END_HOUR, WORK_START_HOUR, sql_week_of_year
from fleetsight.functions.scalar import code_text, fmt_seconds, int_div, ratio_half_up
from fleetsight.plans.strategies import previous_in_order, time_bucket

# Disk alarm thresholds (percent free) and texts.
DISK_ALARM_PCT, DISK_WARNING_PCT = 10, 20
DISK_ALARM_TEXT, DISK_WARNING_TEXT = "Alarm!!!", "Warning!!!"
# Full-text population status codes.
POPULATE_STATUS = {0: "Idle", 1: "Full population in progress", 2: "Paused", 3: "Throttled",
                   4: "Recovering", 5: "Shutdown", 6: "Incremental population in progress",
                   7: "Building index", 8: "Disk is full. Paused.", 9: "Change tracking"}
# Allocation types pivoted by size_by_type, and the grand-total label.
SIZE_TYPES = ["ROWS", "LOG", "FILESTREAM", "FULLTEXT"]
TOTAL_LABEL = "***Total***"


# ------------------------------------------------------------------ C2
def sample_period(df: DataFrame, entity: list[str], ts: str, period: str, tiebreak: list[str] = ()) -> DataFrame:
    """'day': every row. 'month'/'year': first row of each month/year per
    entity plus the entity's very last row.

    Built from min_by/max_by aggregates (partial aggregation, so a hot entity
    is combined map-side) instead of row_number windows over the entity.
    """
    if period == "day":
        return df
    if period not in ("month", "year"):
        raise ValueError("period must be day, month or year")
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    row = F.struct(*[F.col(c) for c in df.columns])
    buckets = [F.year(ts).alias("__y")] + ([F.month(ts).alias("__m")] if period == "month" else [])
    firsts = df.groupBy(*entity, *buckets).agg(F.min_by(row, order).alias("__r")).select("__r.*")
    lasts = df.groupBy(*entity).agg(F.max_by(row, order).alias("__r")).select("__r.*")
    return firsts.unionByName(lasts).distinct()


# ------------------------------------------------------------------ C1
def growth_report(df: DataFrame, entity: list[str], ts: str, measures: list[str], period: str = "day",
                  tiebreak: list[str] = (), date_from=None, date_to=None,
                  current: DataFrame | None = None, include_deleted: bool = True) -> DataFrame:
    """Each measure minus the previous sampled row's (0 only where there is no
    previous row: the first row shows its full size), per entity in time
    order. Rows whose measures are all NULL are no samples.

    Partitioned by the full entity key and ordered by time (see SURVEY 7.4).
    With ``include_deleted=False`` only entities present in ``current`` stay.
    For 'day' the previous row comes from :func:`previous_in_order` (hour
    buckets, so a hot entity is spread over many tasks); sampled periods have
    one row per entity and month at most, so a plain window suffices.
    """
    d = df
    if date_from is not None:
        d = d.filter(F.col(ts) >= F.lit(date_from))
    if date_to is not None:
        d = d.filter(F.col(ts) <= F.lit(date_to))
    if not include_deleted and current is not None:
        d = d.join(current.select(*entity).distinct(), entity, "left_semi")
    d = d.filter(F.coalesce(*[F.col(m).cast("string") for m in measures]).isNotNull())
    d = sample_period(d, entity, ts, period, tiebreak).withColumn("__one", F.lit(1))
    order = [ts, *tiebreak]
    if period == "day":
        d = previous_in_order(d, entity, order, [*measures, "__one"], time_bucket(ts), prefix="__prev_")
    else:
        w = Window.partitionBy(*entity).orderBy(*order)
        for m in [*measures, "__one"]:
            d = d.withColumn("__prev_" + m, F.lag(m).over(w))
    for m in measures:
        prev = F.when(F.col("__prev___one").isNull(), F.lit(0).cast(d.schema[m].dataType)).otherwise(F.col("__prev_" + m))
        d = d.withColumn(m + "_growth", F.col(m) - prev).drop("__prev_" + m)
    return d.drop("__one", "__prev___one").withColumn("data_collection_date", F.date_format(ts, "dd/MM/yyyy"))


# ------------------------------------------------------------------ C3
def disk_alarm(df: DataFrame, free: str, size: str) -> DataFrame:
    """Free percent as decimal(4,1) and the alarm text."""
    pct = (F.col(free).cast("decimal(20,4)") * 100 / F.nullif(F.col(size).cast("decimal(20,4)"), F.lit(0)))
    out = df.withColumn("free_pct", ratio_half_up(F.col(free) * 100, F.col(size), 1, "decimal(4,1)"))
    return out.withColumn("alarm", F.when(pct < DISK_ALARM_PCT, F.lit(DISK_ALARM_TEXT))
                          .when(pct < DISK_WARNING_PCT, F.lit(DISK_WARNING_TEXT)).otherwise(F.lit("")))


# ------------------------------------------------------------------ C4
def size_by_type(df: DataFrame, entity: str, type_col: str, size: str, used: str,
                 types: list[str] = SIZE_TYPES) -> DataFrame:
    """Size per allocation type as columns, per entity, with a grand total row
    labelled ***Total*** (rollup). ``used`` is the allocated space of the data
    (ROWS) files: free = data size - used, free percent of the data size
    (whole percent), total = the sum over all types."""
    aggs = [F.coalesce(F.sum(F.when(F.col(type_col) == t, F.col(size))), F.lit(0)).alias(t.lower() + "_size")
            for t in types]
    aggs += [F.sum(size).alias("total_size"),
             F.coalesce(F.sum(F.when(F.col(type_col) == types[0], F.col(used))), F.lit(0)).alias("used_size"),
             F.grouping(entity).alias("__g")]
    out = df.rollup(entity).agg(*aggs)
    data = types[0].lower() + "_size"
    out = out.withColumn("free_size", F.col(data) - F.col("used_size"))
    out = out.withColumn("free_percent", ratio_half_up(F.col("free_size") * 100, F.col(data), 0, "decimal(10,0)"))
    return out.withColumn(entity, F.when(F.col("__g") == 1, F.lit(TOTAL_LABEL))
                          .otherwise(F.col(entity).cast("string"))).drop("__g")


# ------------------------------------------------------------------ C5
# Internal table types whose pages count as index, not data
# (XML and full-text index internals).
INDEX_INTERNAL_TYPES = [202, 204, 211, 212, 213, 214, 215, 216]


def space_used(units: DataFrame, keys: list[str], files: DataFrame | None = None, *,
               index_id: str = "index_id", unit_type: str = "type", internal_type: str = "internal_type",
               total: str = "total_pages", used: str = "used_pages", data: str = "data_pages",
               page_kb: int = 8) -> DataFrame:
    """Space report per database from allocation units (and files).

    reserved = total pages; data = data pages of heaps and clustered indexes
    plus used pages of LOB/overflow units, except internal XML/full-text
    tables (counted as index); index = used - data; unused = reserved - used.
    With ``files`` (keys, size pages, is_log) also database size, log size and
    unallocated space (data file pages not reserved; never negative). All in
    KB; conditional sums in one aggregation per input.
    """
    it = F.col(internal_type) if internal_type in units.columns else F.lit(None)
    pages = (F.when(it.isin(INDEX_INTERNAL_TYPES), F.lit(0))
              .when(F.col(unit_type) != 1, F.col(used))
              .when(F.col(index_id) < 2, F.col(data)).otherwise(F.lit(0)))
    agg = units.groupBy(*keys).agg(F.sum(total).alias("__res"), F.sum(used).alias("__used"),
                                   F.sum(pages).alias("__data"))
    kb = F.lit(page_kb)
    out = agg.select(
        *keys, (F.col("__res") * kb).alias("reserved_kb"), (F.col("__data") * kb).alias("data_kb"),
        ((F.col("__used") - F.col("__data")) * kb).alias("index_kb"), (F.col("__used") * kb).alias("used_kb"),
        ((F.col("__res") - F.col("__used")) * kb).alias("unused_kb"), "__res")
    if files is not None:
        f = files.groupBy(*keys).agg(
            F.sum(F.when(~F.col("is_log"), F.col("size")).otherwise(F.lit(0))).alias("__db"),
            F.sum(F.when(F.col("is_log"), F.col("size")).otherwise(F.lit(0))).alias("__log"))
        out = out.join(f, keys, "left").select(
            "*", ((F.col("__db") + F.col("__log")) * kb).alias("database_size_kb"),
            (F.col("__log") * kb).alias("log_kb"),
            (F.greatest(F.col("__db") - F.col("__res"), F.lit(0)) * kb).alias("unallocated_kb")).drop("__db", "__log")
    return out.drop("__res")


# ------------------------------------------------------------------ C7
def _readings(data: DataFrame, details: DataFrame, name_filter: str | None) -> DataFrame:
    """Readings with machine, time and counter name.

    Name = "Object\\Counter" plus " (Instance)" when there is one; the leading
    backslashes of the machine are stripped; the first 23 characters of the
    time text become a timestamp with milliseconds."""
    d = details.select(
        "counter_id", F.regexp_replace("machine_name", r"^\\+", "").alias("machine_name"),
        F.concat(F.col("object_name"), F.lit("\\"), F.col("counter_name"),
                 F.when(F.col("instance_name").isNotNull() & (F.col("instance_name") != ""),
                        F.concat(F.lit(" ("), F.col("instance_name"), F.lit(")"))).otherwise(F.lit("")))
        .alias("counter"))
    if name_filter:
        d = d.filter(F.col("counter").ilike(name_filter))
    ts = F.to_timestamp_ntz(F.substring("counter_date_time", 1, 23), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return data.join(d, "counter_id").withColumn("counter_ts", ts)


def _with_date_time(df: DataFrame) -> DataFrame:
    return df.withColumn("counter_date", F.to_date("counter_ts")) \
             .withColumn("counter_time", F.date_format("counter_ts", "HH:mm:ss.SSS"))


def counter_readings(data: DataFrame, details: DataFrame, name_filter: str | None = None) -> DataFrame:
    """Counter readings in long form, summed per (machine, time, counter): any
    number of counters and instances."""
    return _with_date_time(_readings(data, details, name_filter).groupBy("machine_name", "counter_ts", "counter").agg(
        F.sum("counter_value").alias("counter_value")))


def pivot_counters(data: DataFrame, details: DataFrame, names: list[str], name_filter: str | None = None) -> DataFrame:
    """Counter readings joined to their definitions and pivoted wide, one
    column per name of ``names`` (the counters wanted; :func:`counter_readings`
    gives all of them as rows). Values are summed per (machine, time, counter)
    as conditional sums: one aggregation, partial map-side."""
    j = _readings(data, details, name_filter)
    return _with_date_time(j.groupBy("machine_name", "counter_ts").agg(
        *[F.sum(F.when(F.col("counter") == n, F.col("counter_value"))).alias(n) for n in names]))


# ------------------------------------------------------------------ C8
def time_parts(ts: Column) -> dict[str, Column]:
    """The ten calendar/clock parts a roll-up may group by (same definitions
    as the calendar and clock dimensions of B5)."""
    h = F.hour(ts)
    return {
        "year": F.year(ts), "quarter": F.quarter(ts), "month": F.month(ts),
        "week": sql_week_of_year(F.to_date(ts)), "day": F.to_date(ts), "day_of_month": F.dayofmonth(ts),
        "day_of_week": F.dayofweek(ts), "am_pm": F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM")),
        "hour": h, "minute": F.date_format(ts, "HH:mm"),
    }


def calendar_rollup(df: DataFrame, ts: str, measures: list[str], by: list[str], *,
                    date_from=None, date_to=None, working_hours: bool | None = None,
                    weekend: bool | None = None, min_measures: list[str] = (),
                    sum_groups: dict[str, list[str]] | None = None,
                    extra_keys: list[str] = ()) -> DataFrame:
    """Mean and max (min for ``min_measures``) of counters grouped by any
    combination of calendar parts; raw rows when ``by`` is empty.

    Parts are computed from the timestamp with native date functions, which
    equals joining the calendar and clock dimensions without the join.
    ``sum_groups`` first sums several counters per row into one (e.g. all
    instances of a counter). Means are exact decimal sums / counts.
    """
    d = df
    t = F.col(ts)
    if date_from is not None:
        d = d.filter(t >= F.lit(date_from))
    if date_to is not None:
        d = d.filter(t <= F.lit(date_to))
    h = F.hour(t)
    if working_hours is not None:
        wh = (h >= WORK_START_HOUR) & (h < WORK_END_HOUR)
        d = d.filter(wh if working_hours else ~wh)
    if weekend is not None:
        we = F.dayofweek(t).isin(1, 7)
        d = d.filter(we if weekend else ~we)
    ms = list(measures)
    for name, cols in (sum_groups or {}).items():
        d = d.withColumn(name, sum((F.col(c) for c in cols[1:]), F.col(cols[0])))
        ms.append(name)
    parts = time_parts(t)
    if not by:
        return d.select(*extra_keys, t.alias(ts), *ms)
    keys = [parts[b].alias(b) for b in by]
    aggs = []
    for m in ms:
        aggs.append(exact_mean(m).alias("avg_" + m))
        aggs.append((F.min(m) if m in min_measures else F.max(m)).alias(("min_" if m in min_measures else "max_") + m))
    return d.groupBy(*extra_keys, *keys).agg(*aggs, F.count(F.lit(1)).alias("n_readings"))


# ------------------------------------------------------------------ C9
def counter_increment(last: Column, reading: Column) -> Column:
    """Increment of a cumulative counter: the reading itself after a reset
    (reading lower than the last one), else the difference. Callers read a
    NULL reading as 0."""
    return F.when(last.isNull(), reading).when(last > reading, reading).otherwise(reading - last)


def _zero(df: DataFrame, c: str) -> Column:
    """A NULL reading counts as 0 (the server reports no activity)."""
    return F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))


def accumulate_counters(state: DataFrame, reading: DataFrame, keys: list[str], counters: list[str],
                        now=None) -> DataFrame:
    """State form: merge one snapshot of readings (one row per key) into the
    counter state (keys, <c>, total_<c>). New keys start at the reading; keys
    not in the snapshot keep their state."""
    s = state.select(*keys, *[F.col(c).alias("s__" + c) for c in counters],
                     *[F.col("total_" + c).alias("s__total_" + c) for c in counters])
    r = reading.select(*keys, *[_zero(reading, c).alias("r__" + c) for c in counters], F.lit(True).alias("__seen"))
    j = s.join(r, keys, "full_outer")
    cols = list(keys)
    for c in counters:
        last, new = F.col("s__" + c), F.col("r__" + c)
        inc = counter_increment(last, new)
        cols.append(F.when(F.col("__seen"), new).otherwise(last).alias(c))
        cols.append(F.when(F.col("__seen"), F.coalesce(F.col("s__total_" + c), F.lit(0)) + inc)
                    .otherwise(F.col("s__total_" + c)).alias("total_" + c))
    out = j.select(*cols)
    if now is not None:
        out = out.withColumn("modified_date", F.lit(now))
    return out


def accumulate_log(log: DataFrame, keys: list[str], ts: str, counters: list[str],
                   tiebreak: list[str] = ()) -> DataFrame:
    """Ordered-sequence form: the same totals computed over a whole reading
    log. The previous reading comes from :func:`previous_in_order` (hour
    buckets split a hot key), then totals are a partial-aggregated sum."""
    order = [ts, *tiebreak]
    d = previous_in_order(log.select(*keys, *order, *[_zero(log, c).alias(c) for c in counters]), keys, order, counters,
                          time_bucket(ts), prefix="__prev_", keep_bucket_last=True)
    aggs = []
    for c in counters:
        inc = counter_increment(F.col("__prev_" + c), F.col(c))
        aggs.append(F.sum(inc).alias("total_" + c))
        aggs.append(F.count(F.when(F.col("__prev_" + c) > F.col(c), 1)).alias("resets_" + c))
        # the last reading is the last row of the key's latest bucket
        aggs.append(F.max_by(F.col("__last_" + c), F.col("__bucket")).alias(c))
    out = d.groupBy(*keys).agg(*aggs, F.max(ts).alias("last_reading_time"))
    return out.select(*keys, *counters, *[x for c in counters for x in ("total_" + c, "resets_" + c)],
                      "last_reading_time")


# ------------------------------------------------------------------ C10
def share_of_total(df: DataFrame, group: list[str], bytes_read: str, size_bytes: str, boot_ms: int,
                   exclude: Column | None = None, n: int | None = None) -> DataFrame:
    """Read volume per group in MB/GB/TB, per hour since start, as a multiple
    of the size on disk, and as a percent of the grand total. ``n``: only the
    n groups that read most (ties by group), from a distributed sort of the
    groups; the percentages stay those of the whole."""
    d = df.filter(~exclude) if exclude is not None else df
    agg = d.groupBy(*group).agg(F.sum(bytes_read).alias("__read"), F.sum(size_bytes).alias("__size"))
    # grand total as a scalar subquery: computed once, used as a constant
    total = d.agg(F.sum(bytes_read)).scalar()
    if n is not None:
        agg = agg.orderBy(F.col("__read").desc_nulls_last(), *group).limit(n)
    hours = boot_ms / 1000.0 / 3600.0
    r = F.col("__read").cast("double")
    out = agg.withColumn("__total", total).select(
        *group, (r / 1024 / 1024).alias("mb_read"), (r / 1024 / 1024 / 1024).alias("gb_read"),
        (r / 1024 / 1024 / 1024 / 1024).alias("tb_read"),
        (F.col("__size").cast("double") / 1024 / 1024).alias("size_on_disk_mb"),
        (r / F.lit(hours) / 1024 / 1024 / 1024).alias("gb_read_hour"),
        (r / F.lit(hours) / F.nullif(F.col("__size").cast("double"), F.lit(0.0))).alias("ratio_read_hour"),
        (r * 100 / F.nullif(F.col("__total").cast("double"), F.lit(0.0))).alias("percentage_reads"))
    return out


# ------------------------------------------------------------------ C11
def execution_rate(df: DataFrame, first: str, last: str, count: str, totals: dict[str, str]) -> DataFrame:
    """Mean gap between executions as d.hh:mm:ss.mmm, and each total per execution."""
    secs = F.unix_timestamp(F.col(last)) - F.unix_timestamp(F.col(first))
    gap = secs.cast("double") / F.nullif(F.col(count), F.lit(0))
    ms = F.lpad((((gap - F.floor(gap)) * 1000).cast("int")).cast("string"), 3, "0")
    out = df.withColumn("executes_every", F.concat(fmt_seconds(int_div(secs, F.col(count))), F.lit("."), ms))
    out = out.withColumn("gap_seconds", gap)
    for name, c in totals.items():
        out = out.withColumn("avg_" + name, int_div(F.col(c), F.col(count)))
    return out


# ------------------------------------------------------------------ C12
def running_report(requests: DataFrame, texts: DataFrame, now, *, session_filter: Column | None = None) -> DataFrame:
    """Running requests: elapsed time, extrapolated end (start + elapsed *
    100 / percent complete, whole seconds), the running statement cut from
    the batch text by its byte offsets (UTF-16: two bytes per character, end
    -1 = to the end) and the blocking session's statement (self left join).

    requests: session_id, start_time, percent_complete, statement_start_offset,
    statement_end_offset, blocking_session_id, sql_handle; texts: sql_handle, text.
    """
    r = requests.join(texts, "sql_handle", "left")
    now_col = now if isinstance(now, Column) else F.lit(now)
    elapsed = F.unix_timestamp(now_col) - F.unix_timestamp(F.col("start_time"))
    start = int_div(F.col("statement_start_offset"), 2) + 1
    length = F.when(F.col("statement_end_offset") == -1, F.length("text") + 1) \
        .otherwise(int_div(F.col("statement_end_offset") - F.col("statement_start_offset"), 2) + 1)
    r = (r.withColumn("elapsed", fmt_seconds(elapsed))
          .withColumn("statement", F.substring(F.col("text"), start.cast("int"), length.cast("int")))
          .withColumn("estimated_end", F.when(F.col("percent_complete") > 0, F.timestamp_add(
              "SECOND", int_div(elapsed * 100, F.col("percent_complete")), F.col("start_time")))))
    # blockers come from all requests, also from those that the filter leaves out
    blockers = r.select(F.col("session_id").alias("__bs"), F.col("statement").alias("blocking_statement"))
    if session_filter is not None:
        r = r.filter(session_filter)
    return r.join(blockers, r["blocking_session_id"] == blockers["__bs"], "left").drop("__bs")


def running_sessions(report: DataFrame, sessions: DataFrame, *, own: int | None = None, login: str | None = None,
                     session: int | None = None, n: int | None = None) -> DataFrame:
    """The rows of :func:`running_report` with what is known of their sessions,
    user sessions only (``is_user_process``); a request without a session row
    is left out.

    ``own`` leaves the asking session out; ``login`` keeps one login's
    sessions, without regard to case. ``session`` keeps that session and those
    it blocks; a negative number keeps all but the session of that number.
    ``n``: the n requests that started first (ties by session), picked per
    partition before they meet. Session columns that the report has too are
    the report's.
    """
    keep = F.col("is_user_process").cast("boolean")
    if own is not None:
        keep = keep & (F.col("session_id") != own)
    if login is not None:
        keep = keep & (F.lower("login_name") == login.lower())
    more = [c for c in sessions.columns if c == "session_id" or c not in report.columns]
    # what depends on the session alone is filtered before the join
    out = report.join(sessions.filter(keep).select(*more).drop("is_user_process"), "session_id")
    if session is not None:
        wanted = (F.col("session_id") == session) | F.coalesce(F.col("blocking_session_id") == session, F.lit(False))
        if session < 0:
            wanted = wanted | (F.col("session_id") != -session)
        out = out.filter(wanted)
    return out if n is None else out.orderBy("start_time", "session_id").limit(n)


# ------------------------------------------------------------------ C13
def reclaim_candidates(df: DataFrame, key: list[str], data_mb: str, log_mb: str, log_used_pct: str,
                       min_size: float = 1000.0, max_used_pct: float = 50.0, floor_mb: float = 500.0) -> DataFrame:
    """Entities whose log is over ``min_size`` and under ``max_used_pct`` used;
    target = min(log * 0.5, data * 0.2) but at least ``floor_mb``."""
    out = df.filter((F.col(log_mb) > min_size) & (F.col(log_used_pct) < max_used_pct))
    target = F.greatest(F.least(F.col(log_mb) * F.lit(0.5), F.col(data_mb) * F.lit(0.2)), F.lit(floor_mb))
    return out.withColumn("target_mb", target)


# ------------------------------------------------------------------ C14
def exact_stddev(x: str) -> Column:
    """Sample standard deviation from exact decimal moments (order-independent)."""
    n = F.count(x)
    s1 = F.sum(F.col(x).cast("decimal(20,4)"))
    s2 = F.sum((F.col(x).cast("decimal(20,4)") * F.col(x).cast("decimal(20,4)")))
    num = (n.cast("decimal(20,0)") * s2 - s1 * s1)
    return F.when(n > 1, F.sqrt(num.cast("double") / (n * (n - 1)).cast("double")))


def fragment_stats(df: DataFrame, keys: list[str], rows: str, status: str | None = None) -> DataFrame:
    """Sum, count, standard deviation (as INT), max and min of fragment sizes;
    status code to text."""
    out = df.groupBy(*keys).agg(F.sum(rows).alias("total_row_count"), F.count(F.lit(1)).alias("n_fragments"),
                                exact_stddev(rows).cast("int").alias("stdev_row_count"),
                                F.max(rows).alias("max_row_count"), F.min(rows).alias("min_row_count"))
    if status:
        out = out.withColumn("status", code_text(status, POPULATE_STATUS))
    return out


# ------------------------------------------------------------------ C6
def _pages_mb(c: Column) -> Column:
    return (c.cast("decimal(20,0)") * 8 / 1024).cast("decimal(10,2)")


def growth_tier_mb(size_mb: Column) -> Column:
    """Suggested growth step by file size (MB)."""
    return (F.when(size_mb > 10000, F.lit(4000)).when(size_mb > 4000, F.lit(1000))
             .when(size_mb > 1000, F.lit(500)).otherwise(F.lit(100)))


def file_usage(files: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """Per data/log file: size, used and free MB, percent used, growth and cap
    as text, path and file name, the volume of its drive, a shrink target
    (files of 1 GB or more: 1024, 2048, else used rounded up to whole GB)
    and a suggested growth step when the current one is a percent or below
    the tier for its size.

    files: database_id, file_id, logical_name, type_desc, size, space_used,
    growth, is_percent_growth, max_size (pages of 8 KB), physical_name.
    volumes: drive, size_mb, free_mb.
    """
    from fleetsight.functions.scalar import file_dir, file_drive, file_name
    f = files
    size_mb = _pages_mb(F.col("size"))
    used_mb = _pages_mb(F.col("space_used"))
    growth_mb = (F.col("growth") * 8 / 1024).cast("bigint")
    cap = (F.when(F.col("max_size") == 0, F.lit("No")).when(F.col("max_size") == -1, F.lit("Unlimited"))
           .otherwise(F.concat(F.lit("Limited to "), ((F.col("max_size").cast("bigint") * 8) / 1024).cast("bigint")
                               .cast("string"), F.lit(" MB"))))
    grow = F.when(F.col("growth") == 0, F.lit("None")).otherwise(F.concat(
        F.lit("By "), F.when(F.col("is_percent_growth"), F.concat(F.col("growth").cast("string"), F.lit("%")))
        .otherwise(F.concat(growth_mb.cast("string"), F.lit(" MB"))), F.lit(", "), cap))
    size_int = (F.col("size") * 8 / 1024).cast("bigint")
    used_int = (F.col("space_used") * 8 / 1024).cast("bigint")
    shrink = (F.when(size_int < 1024, F.lit(None).cast("bigint")).when(used_int < 1024, F.lit(1024))
              .when(used_int < 2048, F.lit(2048))
              .otherwise(F.ceil(F.col("space_used") * 8 / 1024 / 1024).cast("bigint") * 1024))
    size_d = F.col("size").cast("double") * 8 / 1024
    tier = growth_tier_mb(size_d)
    out = f.select(
        "*", size_mb.alias("size_mb"), used_mb.alias("used_mb"), (size_mb - used_mb).alias("free_mb"),
        ratio_half_up(F.col("space_used") * 100, F.col("size"), 2, "decimal(10,2)").alias("percentage_used"),
        grow.alias("autogrowth_maxsize"), file_dir("physical_name").alias("path"),
        file_name("physical_name").alias("file_name"), file_drive("physical_name").alias("drive"),
        shrink.alias("shrink_target_mb"),
        F.when(F.col("is_percent_growth") | (growth_mb < tier), tier).alias("suggested_growth_mb"))
    if volumes is not None:
        v = volumes.select(file_drive(F.col("drive")).alias("__drive"),
                           (F.col("size_mb") / 1024).cast("decimal(10,2)").alias("drive_size_gb"),
                           (F.col("free_mb") / 1024).cast("decimal(10,2)").alias("drive_free_gb"),
                           (F.col("free_mb") * 100 / F.nullif(F.col("size_mb"), F.lit(0))).cast("bigint").alias("drive_free_percent"))
        out = out.join(v, out["drive"] == v["__drive"], "left").drop("__drive")
    return out


def one_file_per_drive(files: DataFrame) -> DataFrame:
    """One file per drive: the smallest (database_id, file_id) on it."""
    from fleetsight.functions.scalar import file_drive
    row = F.struct(*[F.col(c) for c in files.columns])
    return files.groupBy(file_drive("physical_name").alias("drive")).agg(
        F.min_by(row, F.struct("database_id", "file_id")).alias("__r")).select("drive", "__r.*")
