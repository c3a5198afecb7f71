"""Backup and job compliance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.aggregates import ordered_list
from fleetsight.functions.scalar import code_text, fmt_hhmmss, fmt_seconds, ratio_half_up, text_date_time
from fleetsight.operators.reference import WEEKDAY_BITS, bitmask_names
from fleetsight.plans.strategies import asof_forward, top_n_per_group

# Backup type codes and their texts.
BACKUP_TYPES = {"D": "Database", "I": "Differential database", "L": "Log", "F": "File or filegroup",
                "G": "Differential file", "P": "Partial", "Q": "Differential partial"}
# File extensions that count as backups, and the full-backup one.
BACKUP_EXTENSIONS = [".bak", ".trn", ".diff"]
FULL_EXTENSION = ".bak"
# Job run status codes.
RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In Progress"}


def backup_type_text(c: Column) -> Column:
    return code_text(c, BACKUP_TYPES)


def _backup_measures(df: DataFrame, start: str, finish: str, size: str, compressed: str) -> DataFrame:
    # unix_timestamp truncates to whole seconds: counts second boundaries,
    # and on TIMESTAMP_NTZ it does not depend on the session time zone
    secs = F.unix_timestamp(F.col(finish)) - F.unix_timestamp(F.col(start))
    size_d, comp_d = F.col(size).cast("double"), F.col(compressed).cast("double")
    gb = F.lit(1073741824)
    out = df
    if "has_backup_checksums" in df.columns:
        out = out.withColumn("has_backup_checksums", F.when(F.col("has_backup_checksums"), F.lit("Yes"))
                             .otherwise(F.lit("No")))
    return (out.withColumn("size_mb", (F.col(size) / 1048576).cast("bigint"))
              .withColumn("compressed_size_mb", (F.col(compressed) / 1048576).cast("bigint"))
              .withColumn("size_gb", ratio_half_up(F.col(size), gb, 2, "decimal(10,2)"))
              .withColumn("compressed_size_gb", ratio_half_up(F.col(compressed), gb, 2, "decimal(10,2)"))
              .withColumn("compression_pct", F.lit(100.0) - comp_d * 100 / F.nullif(size_d, F.lit(0.0)))
              .withColumn("mb_per_sec", comp_d / 1048576 / F.nullif((secs + 1).cast("double"), F.lit(0.0)))
              .withColumn("duration", fmt_seconds(secs)))


# --------------------------------------------------------------------- E1
def last_n_backups(sets: DataFrame, media: DataFrame | None, n: int, *, key: list[str], type_col: str = "type",
                   backup_type: str | None = "X", order: str = "backup_set_id", tiebreak: str = "backup_set_id",
                   start: str = "backup_start_date", finish: str = "backup_finish_date",
                   size: str = "backup_size", compressed: str = "compressed_backup_size",
                   entities: DataFrame | None = None) -> DataFrame:
    """Last ``n`` backups per entity (newest set id first; 'X' = every type but
    log, None = every type), with sizes in MB and GB, compression, throughput (+1 s), duration,
    checksum flag and the device list of each set in family order. With
    ``entities``, entities without any backup are kept with '-'."""
    s = sets
    if backup_type is not None:
        s = sets.filter(F.col(type_col) != "L") if backup_type == "X" else sets.filter(F.col(type_col) == backup_type)
    top = top_n_per_group(s, key, [F.col(order).desc(), F.col(tiebreak).desc()], n, rank_col="backup_rank")
    top = _backup_measures(top, start, finish, size, compressed).withColumn("backup_type", backup_type_text(F.col(type_col)))
    if media is not None:
        # media of the chosen sets only, grouped by their one narrow key, back to the sets one to one; the device
        # list of a set is bounded by its media families
        chosen = top.select("media_set_id").distinct()
        m = media.select("media_set_id", "physical_device_name", "family_sequence_number").join(
            chosen, "media_set_id", "left_semi").groupBy("media_set_id").agg(
            ordered_list("physical_device_name", ["family_sequence_number", "physical_device_name"], ", ").alias("devices"))
        top = top.join(m, "media_set_id", "left")
    if entities is not None:
        out = entities.join(top, key, "left")
        return out.withColumn("backup_type", F.coalesce("backup_type", F.lit("-")))
    return top


# --------------------------------------------------------------------- E2
def schedule_compliance(entities: DataFrame, events: DataFrame, *, key: str, schedule: str, today,
                        days: int, event_key: str, event_ts: str, event_type: str,
                        types: list[str] = ("D", "I"), finish: str | None = None, size: str | None = None,
                        compressed: str | None = None) -> DataFrame:
    """Date spine (today - days ... yesterday) per entity with the planned type
    (the schedule character at the weekday, Sunday = 1) left-joined to the
    backups that started that day.

    Each entity row is expanded to its ``days`` dates with ``sequence`` +
    ``explode`` (a narrow projection: no join, no shuffle); the result is the
    report itself, one row per entity and day. With ``finish``, ``size`` and
    ``compressed`` each backup shows the sizes, compression, throughput,
    duration and checksum flag of E1.
    """
    today_col = F.to_date(today if isinstance(today, Column) else F.lit(today))
    grid = entities.select(key, schedule, F.explode(
        F.sequence(F.date_sub(today_col, days), F.date_sub(today_col, 1))).alias("date"))
    grid = grid.withColumn("scheduled_type", F.substring(F.col(schedule), F.dayofweek("date"), 1))
    ev = events.filter(F.col(event_type).isin(list(types))) \
        .filter((F.col(event_ts) >= F.date_sub(today_col, days).cast("timestamp_ntz"))
                & (F.col(event_ts) < today_col.cast("timestamp_ntz")))
    ev = ev.withColumn("__d", F.to_date(event_ts)).withColumn("backup_type", backup_type_text(F.col(event_type)))
    if finish and size and compressed:
        ev = _backup_measures(ev, event_ts, finish, size, compressed)
    j = grid.join(ev, (grid[key] == ev[event_key]) & (grid["date"] == ev["__d"]), "left")
    return j.drop("__d")


# --------------------------------------------------------------------- E3
def due_today(entities: DataFrame, *, schedule: str, weekday: int, wanted: list[str] | None = None,
              batch_col: str | None = None, batch: int | None = None, names: list[str] | None = None,
              name_col: str = "name", size_col: str | None = None, big_size: float | None = None,
              week_of_year: int | None = None) -> DataFrame:
    """Entities due on ``weekday`` (Sunday = 1): the schedule character is one
    of ``wanted`` (or anything but '-') and the batch matches (NULL = 0, on
    either side).
    Explicit ``names`` override the schedule. Entities over ``big_size`` get
    the light check except in every fourth week."""
    ch = F.substring(F.col(schedule), weekday, 1)
    due = ch.isin(wanted) if wanted else (ch != "-")
    if batch_col is not None:
        due = due & (F.coalesce(F.col(batch_col), F.lit(0)) == (batch or 0))
    if names:
        due = F.col(name_col).isin(names)
    out = entities.filter(due).withColumn("scheduled_type", ch)
    if size_col and big_size is not None and week_of_year is not None:
        light = (F.col(size_col) > big_size) & F.lit(week_of_year % 4 != 0)
        out = out.withColumn("check_type", F.when(light, F.lit("PHYSICAL_ONLY")).otherwise(F.lit("FULL")))
    return out


# --------------------------------------------------------------------- E4
def retention_expired(files: DataFrame, *, key: list[str], file_id: str, file_name: str,
                      prefix: Column, keep_n: int) -> DataFrame:
    """Backup files that expire when the newest ``keep_n`` full-backup groups
    are kept.

    Full backups are grouped by ``prefix`` (multi-part sets share one), the
    groups ranked newest first per entity; files older than the first id of
    the ``keep_n``-th group expire. Entities with fewer groups expire
    nothing; files without a backup extension are ignored. Computed per
    entity (top-n with a partial group limit, then a one-row-per-entity join).
    """
    name = F.col(file_name)
    is_backup = reduce(lambda a, b: a | b, [name.endswith(e) for e in BACKUP_EXTENSIONS])
    groups = (files.filter(name.endswith(FULL_EXTENSION)).groupBy(*key, prefix.alias("__prefix"))
              .agg(F.min(file_id).alias("__min_id")))
    ranked = top_n_per_group(groups, key, [F.col("__min_id").desc()], keep_n, rank_col="__rank")
    limit = ranked.filter(F.col("__rank") == keep_n).select(*key, F.col("__min_id").alias("min_id_to_keep"))
    return files.filter(is_backup).join(limit, key, "inner").filter(F.col(file_id) < F.col("min_id_to_keep"))


# --------------------------------------------------------------------- E5
def restore_chain(backups: DataFrame, *, key: list[str], target, ts: str = "backup_start_date",
                  type_col: str = "type", copy_only: str = "is_copy_only", set_id: str = "backup_set_id",
                  part: str | None = None) -> DataFrame:
    """Backups needed to restore each entity to ``target``: the latest full
    backup (not copy-only) at or before it, the latest differential after
    that, then the logs after the differential (or the full) up to the
    target. Rows of a chosen set are all kept (multi-part), with a step
    number (1 full, 2 differential, 3 log) and the part order.

    Each boundary is a per-entity conditional max (partial aggregation), not
    a window over the entity.
    """
    tgt = target if isinstance(target, Column) else F.lit(target)
    b = backups.filter(F.col(ts) <= tgt)
    t, c = F.col(type_col), F.col(ts)
    full = b.filter((t == "D") & ~F.coalesce(F.col(copy_only), F.lit(False))).groupBy(*key).agg(F.max(ts).alias("__full"))
    j = b.join(full, key, "inner").filter(c >= F.col("__full"))
    diff = j.filter(t == "I").groupBy(*key).agg(F.max(ts).alias("__diff"))
    j = j.join(diff, key, "left")
    base = F.coalesce(F.col("__diff"), F.col("__full"))
    keep = (((t == "D") & (c == F.col("__full")) & ~F.coalesce(F.col(copy_only), F.lit(False)))
            | ((t == "I") & (c == F.col("__diff"))) | ((t == "L") & (c > base)))
    out = j.filter(keep).withColumn("step", F.when(t == "D", 1).when(t == "I", 2).otherwise(3))
    out = out.drop("__full", "__diff")
    if part is not None:
        out = out.withColumn("part_order", F.col(part))
    return out


# --------------------------------------------------------------------- E6
def last_n_checks(history: DataFrame, keys: list[str], ts: str, n: int, tiebreak: str) -> DataFrame:
    """Last ``n`` checks by time per entity."""
    return top_n_per_group(history, keys, [F.col(ts).desc(), F.col(tiebreak).desc()], n, rank_col="check_rank")


def last_check(history: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Latest check by id per entity (max_by, partial aggregation)."""
    row = F.struct(*[F.col(c) for c in history.columns if c not in keys])
    return history.groupBy(*keys).agg(F.max_by(row, F.col(id_col)).alias("__r")).select(*keys, "__r.*")


# --------------------------------------------------------------------- E7
def run_status_text(c: Column) -> Column:
    return code_text(c, RUN_STATUS, "-")


def job_history(jobs: DataFrame, steps: DataFrame, history: DataFrame, n: int,
                job_filter: Column | None = None) -> DataFrame:
    """Last ``n`` runs per job and step; jobs that never ran and history rows
    without a step (a job's outcome, step 0) are kept: steps meet the history
    by job and step, jobs meet both by job. Run time from the
    yyyymmdd and hhmmss integers; duration text from hhmmss."""
    d = F.lpad(F.col("run_date").cast("string"), 8, "0")
    run_text = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2),
                        F.lit(" "), fmt_hhmmss("run_time"))
    h = history.withColumn("run_datetime", text_date_time("run_date", "run_time")) \
               .withColumn("run_text", F.when(F.coalesce(F.col("run_date"), F.lit(0)) > 0, run_text)
                           .otherwise(F.lit("-"))) \
               .withColumn("run_status_text", run_status_text(F.col("run_status"))) \
               .withColumn("run_duration_text", fmt_hhmmss("run_duration"))
    h = top_n_per_group(h, ["job_id", "step_id"], [F.col("run_datetime").desc(), F.col("instance_id").desc()], n,
                        rank_col="run_rank")
    out = jobs.join(steps.join(h, ["job_id", "step_id"], "full_outer"), "job_id", "full_outer")
    return out.filter(job_filter) if job_filter is not None else out


# --------------------------------------------------------------------- E8
def align_steps_to_run(runs: DataFrame, history: DataFrame, *, keys: list[str], run_first_id: str,
                       hist_id: str, hist_cols: list[str], bucket_width: int = 4096,
                       keep_unmatched: bool = False) -> DataFrame:
    """For each run start and step (``keys``), the first history row with id
    >= the run's first id (forward as-of join, no pairs). A step without a
    later row is left out unless ``keep_unmatched``."""
    out = asof_forward(runs, history, keys, run_first_id, hist_id, hist_cols, bucket_width, out="step_row")
    return out if keep_unmatched else out.filter(F.col("step_row").isNotNull())


# --------------------------------------------------------------------- E9
# Job execution states and last-outcome texts of the activity view.
EXECUTION_STATUS = {0: "Not idle or suspended", 2: "Waiting For Thread", 3: "Between Retries", 4: "Idle",
                    5: "Suspended", 6: "WaitingForStepToFinish", 7: "PerformingCompletionActions"}
ACTIVITY_OUTCOME = {0: "Fail", 1: "Succeed", 3: "Cancel"}
UNKNOWN_TEXT = "(unknown)"


def run_stamp_text(date_int: Column, time_int: Column, none_text: str) -> Column:
    """yyyymmdd + hhmmss integers -> 'dd/MM/yyyy @ HH:mm:ss'; ``none_text`` for 0/NULL dates."""
    t = F.lpad(time_int.cast("string"), 6, "0")
    d = F.lpad(date_int.cast("string"), 8, "0")
    text = F.concat(F.substring(d, 7, 2), F.lit("/"), F.substring(d, 5, 2), F.lit("/"), F.substring(d, 1, 4),
                    F.lit(" @ "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"),
                    F.substring(t, 5, 2))
    return F.when(F.coalesce(date_int, F.lit(0)) == 0, F.lit(none_text)).otherwise(text)


def job_activity(jobs: DataFrame, servers: DataFrame, *, job_key: str = "job_id",
                 date_col: str = "last_run_date", time_col: str = "last_run_time",
                 outcome_col: str = "last_run_outcome", local_server: str | None = None,
                 categories: DataFrame | None = None) -> DataFrame:
    """Job activity: enabled Yes/No, present state text, and the last run
    chosen over the job's servers by the greatest date * 10^6 + time (ties
    by server name) with its date text and outcome text. With
    ``local_server`` the execution status of an idle job that another server
    runs is not known. Optional per-job columns: current_execution_status,
    current_execution_step, next_run_date/next_run_time, category_id."""
    # ties on the stamp are broken by server name, so a recomputation picks the same row
    stamp = F.struct((F.col(date_col).cast("bigint") * 1000000 + F.col(time_col).cast("bigint")).alias("s"),
                     F.col("server_name").alias("n"))
    pick = F.struct(F.col(outcome_col).alias("outcome"), F.col("server_name").alias("server"),
                    F.col(date_col).alias("d"), F.col(time_col).alias("t"))
    last = servers.groupBy(job_key).agg(F.max_by(pick, stamp).alias("__l"), F.count(F.lit(1)).alias("n_servers"),
                                        F.max(F.col("server_name") != F.lit(local_server)).alias("__remote"))
    out = jobs.join(last, job_key, "left")
    out = out.withColumn("last_run", run_stamp_text(F.col("__l.d"), F.col("__l.t"), "never"))
    out = out.withColumn("last_outcome", code_text(F.col("__l.outcome"), ACTIVITY_OUTCOME, "Unknown"))
    if local_server is not None:
        out = out.withColumn("is_local", F.col("__l.server") == local_server)
    if "enabled" in jobs.columns:
        out = out.withColumn("enabled_text", F.when(F.col("enabled"), F.lit("Yes")).otherwise(F.lit("No")))
    if "current_execution_status" in jobs.columns:
        status = F.col("current_execution_status")
        status = F.coalesce(F.when(~((status == 4) & F.coalesce(F.col("__remote"), F.lit(False))), status), F.lit(0))
        step = (F.col("current_execution_step") if "current_execution_step" in jobs.columns
                else F.lit(None).cast("string"))
        out = out.withColumn("execution_status", F.when(status == 1, F.concat(
            F.lit("Executing (Step:"), F.coalesce(step.cast("string"), F.lit("0 " + UNKNOWN_TEXT)), F.lit(")")))
            .otherwise(code_text(status, EXECUTION_STATUS)))
    if "next_run_date" in jobs.columns:
        out = out.withColumn("next_run", run_stamp_text(F.col("next_run_date"), F.col("next_run_time"),
                                                        "not scheduled"))
    if categories is not None:
        cat = categories.select(F.col("category_id").alias("__cid"), F.col("name").alias("category"))
        out = out.join(cat, out["category_id"] == F.col("__cid"), "left").drop("__cid") \
                 .withColumn("category", F.coalesce("category", F.lit(UNKNOWN_TEXT)))
    return out.drop("__l", "__remote")


# --------------------------------------------------------------------- E10
# Schedule texts by frequency type, relative place and day, and sub-day unit.
FREQ_START = {64: "Starts when SQL Server Agent service starts", 128: "Runs when computer is idle"}
SUBDAY_UNITS = {2: "second", 4: "minute", 8: "hour"}
RELATIVE = {1: "First", 2: "Second", 4: "Third", 8: "Fourth", 16: "Last"}
RELATIVE_DAYS = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday",
                 7: "Saturday", 8: "Day", 9: "Weekday", 10: "Weekend day"}


def _plural(n: Column, word: Column) -> Column:
    return F.concat(word, F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def schedule_text(schedules: DataFrame) -> DataFrame:
    """Human-readable schedule per row (freq_type, freq_interval,
    freq_relative_interval, freq_subday_type, freq_subday_interval,
    active_start_time, active_end_time; active_start_date as yyyymmdd for
    schedules that run once; enabled marks the disabled ones)."""
    d = bitmask_names(schedules, "freq_interval", [(b, n) for b, n, _ in WEEKDAY_BITS], out="__days")
    ft, fi = F.col("freq_type"), F.col("freq_interval")
    date = (F.lpad(F.col("active_start_date").cast("string"), 8, "0") if "active_start_date" in schedules.columns
            else F.lit(None).cast("string"))
    once = F.concat(F.lit("Once on "), F.substring(date, 7, 2), F.lit("/"), F.substring(date, 5, 2), F.lit("/"),
                    F.substring(date, 1, 4), F.lit(" @ "), fmt_hhmmss("active_start_time"))
    main = (F.when(ft == 1, F.coalesce(once, F.lit("Once")))
            .when(ft == 4, F.when(fi > 1, F.concat(F.lit("Every "), fi.cast("string"), F.lit(" Days")))
                  .otherwise(F.lit("Every Day")))
            .when(ft == 8, F.col("__days"))
            .when(ft == 16, F.concat(F.lit("Every "), fi.cast("string"), F.lit(" of the month")))
            .when(ft == 32, F.concat(code_text("freq_relative_interval", RELATIVE), F.lit(" "),
                                     code_text(fi, RELATIVE_DAYS), F.lit(" of the month")))
            .otherwise(F.coalesce(code_text(ft, FREQ_START), F.lit("None"))))
    sub, every = F.col("freq_subday_type"), F.col("freq_subday_interval")
    t = F.lpad(F.col("active_start_time").cast("string"), 6, "0")
    repeat = F.concat(F.lit(". Every "), every.cast("string"), F.lit(" "), _plural(every, code_text(sub, SUBDAY_UNITS)))
    span = F.concat(F.lit(", From "), fmt_hhmmss("active_start_time"), F.lit(" till "), fmt_hhmmss("active_end_time"))
    at = F.when(sub == 1, F.concat(F.lit(" @ "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":"),
                                   F.substring(t, 5, 2))).when(sub.isin(2, 4, 8), repeat)
    off = (F.when(F.col("enabled"), F.lit("")).otherwise(F.lit(" (Disabled)")) if "enabled" in schedules.columns
           else F.lit(""))
    text = F.concat(main, F.coalesce(at, F.lit("")), F.when(sub.isin(4, 8), span).otherwise(F.lit("")), off)
    return d.withColumn("schedule_text", text).drop("__days")


# When a notification or automatic deletion happens.
NOTIFY_WHEN = {1: "When the job succeeds", 2: "When the job fails", 3: "When the job completes"}
# Step outcome actions (4 = go to a given step).
STEP_ACTIONS = {1: "Quit the job reporting success", 2: "Quit the job reporting failure", 3: "Go to the next step"}
# Notification channels: (label, level column, operator name column).
NOTIFY_CHANNELS = [("Email", "notify_level_email", "email_operator"),
                   ("Page", "notify_level_page", "page_operator"),
                   ("Net send", "notify_level_netsend", "netsend_operator"),
                   ("Write to the Windows Application event log", "notify_level_eventlog", "eventlog_operator")]


def _when_text(level: Column) -> Column:
    return code_text(level, NOTIFY_WHEN)


def notify_text(df: DataFrame) -> Column:
    """'Email: [op] When the job fails;Page: ...' for the channels present in
    ``df`` (level 0 or a missing operator gives nothing). Each channel uses
    its own operator column."""
    parts = []
    for label, level, op in NOTIFY_CHANNELS:
        if level in df.columns and op in df.columns:
            piece = F.concat(F.lit(label + ": ["), F.col(op), F.lit("] "), _when_text(F.col(level)), F.lit(";"))
            parts.append(F.coalesce(piece, F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def step_action_text(action: Column, step: Column) -> Column:
    goto = F.concat(F.lit("Go to the step ["), step.cast("string"), F.lit("]"))
    return F.when(action == 4, goto).otherwise(code_text(action, STEP_ACTIONS))


def job_description(jobs: DataFrame, schedules: DataFrame, key: str = "job_id",
                    steps: DataFrame | None = None) -> DataFrame:
    """Jobs with all their schedules as text joined by ' [AND] ' (a job has
    few schedules), the notification and auto-delete texts when the job
    table carries them, and one row per step with its success/failure
    action texts when ``steps`` is given."""
    s = schedule_text(schedules)
    lists = s.groupBy(key).agg(ordered_list("schedule_text", ["schedule_text"], " [AND] ").alias("schedules"))
    out = jobs.join(lists, key, "left")
    if any(level in jobs.columns for _, level, _ in NOTIFY_CHANNELS):
        out = out.withColumn("notify_actions", notify_text(jobs))
    if "delete_level" in jobs.columns:
        out = out.withColumn("autodelete", F.coalesce(
            F.concat(F.lit("Automatically delete job: "), _when_text(F.col("delete_level"))), F.lit("")))
    if steps is not None:
        st = steps.withColumn("on_success", step_action_text(F.col("on_success_action"), F.col("on_success_step_id"))) \
                  .withColumn("on_failure", step_action_text(F.col("on_fail_action"), F.col("on_fail_step_id")))
        out = out.join(st, key, "left")
    return out


