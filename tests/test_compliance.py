"""Retention, schedules and as-of alignment (E)."""

import datetime as dt

from pyspark.sql import functions as F

from fleetsight.operators import compliance as E
from fleetsight.operators import workload as W


def files(spark, names):
    rows = [("db", i + 1, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "db string, id int, file_name string")


def expired(spark, names, n):
    df = files(spark, names)
    prefix = F.substring_index("file_name", "_", 2)
    return sorted(r["file_name"] for r in E.retention_expired(df, key=["db"], file_id="id", file_name="file_name",
                                                              prefix=prefix, keep_n=n).collect())


def test_retention_fewer_exactly_more(spark):
    names = ["db_01_a.bak", "db_01_a.trn", "db_02_a.bak", "db_02_b.bak", "db_03_a.bak", "db_03_x.txt"]
    assert expired(spark, names, 4) == []                           # fewer groups than N: nothing expires
    assert expired(spark, names, 3) == []                           # exactly N: the oldest kept group is the first
    assert expired(spark, names, 2) == ["db_01_a.bak", "db_01_a.trn"]
    assert expired(spark, names, 1) == ["db_01_a.bak", "db_01_a.trn", "db_02_a.bak", "db_02_b.bak"]


def test_schedule_text(spark):
    rows = [(1, 1, 0, 0, 0, 93000, 235959), (4, 1, 0, 1, 0, 0, 235959), (4, 2, 0, 1, 0, 0, 235959),
            (8, 62, 0, 1, 0, 220000, 235959), (16, 15, 0, 1, 0, 10000, 235959), (32, 6, 16, 1, 0, 0, 235959),
            (4, 1, 0, 4, 15, 80000, 180000), (4, 1, 0, 2, 1, 0, 235959), (64, 0, 0, 0, 0, 0, 0), (128, 0, 0, 0, 0, 0, 0)]
    rows = [(*r, 20240131, k != 2) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "freq_type int, freq_interval int, freq_relative_interval int, "
                                     "freq_subday_type int, freq_subday_interval int, active_start_time int, "
                                     "active_end_time int, active_start_date int, enabled boolean")
    got = [r["schedule_text"] for r in E.schedule_text(df).collect()]
    assert got == ["Once on 31/01/2024 @ 09:30:00", "Every Day @ 00:00:00", "Every 2 Days @ 00:00:00 (Disabled)",
                   "Monday, Tuesday, Wednesday, Thursday, Friday @ 22:00:00",
                   "Every 15 of the month @ 01:00:00", "Last Friday of the month @ 00:00:00",
                   "Every Day. Every 15 minutes, From 08:00:00 till 18:00:00", "Every Day. Every 1 second",
                   "Starts when SQL Server Agent service starts", "Runs when computer is idle"]


def test_asof_forward(spark):
    runs = spark.createDataFrame([("j", 1), ("j", 5), ("j", 20), ("k", 3)], "job string, first_id int")
    hist = spark.createDataFrame([("j", 2, "a"), ("j", 5, "b"), ("j", 9, "c"), ("k", 1, "z")],
                                 "job string, hid int, msg string")
    out = E.align_steps_to_run(runs, hist, keys=["job"], run_first_id="first_id", hist_id="hid",
                               hist_cols=["msg"], bucket_width=4, keep_unmatched=True)
    inner = E.align_steps_to_run(runs, hist, keys=["job"], run_first_id="first_id", hist_id="hid",
                                 hist_cols=["msg"], bucket_width=4)
    assert sorted((r["job"], r["first_id"]) for r in inner.collect()) == [("j", 1), ("j", 5)]
    got = sorted((r["job"], r["first_id"], r["step_row"]["hid"] if r["step_row"] else None) for r in out.collect())
    assert got == [("j", 1, 2), ("j", 5, 5), ("j", 20, None), ("k", 3, None)]


def test_restore_chain(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("db", 1, t(1), "D", False), ("db", 2, t(2), "L", False), ("db", 3, t(3), "D", True),
            ("db", 4, t(4), "I", False), ("db", 5, t(5), "L", False), ("db", 6, t(6), "I", False),
            ("db", 7, t(7), "L", False), ("db", 8, t(9), "L", False)]
    df = spark.createDataFrame(rows, "db string, backup_set_id int, backup_start_date timestamp_ntz, type string, "
                                     "is_copy_only boolean")
    out = E.restore_chain(df, key=["db"], target=F.lit(t(8)))
    assert sorted((r["backup_set_id"], r["step"]) for r in out.collect()) == [(1, 1), (6, 2), (7, 3)]


def test_maintenance_thresholds(spark):
    rows = [(1, 10.0, 1001, False), (2, 10.01, 1001, False), (3, 30.0, 1001, False), (4, 30.01, 1001, False),
            (5, 50.0, 1000, False), (6, 9.99, 5000, False), (7, 50.0, 1001, True)]
    df = spark.createDataFrame(rows, "id int, frag double, pages int, lob boolean")
    got = {r["id"]: (r["operation"], r["online"])
           for r in W.plan_maintenance(df, frag_col="frag", pages_col="pages", lob_col="lob").collect()}
    # 10 is not above the reorganize threshold; 1000 pages are not above the page threshold
    assert got == {2: ("REORGANIZE", True), 3: ("REORGANIZE", True), 4: ("REBUILD", False), 7: ("REORGANIZE", True)}
    ent = {r["id"]: r["online"] for r in W.plan_maintenance(df, frag_col="frag", pages_col="pages",
                                                            enterprise=True).collect()}
    assert ent[4] is True


def test_job_description_texts(spark):
    jobs = spark.createDataFrame([("j1", 2, 1, "ops", None, 3)],
                                 "job_id string, notify_level_email int, notify_level_page int, email_operator string, "
                                 "page_operator string, delete_level int")
    sched = spark.createDataFrame([("j1", 4, 1, 0, 1, 0, 10000, 235959)],
                                  "job_id string, freq_type int, freq_interval int, freq_relative_interval int, "
                                  "freq_subday_type int, freq_subday_interval int, active_start_time int, "
                                  "active_end_time int")
    steps = spark.createDataFrame([("j1", 1, 3, None, 4, 3)], "job_id string, step_id int, on_success_action int, "
                                  "on_success_step_id int, on_fail_action int, on_fail_step_id int")
    r = E.job_description(jobs, sched, steps=steps).first()
    assert r["schedules"] == "Every Day @ 01:00:00"
    assert r["notify_actions"] == "Email: [ops] When the job fails;"
    assert r["autodelete"] == "Automatically delete job: When the job completes"
    assert (r["on_success"], r["on_failure"]) == ("Go to the next step", "Go to the step [3]")


def test_merge_new_row_takes_source_default(spark):
    from fleetsight.operators import snapshot as A
    current = spark.createDataFrame([("s1", "a", 5)], "server string, name string, keep_n int")
    feed = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c")], "server string, name string")
    settings = spark.createDataFrame([("s1", 7)], "server string, keep_n int")
    got = {r["name"]: r["keep_n"] for r in A.merged_current(A.snapshot_merge(
        current, feed, ["server", "name"], custom_defaults={"keep_n": 10}, source_col="server",
        source_defaults=settings)).collect()}
    assert got == {"a": 5, "b": 7, "c": 10}


def test_job_activity_texts(spark):
    jobs = spark.createDataFrame([("j1", True, 1, "3", 20240105, 61500, 7), ("j2", False, 4, None, 0, 0, None)],
                                 "job_id string, enabled boolean, current_execution_status int, "
                                 "current_execution_step string, next_run_date int, next_run_time int, category_id int")
    servers = spark.createDataFrame([("j1", "a", 20240102, 30000, 1), ("j1", "b", 20240102, 30000, 0)],
                                    "job_id string, server_name string, last_run_date int, last_run_time int, "
                                    "last_run_outcome int")
    cats = spark.createDataFrame([(7, "Maintenance")], "category_id int, name string")
    got = {r["job_id"]: r for r in E.job_activity(jobs, servers, local_server="b", categories=cats).collect()}
    j1, j2 = got["j1"], got["j2"]
    assert (j1["enabled_text"], j1["execution_status"], j1["last_run"], j1["last_outcome"], j1["next_run"],
            j1["category"]) == ("Yes", "Executing (Step:3)", "02/01/2024 @ 03:00:00", "Fail",
                                "05/01/2024 @ 06:15:00", "Maintenance")
    assert (j2["execution_status"], j2["last_run"], j2["next_run"], j2["category"]) == \
        ("Idle", "never", "not scheduled", "(unknown)")
