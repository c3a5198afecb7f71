"""Small cases whose answers follow from the reference's own queries."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import capacity as C
from fleetsight.operators import compliance as E
from fleetsight.operators import profile as G
from fleetsight.operators import reference as B
from fleetsight.operators import security as S
from fleetsight.operators import snapshot as A
from fleetsight.operators import workload as W


def edges(spark, pairs):
    return spark.createDataFrame([("C", a, b, "", "") for a, b in pairs],
                                 "class_desc string, permission_name string, covering_permission_name string, "
                                 "parent_class_desc string, parent_covering_permission_name string")


def test_closure_has_no_depth_limit(spark):
    e = edges(spark, [(f"p{k}", f"p{k + 1}") for k in range(100)])
    start = spark.createDataFrame([("C", "p0")], "class_desc string, permission_name string")
    got = {r["permission_name"]: r["max_depth"] for r in B.implied_permissions(e, start).collect()}
    assert got == {f"p{k}": k for k in range(101)}


def test_closure_of_a_cycle_raises(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b")])
    with pytest.raises(ValueError):
        B.implied_permissions(e, spark.createDataFrame([("C", "a")], "class_desc string, permission_name string"))


def test_last_fixed_width_column_is_whole(spark):
    lines = spark.createDataFrame([("s", 0, "Name  Text"), ("s", 1, "n     " + "x" * 12_000)],
                                  "source string, line_no long, line string")
    assert len(A.parse_fixed_width(lines, "source", ["Name", "Text"], "^Name").first()["Text"]) == 12_000


def test_extra_feed_columns_are_added(spark):
    feed = spark.createDataFrame([(1, "x")], "ID int, extra string")
    target = spark.createDataFrame([], "id long, name string").schema
    assert A.load_with_drift(feed, target).dtypes == [("id", "bigint"), ("name", "string"), ("extra", "string")]


def test_unused_at_the_threshold(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    usage = spark.createDataFrame([(1, 5), (2, 6)], "uid int, seeks int")
    assert sorted(r["id"] for r in W.unused_items(items, usage, "id", "uid", threshold=5).collect()) == [1, 3]


def test_duplicates_stay_inside_a_table(spark):
    m = spark.createDataFrame([("t1", 1, "id", 1), ("t2", 2, "id", 1), ("t2", 3, "id", 1)],
                              "tab string, ix int, col string, o int")
    got = W.duplicate_signatures(m, ["ix"], "col", "o", scope=["tab"]).collect()
    assert sorted(r["ix"] for r in got) == [2, 3]


def test_density_of_the_own_table(spark):
    details = spark.createDataFrame([(1, 7, 10), (2, 7, 10)], "item_id int, database_id int, impact int")
    cols = spark.createDataFrame([(1, 100, "id", "EQUALITY"), (1, 100, "kind", "EQUALITY"), (2, 200, "id", "EQUALITY"),
                                  (2, 200, "kind", "EQUALITY")], "item_id int, object_id int, column_name string, usage string")
    sel = spark.createDataFrame([(100, "id", 0.1, False), (100, "kind", 0.5, False), (200, "id", 0.9, False),
                                 (200, "kind", 0.5, False), (200, "id", 0.95, True)],
                                "object_id int, column_name string, density double, auto_created boolean")
    got = {r["item_id"]: r["key_columns"] for r in W.rank_missing_index(details, cols, sel).collect()}
    assert got == {1: "id, kind", 2: "kind, id"}


def test_all_partitions_are_counted(spark):
    f = spark.createDataFrame([(1, 1, 50.0, 2000), (1, 2, 1.0, 2000)],
                              "t int, p int, avg_fragmentation_in_percent double, page_count int")
    assert [r["n_items_in_table"] for r in W.plan_maintenance(f, table_key=["t"]).collect()] == [2]


def test_growth_leaves_null_sizes_out(spark):
    d = spark.createDataFrame([("a", f"2024-01-0{k} 00:00:00", v) for k, v in ((1, 10), (2, None), (3, 15))],
                              "e string, ts string, size int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [r["size_growth"] for r in C.growth_report(d, ["e"], "ts", ["size"]).orderBy("ts").collect()]
    assert got == [10, 5]


def test_null_readings_count_as_zero(spark):
    log = spark.createDataFrame([("k", f"2024-01-0{k} 00:00:00", v) for k, v in ((1, 10), (2, None), (3, 15))],
                                "k string, ts string, c long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert C.accumulate_log(log, ["k"], "ts", ["c"]).first()["total_c"] == 25
    state = spark.createDataFrame([], "k string, c long, total_c long")
    for v in (10, None, 15):
        state = C.accumulate_counters(state, spark.createDataFrame([("k", v)], "k string, c long"), ["k"], ["c"])
    assert state.first()["total_c"] == 25


def test_minutes_of_different_hours_stay_apart(spark):
    d = spark.createDataFrame([("2024-01-01 10:05:00", 1), ("2024-01-01 11:05:00", 2)], "ts string, v int") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r["minute"] for r in C.calendar_rollup(d, "ts", ["v"], ["minute"]).collect()) == ["10:05", "11:05"]


def test_blockers_come_from_all_requests(spark):
    r = spark.createDataFrame([(1, 0, -1, None, 1), (2, 0, -1, 1, 2)], "session_id int, statement_start_offset int, "
                              "statement_end_offset int, blocking_session_id int, sql_handle int") \
        .withColumn("start_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("percent_complete", F.lit(0))
    texts = spark.createDataFrame([(1, "blocker"), (2, "waiter")], "sql_handle int, text string")
    got = C.running_report(r, texts, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"),
                           session_filter=F.col("session_id") == 2).collect()
    assert [x["blocking_statement"] for x in got] == ["blocker"]


def test_no_batch_is_batch_zero(spark):
    e = spark.createDataFrame([("a", "DDDDDDD", None), ("b", "DDDDDDD", 1), ("c", "DDDDDDD", 0)],
                              "name string, s string, batch int")
    assert sorted(r["name"] for r in E.due_today(e, schedule="s", weekday=2, batch_col="batch").collect()) == ["a", "c"]
    assert [r["name"] for r in E.due_today(e, schedule="s", weekday=2, batch_col="batch", names=["b"]).collect()] == ["b"]


def test_outcome_rows_keep_their_job(spark):
    jobs = spark.createDataFrame([("j", "job name")], "job_id string, job_name string")
    steps = spark.createDataFrame([("j", 1, "one")], "job_id string, step_id int, step_name string")
    h = spark.createDataFrame([("j", 0, 5, 20240101, 1, 1, 1), ("j", 1, 4, 20240101, 1, 1, 1)],
                              "job_id string, step_id int, instance_id int, run_date int, run_time int, "
                              "run_duration int, run_status int")
    got = sorted((r["step_id"], r["job_name"], r["step_name"]) for r in E.job_history(jobs, steps, h, 1).collect())
    assert got == [(0, "job name", None), (1, "job name", "one")]


def test_remote_failures_are_shown(spark):
    jobs = spark.createDataFrame([("j", 4)], "job_id string, current_execution_status int")
    servers = spark.createDataFrame([("j", "far", 20240101, 1, 0)], "job_id string, server_name string, "
                                    "last_run_date int, last_run_time int, last_run_outcome int")
    got = E.job_activity(jobs, servers, local_server="here").first()
    assert (got["last_outcome"], got["execution_status"]) == ("Fail", "Not idle or suspended")


def test_orphans_are_sql_users(spark):
    p = spark.createDataFrame([("a", 1, "SQL_USER"), ("MS_DataCollectorInternalUser", 2, "SQL_USER"), ("w", 3, "WINDOWS_USER"),
                               ("dbo", 4, "SQL_USER")], "name string, sid int, principal_type_desc string")
    logins = spark.createDataFrame([], "sid int")
    assert sorted(r["name"] for r in S.orphan_principals(p, logins).collect()) == ["MS_DataCollectorInternalUser", "a"]


def test_repeated_event_names_take_the_greatest(spark):
    xml = ('<event name="n" timestamp="2024"><data name="k"><value>1</value></data><data name="k"><value>3</value></data>'
           '<action name="a"><value>x</value></action></event>')
    got = G.event_attributes(spark.createDataFrame([(xml,), (None,)], "p string"), "p", ["k"], ["a"], fmt="xml").collect()
    assert [(r["event_name"], r["event_time"], r["k"], r["action_a"]) for r in got] == [("n", "2024", "3", "x"), (None,) * 4]
    js = spark.createDataFrame([('{"k": "1", "k": "2", "o": 3}',)], "p string")
    assert G.event_attributes(js, "p", ["k", "o"]).first()["o"] == "3"


def test_products_beyond_64_bits(spark):
    s = spark.createDataFrame([("d", 1, 10**7, 10**13), ("d", 1, 2, 3)], "db string, plan int, n long, v long")
    got = W.top_workload(s, group_cols=["db"], plan_col="plan", count_col="n", measures={"duration": "v"}).first()
    assert got["total_duration"] == Decimal(10**20 + 6) and got["percent_duration"] == 100


def test_mean_wait_is_the_mean_of_the_categories(spark):
    w = spark.createDataFrame([("p", "a", 10, 20), ("p", "a", 10, 20), ("p", "b", 10, 100)],
                              "plan string, cat string, total long, avg long")
    assert W.category_breakdown(w, ["plan"], "cat", "total", "avg").first()["mean"] == 60.0


def test_case_alone_is_no_change(spark):
    schema = "id int, name string, size int"
    before = spark.createDataFrame([(1, "ABC", 1), (2, "x", 1), (3, None, 1)], schema)
    after = spark.createDataFrame([(1, "abc", 1), (2, "y", 1), (3, "n", 1)], schema)
    assert sorted((r["id"], r["column_name"]) for r in A.change_report(before, after, ["id"]).collect()) == [
        (2, "name"), (3, "name")]
    assert sorted(r["id"] for r in A.status_change_report(before, after, ["id"], ["name", "size"]).collect()) == [2, 3]


def test_text_keys_meet_without_case(spark):
    cur = spark.createDataFrame([("DB1", 1), ("db2", 2)], "name string, size int")
    got = A.snapshot_merge(cur, spark.createDataFrame([("db1", 5)], "name string, size int"), ["name"], policy="keep")
    assert sorted((r["name"], r["size"], r["action"]) for r in got.collect()) == [("db1", 5, "UPDATE"), ("db2", 2, "KEEP")]
