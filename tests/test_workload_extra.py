"""Operators that take estate-metadata inputs (FIXTURES.md): golden cases."""

from fleetsight.operators import profile as G
from fleetsight.operators import workload as W


def test_rank_missing_index(spark):
    details = spark.createDataFrame([(1, 1, 90.0), (2, 1, 50.0)], "item_id int, database_id int, impact double")
    cols = spark.createDataFrame([(1, "a", "INEQUALITY"), (1, "b", "EQUALITY"), (1, "c", "EQUALITY"),
                                  (1, "b", "INCLUDE"), (1, "d", "INCLUDE"), (2, "a", "EQUALITY")],
                                 "item_id int, column_name string, usage string")
    sel = spark.createDataFrame([("a", 0.5), ("b", 0.01), ("c", 0.2), ("d", 1.0)], "column_name string, density double")
    got = {r["item_id"]: (r["key_columns"], r["include_columns"], r["impact_rank"])
           for r in W.rank_missing_index(details, cols, sel).collect()}
    assert got[1] == ("b, c, a", "d", 1)
    assert got[2] == ("a", None, 2)


def test_describe_items(spark):
    rowstore = spark.createDataFrame([(1, 1, "pk_t"), (1, 2, "ix_t")], "object_id int, index_id int, name string")
    xml = spark.createDataFrame([(1, 3, "xml_t")], "object_id int, index_id int, name string")
    cols = spark.createDataFrame([(1, 1, "id", 1, False, False), (1, 2, "b", 2, False, True), (1, 2, "a", 1, False, False),
                                  (1, 2, "c", 0, True, False)],
                                 "object_id int, index_id int, column_name string, key_ordinal int, is_included boolean, "
                                 "is_descending boolean")
    out = {r["name"]: (r["kind"], r["key_columns"], r["included_columns"])
           for r in W.describe_items({"ROWSTORE": rowstore, "XML": xml}, cols).collect()}
    assert out["ix_t"] == ("ROWSTORE", "a, b DESC", "c")
    assert out["xml_t"] == ("XML", None, None)


def test_find_types_and_columns(spark):
    cols = spark.createDataFrame([("t", "a", "TEXT"), ("t", "b", "int"), ("u", "c", "image")],
                                 "table_name string, column_name string, data_type string")
    assert sorted(r["column_name"] for r in G.find_types(cols).collect()) == ["a", "c"]
    assert [r["column_name"] for r in G.find_types(cols, ["int"]).collect()] == ["b"]
    meta = G.schema_columns({"x": spark.createDataFrame([(1, "a")], "id bigint, s string")})
    assert [(r["column_name"], r["data_type"]) for r in meta.collect()] == [("id", "bigint"), ("s", "string")]


def test_top_workload_sort_choices_and_per_interval(spark):
    rows = []
    for plan in range(1, 6):
        for interval in (1, 2):
            for outcome in ("Regular", "Aborted"):
                rows.append(("db", plan, interval, outcome, plan * interval, 10 * plan, 7 - plan, plan % 3,
                             plan % 2, 1, 5 - plan % 5, 3))
    schema = ("db string, plan_id int, interval_id int, execution_type_desc string, count_executions bigint, "
              "avg_duration bigint, avg_cpu_time bigint, avg_reads bigint, avg_physical_reads bigint, "
              "avg_writes bigint, avg_memory bigint, avg_rowcount bigint")
    stats = spark.createDataFrame(rows, schema)
    measures = {m: f"avg_{m}" for m in ["duration", "cpu_time", "reads", "physical_reads", "writes", "memory"]}
    choices = W.sort_choices(list(measures))
    assert len(choices) == 13
    for choice in choices:
        out = W.top_workload(stats, group_cols=["db"], plan_col="plan_id", count_col="count_executions",
                             measures=measures, outcome_col="execution_type_desc", order_by=choice, n=2).collect()
        assert len(out) == 2
        best = max(r[choices[choice]] for r in out)
        assert {r["rn"] for r in out if r[choices[choice]] == best} & {1}
    top = W.top_workload(stats, group_cols=["db"], plan_col="plan_id", count_col="count_executions",
                         measures=measures, outcome_col="execution_type_desc", order_by="total_duration", n=3,
                         interval_col="interval_id", per_interval=True).collect()
    # total duration per (plan, interval) = 20 * plan^2 * interval
    assert [(r["plan_id"], r["interval_id"]) for r in sorted(top, key=lambda r: r["rn"])] == [(5, 2), (4, 2), (5, 1)]
    r = [x for x in top if (x["plan_id"], x["interval_id"]) == (5, 2)][0]
    assert (r["total_exec_successful"], r["total_exec_aborted"], r["total_executions"]) == (10, 10, 20)
    assert r["total_executions_breakdown"] == "(Successful:10, Aborted:10, Exceptions:0)"


def test_unused_items_with_columns_and_stats_sampling(spark):
    items = spark.createDataFrame([(1, "ix_a"), (2, "ix_b")], "index_id int, name string")
    usage = spark.createDataFrame([(2, 500)], "index_id int, seeks int")
    cols = spark.createDataFrame([(1, "b", 2, False), (1, "a", 1, False), (1, "z", 0, True)],
                                 "index_id int, column_name string, key_ordinal int, is_included boolean")
    out = W.unused_items(items, usage, "index_id", "index_id", threshold=100, columns=cols).collect()
    assert [(r["index_id"], r["user_seeks"], r["key_columns"], r["included_columns"]) for r in out] == \
        [(1, 0, "a, b", "z")]
    # the percent threshold is against the table rows (10% of 2000 = 200)
    stats = spark.createDataFrame([(1, 1000, 250, 500, 2000), (2, 1000, 0, 10, 2000), (3, 1000, 150, 10, 2000)],
                                  "id int, rows bigint, modification_counter bigint, rows_sampled bigint, t bigint")
    got = W.stale_statistics(stats, sampled_col="rows_sampled", table_rows_col="t").collect()
    assert [(r["id"], str(r["modified_percent"]), str(r["sampled_percent"]), str(r["sampled_percent_of_table"]))
            for r in got] == [(1, "25.00", "50.00", "25.00")]


def test_command_log_statistics(spark):
    import datetime as dt
    log = spark.createDataFrame([(1, "UPDATE_STATISTICS", "UPDATE STATISTICS t s",
                                  "<ExtendedInfo><RowCount>800</RowCount><ModificationCounter>100</ModificationCounter>"
                                  "</ExtendedInfo>", dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 1, 0, 5))],
                                "id int, command_type string, command string, extended_info string, "
                                "start_time timestamp_ntz, end_time timestamp_ntz")
    r = W.command_log_report(log, "statistics").first()
    assert (r["row_count"], r["modification_counter"], str(r["modification_percent"]), r["duration"]) == \
        (800, 100, "12.50", "01:00:05")


def test_top_workload_without_groups(spark):
    stats = spark.createDataFrame([(1, 2, 10), (2, 1, 30), (3, 1, 5)],
                                  "plan_id int, count_executions bigint, avg_duration bigint")
    out = W.top_workload(stats, group_cols=[], plan_col="plan_id", count_col="count_executions",
                         measures={"duration": "avg_duration"}, n=2).collect()
    got = sorted((r["rn"], r["plan_id"], str(r["percent_duration"])) for r in out)
    assert got == [(1, 2, "54.55"), (2, 1, "36.36")]


def test_key_candidates_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "id bigint, x int")
    b = spark.createDataFrame([(1, None), (2, 2)], "k int, id int")
    c = spark.createDataFrame([(1,), (1,)], "v int")
    out = {r["table_name"]: (r["key_column"], r["reason"]) for r in G.key_candidates(
        {"a": (a, None, None), "b": (b, None, None), "c": (c, None, None), "d": (c, None, "v")},
        identities={"b": "k"}).collect()}
    assert out == {"a": ("id", "unique and not null"), "b": ("k", "identity column"),
                   "c": (None, "no key: a new key column is needed"), "d": ("v", "declared key")}
