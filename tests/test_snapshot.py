"""Golden cases for snapshot merge, history and change reports (FIXTURES 3)."""

import datetime as dt

from pyspark.sql import functions as F

from fleetsight.operators import snapshot as A

CUR = "server string, name string, size int, owner string, schedule string"
FEED = "server string, name string, size int, owner string"


def _merge(spark, policy="reported", **kw):
    current = spark.createDataFrame([
        ("s1", "changed", 10, "a", "DDDDDDD"),
        ("s1", "same", 5, "a", "-------"),
        ("s1", "gone_reported", 1, "a", "DDDDDDD"),
        ("s2", "gone_not_reached", 1, "a", "DDDDDDD"),
        ("s3", "gone_unmonitored", 1, "a", "DDDDDDD"),
        ("s1", "null_to_value", 1, None, "DDDDDDD"),
    ], CUR)
    feed = spark.createDataFrame([
        ("s1", "changed", 11, "a"), ("s1", "same", 5, "a"), ("s1", "new", 7, "b"), ("s1", "null_to_value", 1, "x"),
    ], FEED)
    monitored = spark.createDataFrame([("s1",), ("s2",)], "server string")
    tagged = A.snapshot_merge(current, feed, ["server", "name"], custom_defaults={"schedule": "DDDDDDD"},
                              monitored=monitored, source_col="server", policy=policy, **kw)
    return tagged


def test_merge_actions_reported_policy(spark):
    rows = {r["name"]: r for r in _merge(spark).collect()}
    assert rows["changed"]["action"] == "UPDATE" and rows["changed"]["size"] == 11
    assert rows["changed"]["schedule"] == "DDDDDDD"            # custom column kept
    assert rows["same"]["action"] == "UPDATE" and rows["same"]["schedule"] == "-------"
    assert rows["new"]["action"] == "INSERT" and rows["new"]["schedule"] == "DDDDDDD"
    assert rows["gone_reported"]["action"] == "DELETE"         # its server reported
    assert rows["gone_not_reached"]["action"] == "KEEP"        # server not reached
    assert rows["gone_unmonitored"]["action"] == "DELETE"      # server unmonitored
    assert rows["null_to_value"]["owner"] == "x"


def test_merge_policies(spark):
    flag = {r["name"]: r["action"] for r in _merge(spark, "flag").collect()}
    assert flag["gone_reported"] == "FLAG" and flag["gone_not_reached"] == "FLAG"
    assert flag["gone_unmonitored"] == "DELETE"
    keep = {r["name"]: r["action"] for r in _merge(spark, "keep").collect()}
    assert keep["gone_unmonitored"] == "KEEP"
    unmon = {r["name"]: r["action"] for r in _merge(spark, "unmonitored").collect()}
    assert unmon["gone_reported"] == "KEEP" and unmon["gone_unmonitored"] == "DELETE"


def test_merge_twice_is_stable(spark):
    tagged = _merge(spark)
    cur1 = A.merged_current(tagged)
    feed = spark.createDataFrame([
        ("s1", "changed", 11, "a"), ("s1", "same", 5, "a"), ("s1", "new", 7, "b"), ("s1", "null_to_value", 1, "x"),
    ], FEED)
    monitored = spark.createDataFrame([("s1",), ("s2",)], "server string")
    cur2 = A.merged_current(A.snapshot_merge(cur1, feed, ["server", "name"], custom_defaults={"schedule": "DDDDDDD"},
                                             monitored=monitored, source_col="server"))
    assert sorted(map(tuple, cur1.collect())) == sorted(map(tuple, cur2.collect()))


def test_pre_images_and_history(spark):
    tagged = _merge(spark)
    pre = A.pre_images(tagged)
    assert {r["name"] for r in pre.collect()} == {"changed", "same", "gone_reported", "gone_unmonitored",
                                                  "null_to_value"}
    cols = ["size", "owner", "schedule"]
    hist = spark.createDataFrame([("s1", "same", 5, "a", "-------")], CUR)
    hist = hist.withColumn("row_checksum", A.row_checksum(cols))
    new = A.append_history(hist, pre.drop("action"), ["server", "name"], cols)
    assert "same" not in {r["name"] for r in new.collect()}      # same key + checksum already there


def test_checksum_null_markers(spark):
    df = spark.createDataFrame([(1, None), (None, 1)], "a int, b int").select(A.row_checksum(["a", "b"]).alias("c"))
    a, b = [r["c"] for r in df.collect()]
    assert a != b


def test_change_report_empty_iff_equal(spark):
    before = spark.createDataFrame([(1, "x", 1.5), (2, None, 2.0)], "k int, a string, b double")
    assert A.change_report(before, before, ["k"]).count() == 0
    after = spark.createDataFrame([(1, "y", 1.5), (2, "z", 2.0)], "k int, a string, b double")
    rows = sorted((r["k"], r["column_name"], r["previous_value"], r["current_value"])
                  for r in A.change_report(before, after, ["k"]).collect())
    assert rows == [(1, "a", "x", "y"), (2, "a", "", "z")]


def test_append_if_changed_first_of_month(spark):
    hist = spark.createDataFrame([("db", 10)], "name string, size int")
    load = spark.createDataFrame([("db", 10, dt.datetime(2024, 3, 1, 8)), ("db", 10, dt.datetime(2024, 3, 2, 8)),
                                  ("db", 11, dt.datetime(2024, 3, 2, 9))], "name string, size int, ts timestamp_ntz")
    out = A.append_if_changed(hist, load, ["name"], ["size"], "ts")
    got = sorted((r["size"], r["ts"].day) for r in out.collect())
    assert got == [(10, 1), (11, 2)]


def test_upsert_with_change_date(spark):
    state = spark.createDataFrame([(1, "PRINCIPAL"), (2, "MIRROR"), (3, None)], "k int, role string")
    feed = spark.createDataFrame([(1, "PRINCIPAL"), (2, "PRINCIPAL"), (3, "MIRROR"), (4, "MIRROR")],
                                 "k int, role string")
    now = dt.datetime(2024, 1, 1)
    out = {r["k"]: r["action"] for r in A.upsert_with_change_date(state, feed, ["k"], ["role"], F.lit(now)).collect()}
    assert out == {2: "UPDATE", 3: "UPDATE", 4: "INSERT"}


def test_principal_roles_member_lists(spark):
    from fleetsight.operators import security as S
    principals = spark.createDataFrame([(1, "alice", b"\x01"), (2, "bob", b"\x02"), (10, "readers", None),
                                        (11, "writers", None)], "principal_id int, name string, sid binary")
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "role_id int, member_id int")
    logins = spark.createDataFrame([(b"\x01", "DOM\\alice")], "sid binary, login_name string")
    got = {r["name"]: (r["role_list"], r["member_list"], r["login_name"])
           for r in S.principal_roles(principals, members, logins=logins, with_members=True).collect()}
    assert got["alice"] == ("readers, writers", None, "DOM\\alice")
    assert got["readers"] == (None, "alice, bob", None)


def test_stale_sources_from_tables(spark):
    t1 = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8),), (dt.datetime(2024, 1, 1, 9),)], "ts timestamp_ntz")
    t2 = spark.createDataFrame([(dt.datetime(2024, 1, 1, 11),)], "ts timestamp_ntz")
    mon = spark.createDataFrame([("SRV1",), ("SRV2",)], "m string")
    out = A.stale_sources({"perfmon_SRV1": t1, "perfmon_SRV2": t2, "perfmon_SRV3": t1}, "source", "ts",
                          F.lit(dt.datetime(2024, 1, 1, 12, 30)).cast("timestamp_ntz"), 3.0, monitored=mon,
                          monitored_col="m",
                          source_machine=F.substring_index(F.col("source"), "_", -1))
    assert [(r["source"], r["last_data_collection"].hour) for r in out.collect()] == [("perfmon_SRV1", 9)]
