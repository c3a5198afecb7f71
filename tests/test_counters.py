"""Counter accumulation (C9): golden cases and the split property."""

import datetime as dt

from pyspark.sql import functions as F

from fleetsight.operators import capacity as C

T0 = dt.datetime(2024, 1, 1)


def log(spark, readings):
    rows = [("k", T0 + dt.timedelta(hours=i), v) for i, v in enumerate(readings)]
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, v bigint")


def total(spark, readings):
    r = C.accumulate_log(log(spark, readings), ["key"], "ts", ["v"]).first()
    return r["total_v"], r["resets_v"], r["v"]


def test_golden(spark):
    assert total(spark, [5]) == (5, 0, 5)                 # first sight
    assert total(spark, [5, 8, 12]) == (12, 0, 12)        # growth
    assert total(spark, [5, 8, 3]) == (11, 1, 3)          # reset to a lower value
    assert total(spark, [5, 5, 5]) == (5, 0, 5)           # unchanged
    assert total(spark, [5, 2, 1, 4]) == (5 + 2 + 1 + 3, 2, 4)   # two resets in a row


def test_state_form_matches_log(spark):
    readings = [5, 8, 3, 3, 10, 1]
    for split in range(1, len(readings)):
        state = C.accumulate_log(log(spark, readings[:split]), ["key"], "ts", ["v"]).select("key", "v", "total_v")
        for v in readings[split:]:
            snap = spark.createDataFrame([("k", v)], "key string, v bigint")
            state = C.accumulate_counters(state, snap, ["key"], ["v"])
        whole = C.accumulate_log(log(spark, readings), ["key"], "ts", ["v"]).first()["total_v"]
        assert state.first()["total_v"] == whole


def test_new_key_and_untouched_key(spark):
    state = spark.createDataFrame([("a", 10, 100)], "key string, v bigint, total_v bigint")
    snap = spark.createDataFrame([("b", 4)], "key string, v bigint")
    got = {r["key"]: (r["v"], r["total_v"]) for r in C.accumulate_counters(state, snap, ["key"], ["v"]).collect()}
    assert got == {"a": (10, 100), "b": (4, 4)}


def test_previous_crosses_day_buckets(spark):
    rows = [("k", dt.datetime(2024, 1, d, 12), d) for d in (1, 3, 7)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, v bigint")
    from fleetsight.plans.strategies import previous_in_order
    out = previous_in_order(df, ["key"], ["ts"], ["v"], F.to_date("ts"))
    got = sorted((r["v"], r["prev_v"]) for r in out.collect())
    assert got == [(1, None), (3, 1), (7, 3)]
