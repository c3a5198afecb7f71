"""Batch = stream: the micro-batch forms give the batch results."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from fleetsight.operators import capacity as C
from fleetsight.streaming import CounterStateSink, windowed_rollup
from fleetsight.streaming.micro_batch import latest_version


def _split_events(spark, base):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        "user_id", "event_type", "ts", "event_id", F.col("value").cast("decimal(15,2)").alias("value"))
    src = os.path.join(base, "src")
    # three files by day range, so the stream sees three micro-batches in time order
    bounds = ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01"]
    for i in range(3):
        part = ev.filter((F.col("ts") >= F.lit(bounds[i]).cast("timestamp_ntz"))
                         & (F.col("ts") < F.lit(bounds[i + 1]).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    return ev, src


def test_counters_stream_equals_batch(spark, tmpdir_path):
    ev, src = _split_events(spark, tmpdir_path)
    state = os.path.join(tmpdir_path, "state")
    sink = CounterStateSink(state, ["user_id", "event_type"], "ts", ["value"], ["event_id"])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(latest_version(spark, state))
    want = C.accumulate_log(ev, ["user_id", "event_type"], "ts", ["value"], ["event_id"])
    g = sorted((r["user_id"], r["event_type"], r["total_value"]) for r in got.collect())
    w = sorted((r["user_id"], r["event_type"], r["total_value"]) for r in want.collect())
    assert g == w


def test_windowed_rollup_stream(spark, tmpdir_path):
    ev, src = _split_events(spark, tmpdir_path)
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(src, "*"))
    agg = windowed_rollup(stream, "ts", ["value"], "1 day", "1 day")
    q = agg.writeStream.outputMode("update").format("memory").queryName("rollup_out").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["w"], r["n"]) for r in spark.sql(
        "SELECT CAST(window.start AS STRING) AS w, max(n_readings) AS n FROM rollup_out GROUP BY 1").collect()}
    want = {(r["w"], r["n"]) for r in ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("window"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("string").alias("w"), "n").collect()}
    assert got == want


def test_snapshot_merge_stream_equals_batch(spark, tmpdir_path):
    from fleetsight.operators import snapshot as A
    from fleetsight.streaming import SnapshotMergeSink

    schema = "server string, name string, size int"
    initial = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "c", 3)], schema)
    loads = [[("s1", "a", 5), ("s1", "d", 7)], [("s1", "a", 6), ("s2", "c", 3)]]
    src = os.path.join(tmpdir_path, "loads")
    for i, rows in enumerate(loads):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"load{i}"))
    cur, hist = os.path.join(tmpdir_path, "current"), os.path.join(tmpdir_path, "history")
    sink = SnapshotMergeSink(cur, hist, ["server", "name"], initial=initial, source_col="server")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(latest_version(spark, cur)).collect()))

    state = initial
    for rows in loads:
        state = A.merged_current(A.snapshot_merge(state, spark.createDataFrame(rows, schema), ["server", "name"],
                                                  source_col="server"))
    assert got == sorted(map(tuple, state.collect()))


def test_measurement_append_stream(spark, tmpdir_path):
    import datetime as dt

    from fleetsight.streaming import MeasurementAppendSink

    schema = "name string, size int, ts timestamp_ntz"
    loads = [[("db", 10, dt.datetime(2024, 3, 2))], [("db", 10, dt.datetime(2024, 3, 3))],
             [("db", 10, dt.datetime(2024, 4, 1))], [("db", 11, dt.datetime(2024, 4, 2))]]
    src = os.path.join(tmpdir_path, "m")
    for i, rows in enumerate(loads):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"load{i}"))
    hist = os.path.join(tmpdir_path, "hist")
    sink = MeasurementAppendSink(hist, ["name"], ["size"], "ts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r["size"], r["ts"].day) for r in spark.read.parquet(hist).collect())
    assert got == [(10, 1), (10, 2), (11, 2)]   # unchanged day-3 reading skipped; day 1 always kept


def test_counter_state_store_stream_equals_batch(spark, tmpdir_path):
    from fleetsight.streaming.micro_batch import counter_totals_stream

    ev, src = _split_events(spark, tmpdir_path)
    ev = ev.withColumn("v", (F.col("value") * 100).cast("bigint"))
    src2 = os.path.join(tmpdir_path, "src2")
    for i, p in enumerate(sorted(os.listdir(src))):
        spark.read.parquet(os.path.join(src, p)).withColumn("v", (F.col("value") * 100).cast("bigint")) \
            .coalesce(1).write.parquet(os.path.join(src2, f"p{i}"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src2, "*"))
    out = counter_totals_stream(stream, ["user_id", "event_type"], "ts", ["v"],
                                {"user_id": "bigint", "event_type": "string"}, tiebreak={"event_id": "bigint"})
    q = (out.writeStream.outputMode("update").format("memory").queryName("counter_totals")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck3")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    latest = spark.sql("SELECT user_id, event_type, max_by(total_v, last_reading_time) AS t FROM counter_totals "
                       "GROUP BY user_id, event_type")
    want = C.accumulate_log(ev.drop("value"), ["user_id", "event_type"], "ts", ["v"], ["event_id"])
    g = sorted((r["user_id"], r["event_type"], r["t"]) for r in latest.collect())
    w = sorted((r["user_id"], r["event_type"], r["total_v"]) for r in want.collect())
    assert g == w


def test_counter_sink_counts_late_readings(spark, tmpdir_path):
    import datetime as dt

    schema = "k string, ts timestamp_ntz, v bigint"
    batches = [[("a", dt.datetime(2024, 1, 1, 10), 5), ("a", dt.datetime(2024, 1, 1, 11), 8)],
               [("a", dt.datetime(2024, 1, 1, 9), 1), ("a", dt.datetime(2024, 1, 1, 12), 2)]]
    state = os.path.join(tmpdir_path, "st")
    sink = CounterStateSink(state, ["k"], "ts", ["v"])
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), i)
    r = spark.read.parquet(latest_version(spark, state)).first()
    # 5 -> 8 (+3) -> late 1 dropped -> 2 (reset, +2): 5 + 3 + 2
    assert (r["v"], r["total_v"], r["late_readings"]) == (2, 10, 1)


def test_same_time_with_newer_tiebreak_counts(spark, tmpdir_path):
    import datetime as dt

    schema = "k string, ts timestamp_ntz, id int, v decimal(10,2)"
    at = dt.datetime(2024, 1, 1, 10)
    from decimal import Decimal as D
    batches = [[("a", at, 1, D("10.00"))], [("a", at, 2, D("15.50")), ("a", at, 1, D("99.00"))], [("a", at, 3, None)]]
    state = os.path.join(tmpdir_path, "ties")
    sink = CounterStateSink(state, ["k"], "ts", ["v"], ["id"])
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), i)
    r = spark.read.parquet(latest_version(spark, state)).first()
    assert (r["total_v"], r["late_readings"], r["last_id"], r["v"]) == (D("15.50"), 1, 3, D("0.00"))


def test_decimal_counters_keep_their_fractions(spark, tmpdir_path):
    from decimal import Decimal as D

    from fleetsight.streaming.micro_batch import counter_totals_stream

    src = os.path.join(tmpdir_path, "dec")
    for i, rows in enumerate([[("a", "2024-01-01 10:00:00", D("1.50"))], [("a", "2024-01-01 11:00:00", D("2.25"))]]):
        (spark.createDataFrame(rows, "k string, t string, v decimal(10,2)")
         .select("k", F.col("t").cast("timestamp_ntz").alias("ts"), "v").coalesce(1).write.parquet(f"{src}/p{i}"))
    stream = (spark.readStream.schema("k string, ts timestamp_ntz, v decimal(10,2)").option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
    out = counter_totals_stream(stream, ["k"], "ts", ["v"], {"k": "string"}, counter_type="decimal(10,2)")
    q = (out.writeStream.outputMode("update").format("memory").queryName("decimal_totals")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckd")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.sql("SELECT max(total_v) AS t FROM decimal_totals").first()["t"] == D("2.25")


def test_merge_sink_starts_empty_and_keeps_one_history_row(spark, tmpdir_path):
    from fleetsight.streaming import SnapshotMergeSink

    schema = "server string, name string, size int"
    cur, hist = os.path.join(tmpdir_path, "c"), os.path.join(tmpdir_path, "h")
    sink = SnapshotMergeSink(cur, hist, ["server", "name"], source_col="server")
    for i, size in enumerate([1, 2, 1, 2]):
        sink(spark.createDataFrame([("s", "a", size)], schema), i)
    assert [r["size"] for r in spark.read.parquet(latest_version(spark, cur)).collect()] == [2]
    # 1 -> 2 -> 1 -> 2: the third change's pre-image (1) is in the history already
    assert sorted(r["size"] for r in spark.read.parquet(hist).collect()) == [1, 2]
