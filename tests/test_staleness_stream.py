"""The stream form of stale sources against the batch form, with silent sources and a restart."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fleetsight.operators import snapshot as A
from fleetsight.streaming import stale_sources_stream

SCHEMA = "source string, ts timestamp"
DAY = dt.datetime(2024, 1, 10)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


LOADS = [
    [("a", at(0)), ("b", at(0.5)), ("c", at(1)), ("d", at(1))],
    [("a", at(2)), ("c", at(3.6)), ("a", at(1.5)), (None, at(3.9))],
    [("a", at(5)), ("b", at(4.9)), ("x", at(5))],              # b was silent from 0.5 on, d still is
    [("a", at(9)), ("c", at(8.5)), ("b", at(6))],
]


def run(spark, src, ck, name, **args):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (stale_sources_stream(stream, "source", "ts", 3.0, **args).writeStream.outputMode("append")
         .format("parquet").option("path", ck + "-out").option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    assert q.awaitTermination(300)
    out = spark.read.schema("source string, last_data_collection timestamp, change string").parquet(ck + "-out")
    return sorted((r.source, r.last_data_collection, r.change) for r in out.collect())


def write(spark, src, k):
    spark.createDataFrame(LOADS[k], SCHEMA).coalesce(1).write.parquet(os.path.join(src, f"load{k}"))


def test_stream_equals_batch_and_survives_a_restart(spark, tmpdir_path):
    src, ck = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "ck")
    for k in (0, 1):
        write(spark, src, k)
    run(spark, src, ck, "silence")
    for k in (2, 3):
        write(spark, src, k)
    rows = run(spark, src, ck, "silence")                       # goes on from its checkpoint, repeats nothing
    assert len(rows) == len(set(rows))
    state = {}
    for source, last, change in sorted(rows, key=lambda r: (r[0], r[1], r[2] == "stale")):
        state[source] = (last, change)
    events = spark.createDataFrame([r for load in LOADS for r in load if r[0]], "source string, ts timestamp_ntz")
    batch = A.stale_sources(events, "source", "ts", F.lit("2024-01-10 09:00:00").cast("timestamp_ntz"), 3.0)
    want = {r["source"]: r["last_data_collection"] for r in batch.collect()}
    assert {s: t for s, (t, c) in state.items() if c == "stale"} == want
    assert ("b", at(0.5), "stale") in rows and ("b", at(4.9), "resumed") in rows


def test_a_monitored_source_that_never_sends_is_reported(spark, tmpdir_path):
    src, ck = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "ck")
    for k in range(len(LOADS)):
        write(spark, src, k)
    mon = spark.createDataFrame([("a",), ("d",), ("never",), ("never",)], "machine string")
    rows = run(spark, src, ck, "watched", monitored=mon, since=at(0.25))
    assert {r[:3] for r in rows if r[0] == "never"} == {("never", at(0.25), "stale")}
    assert {r[0] for r in rows} <= {"a", "d", "never"} and ("d", at(1), "stale") in rows
