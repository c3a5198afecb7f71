"""History laid out by key hash: same rows as the plain history, only the touched buckets read."""

import os

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import snapshot as A
from fleetsight.sources.bucketed import BucketedHistory
from fleetsight.streaming import MeasurementAppendSink, SnapshotMergeSink

ROWS = "k long, v string, t timestamp_ntz"


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string").withColumn(
        "t", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))


def sums(df):
    return df.withColumn("row_checksum", A.row_checksum(["v"]))


def as_set(df):
    return sorted(map(str, df.drop("row_checksum").collect()))


def test_only_touched_buckets_are_read(spark, tmpdir_path):
    store = BucketedHistory(spark, tmpdir_path, ["k"], 64)
    old = frame(spark, [(k, f"v{k % 3}") for k in range(2000)])
    store.write(sums(old), 1)
    run = frame(spark, [(5, "v2"), (6, "new"), (None, "v0")])
    touched = store.touched(run)
    assert 1 <= len(touched) <= 3 and sum(touched.values()) == 3
    past = store.read(2, touched)
    plan = past._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan")[1:] if "PartitionFilters" in x)
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0].split("bucket=")[1].split("/")[0] for r in past.select(F.input_file_name()).distinct().collect()}
    assert files <= {str(b) for b in touched} and past.count() < 200 < store.read(2).count()
    plain = A.append_history(sums(old), run, ["k"], ["v"])
    assert as_set(A.append_history_bucketed(store, run, 2, ["v"])) == as_set(plain)


def test_rerun_compaction_and_empty_runs(spark, tmpdir_path):
    store = BucketedHistory(spark, tmpdir_path, ["k"], 8)
    runs = [[(k, "a") for k in range(40)], [(k, "b") for k in range(0, 40, 2)], [], [(1, "a"), (1, "c"), (99, "a")]]
    got = {}
    for n, rows in enumerate(runs, 1):
        for _ in range(2):                                      # a rerun replaces its own version
            got[n] = as_set(A.append_history_bucketed(store, frame(spark, rows), n, ["v"]))
    assert [len(got[n]) for n in range(1, 5)] == [40, 20, 0, 2]
    everything = as_set(store.read())
    assert store.compact(4).endswith("compact=4") and store.compact(4) is None
    assert as_set(store.read()) == everything and as_set(store.read(below=2)) == got[1]
    assert as_set(A.append_history_bucketed(store, frame(spark, runs[3]), 4, ["v"])) == got[4]
    assert len(store.vacuum()) == 3 and as_set(store.read()) == everything
    assert as_set(A.append_history_bucketed(store, frame(spark, [(1, "c"), (7, "z")]), 5, ["v"])) == as_set(
        frame(spark, [(7, "z")]))


def test_layout_is_kept(spark, tmpdir_path):
    store = BucketedHistory(spark, tmpdir_path, ["k"], 8)
    store.write(sums(frame(spark, [(1, "a")])), 1)
    assert BucketedHistory(spark, tmpdir_path, ["k"], 99).buckets == 8
    with pytest.raises(ValueError):
        BucketedHistory(spark, tmpdir_path, ["v"])
    # an integer of another width is in the same bucket
    narrow = spark.createDataFrame([(1,)], "k int")
    assert store.touched(narrow).keys() == store.touched(frame(spark, [(1, "x")])).keys()


def test_process_snapshot_with_buckets(spark, tmpdir_path):
    schema = "server string, name string, size int"
    out = {}
    for buckets in (None, 4):
        base = os.path.join(tmpdir_path, str(buckets))
        args = dict(current_path=base + "/c", history_path=base + "/h", report_path=base + "/r",
                    keys=["server", "name"], checksum_cols=["size"], source_col="server", history_buckets=buckets)
        for n, rows in enumerate([[("s1", "a", 1), ("s1", "b", 2)], [("s1", "a", 5)], [("s1", "a", 1)], [("S1", "A", 7)]], 1):
            A.process_snapshot(spark, loading=spark.createDataFrame(rows, schema), version=n, **args)
        h = spark.read.parquet(base + "/h") if buckets is None else BucketedHistory(
            spark, base + "/h", ["server", "name"]).read()
        report = spark.read.parquet(base + "/r")
        out[buckets] = (sorted((r.name, r.size_, r.action) for r in h.withColumnRenamed("size", "size_").collect()),
                        sorted((r.name, r.previous_value, r.current_value) for r in report.collect()))
    assert out[None] == out[4] and ("A", "1", "7") in out[4][1]


def test_sinks_with_buckets_store_the_same_rows(spark, tmpdir_path):
    batches = [[(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")], [(1, "z"), (2, "b"), (3, "d")]]
    for make, read in (
            (lambda p, b: MeasurementAppendSink(p, ["k"], ["v"], "t", buckets=b), lambda p: p),
            (lambda p, b: SnapshotMergeSink(p + "/cur", p, ["k"], buckets=b), lambda p: p)):
        got = []
        for b in (None, 4):
            path = os.path.join(tmpdir_path, f"{make.__code__.co_firstlineno}-{make.__code__.co_names}-{b}")
            sink = make(path, b)
            for n, rows in enumerate(batches):
                sink(frame(spark, rows), n)
                sink(frame(spark, rows), n)                      # replayed batch
            h = (BucketedHistory(spark, path, ["k"], prefix="batch=").read() if b
                 else spark.read.parquet(*[f"{path}/batch={n}" for n in range(3)]))
            got.append(sorted((r.k, r.v) for r in h.collect()))
        assert got[0] == got[1] and got[0]


def test_merge_matches_sources_without_case(spark):
    cur = spark.createDataFrame([("SRV1", "a", 1)], "server string, name string, v int")
    none = cur.limit(0)
    mon = spark.createDataFrame([("srv1",)], "s string")
    for policy in ("unmonitored", "flag"):
        tagged = A.snapshot_merge(cur, none, ["server", "name"], monitored=mon, source_col="server", policy=policy)
        assert tagged.first()["action"] != "DELETE"
    other = spark.createDataFrame([("srv1", "b", 1)], cur.schema)
    acts = {r["name"]: r["action"] for r in A.snapshot_merge(cur, other, ["server", "name"], monitored=mon,
                                                             source_col="server").collect()}
    assert acts == {"a": "DELETE", "b": "INSERT"}
