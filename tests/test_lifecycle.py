"""Snapshot lifecycle on versioned Parquet: merge, history, report, rerun."""

import os

from fleetsight.operators.snapshot import process_snapshot
from fleetsight.sources.versioned import read_current, versions

SCHEMA = "server string, name string, size int"


def test_process_snapshot_versions_and_rerun(spark, tmpdir_path):
    cur, hist, rep = (os.path.join(tmpdir_path, x) for x in ("current", "history", "report"))
    args = dict(current_path=cur, history_path=hist, report_path=rep, keys=["server", "name"],
                checksum_cols=["size"], source_col="server")
    load1 = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2)], SCHEMA)
    assert process_snapshot(spark, loading=load1, version=1, **args)["status"] == "merged"
    load2 = spark.createDataFrame([("s1", "a", 5)], SCHEMA)
    process_snapshot(spark, loading=load2, version=2, **args)
    process_snapshot(spark, loading=load2, version=2, **args)          # rerun of the same version
    assert versions(spark, cur) == [1, 2]
    assert sorted(map(tuple, read_current(spark, cur).collect())) == [("s1", "a", 5)]
    h = spark.read.parquet(hist)
    assert sorted((r["name"], r["size"], r["action"]) for r in h.collect()) == [("a", 1, "UPDATE"), ("b", 2, "DELETE")]
    r = spark.read.parquet(rep)
    assert [(x["name"], x["previous_value"], x["current_value"]) for x in r.collect()] == [("a", "1", "5")]
    empty = spark.createDataFrame([], SCHEMA)
    assert process_snapshot(spark, loading=empty, version=3, **args)["status"] == "empty load"


def test_duplicate_keys_are_refused(spark, tmpdir_path):
    import pytest

    from fleetsight.operators.snapshot import duplicate_keys
    load = spark.createDataFrame([("s1", "a", 1), ("s1", "a", 2), ("s1", None, 3)], SCHEMA)
    assert sorted((r["name"], r["n_rows"]) for r in duplicate_keys(load, ["server", "name"]).collect()
                  if r["name"]) == [("a", 2)]
    with pytest.raises(ValueError):
        process_snapshot(spark, current_path=os.path.join(tmpdir_path, "c"), history_path=os.path.join(tmpdir_path, "h"),
                         report_path=os.path.join(tmpdir_path, "r"), loading=load, keys=["server", "name"],
                         checksum_cols=["size"], version=1)
