"""Property tests with small random inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetsight.operators import capacity as C
from fleetsight.operators import compliance as E
from fleetsight.operators import profile as G
from fleetsight.operators import snapshot as A

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _total_by_python(readings):
    total, last = 0, None
    for v in readings:
        total += v if last is None or last > v else v - last
        last = v
    return total


@SETTINGS
@given(st.lists(st.integers(0, 50), min_size=1, max_size=12), st.integers(0, 11))
def test_counter_split_anywhere_equals_whole(spark, readings, cut):
    cut = min(cut, len(readings))
    rows = [("k", T0 + dt.timedelta(minutes=37 * i), v) for i, v in enumerate(readings)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, v bigint")
    whole = C.accumulate_log(df, ["key"], "ts", ["v"]).first()["total_v"]
    assert whole == _total_by_python(readings)
    if cut == 0:
        return
    first = spark.createDataFrame(rows[:cut], "key string, ts timestamp_ntz, v bigint")
    state = C.accumulate_log(first, ["key"], "ts", ["v"]).select("key", "v", "total_v")
    for _, _, v in rows[cut:]:
        state = C.accumulate_counters(state, spark.createDataFrame([("k", v)], "key string, v bigint"), ["key"], ["v"])
    assert state.first()["total_v"] == whole


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=8,
                unique_by=lambda x: x[0]),
       st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=8,
                unique_by=lambda x: x[0]))
def test_change_report_empty_iff_same(spark, before, after):
    b = spark.createDataFrame(before, "k int, v int")
    a = spark.createDataFrame(after, "k int, v int")
    rep = A.change_report(b, a, ["k"]).collect()
    common = {k for k, _ in before} & {k for k, _ in after}
    bd, ad = dict(before), dict(after)
    changed = {k for k in common if bd[k] != ad[k]}
    assert {r["k"] for r in rep} == changed


@SETTINGS
@given(st.lists(st.sampled_from([".bak", ".trn", ".diff", ".txt"]), min_size=1, max_size=12), st.integers(1, 4))
def test_retention_never_expires_newest_n(spark, exts, n):
    names = [f"db_{i:02d}_x{ext}" for i, ext in enumerate(exts)]
    df = spark.createDataFrame([("db", i + 1, nm) for i, nm in enumerate(names)], "db string, id int, file_name string")
    out = {r["id"] for r in E.retention_expired(df, key=["db"], file_id="id", file_name="file_name",
                                                prefix=F.substring_index("file_name", "_", 2), keep_n=n).collect()}
    fulls = [i + 1 for i, e in enumerate(exts) if e == ".bak"]
    kept = sorted(fulls)[-n:] if len(fulls) >= n else []
    assert not out & set(kept)
    if len(fulls) < n:
        assert out == set()
    else:
        assert out == {i + 1 for i, e in enumerate(exts) if e != ".txt" and i + 1 < kept[0]}


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)), st.one_of(st.none(), st.text(max_size=5))),
                min_size=0, max_size=10))
def test_null_profile_adds_up(spark, rows):
    df = spark.createDataFrame(rows, "a bigint, b string")
    for r in G.null_profile(df).collect():
        assert r["null_rows"] + r["not_null_rows"] == len(rows)
