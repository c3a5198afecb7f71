"""Sketches, roll-up states, interval joins and events of unknown shape against brute force and golden cases."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetsight.functions.sketches import column_sketches, error_bound, merge_sketches, sketched_selectivity
from fleetsight.operators import capacity as C
from fleetsight.operators import profile as G
from fleetsight.operators import workload as W
from fleetsight.operators.intervals import interval_join
from fleetsight.operators.rollup import RollupStore, rollup_from_states


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sketches ---------------------------------------------------------------

def test_sketches_of_parts_merge_to_the_whole(spark):
    df = spark.range(60_000).select(
        "id", (F.col("id") % 7000).alias("g"), F.when(F.col("id") % 2 == 0, (F.col("id") % 3).cast("string")).alias("t"),
        (F.col("id") % 3).alias("load"))
    cols = ["id", "g", "t"]
    parts = [column_sketches(df.where(F.col("load") == k), cols) for k in range(3)]
    merged = {r["column_name"]: r for r in sketched_selectivity(merge_sketches(*parts)).collect()}
    by = {r["column_name"]: r for r in sketched_selectivity(merge_sketches(column_sketches(df, cols, by=["load"]))).collect()}
    for name, true in (("id", 60_000), ("g", 7000), ("t", 3)):
        assert abs(merged[name]["n_distinct"] - true) <= max(1, error_bound() * true)
        assert merged[name]["n_distinct"] == by[name]["n_distinct"] and merged[name]["n_rows"] == 60_000
    assert merged["t"]["n_not_null"] == 30_000


def test_sketches_take_one_pass(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("g"))
    text = plan_of(column_sketches(df, ["id", "g"]))
    assert "Expand" not in text and text.count("Range (") == 1


def test_key_candidates_only_count_what_may_be_unique(spark):
    df = spark.range(5000).select("id", (F.col("id") % 4000).alias("close"), (F.col("id") % 9).alias("few"),
                                  F.when(F.col("id") != 7, F.col("id")).alias("holed"),
                                  F.when(F.col("id") == 4999, 0).otherwise(F.col("id")).alias("once"))
    out = G.key_candidates({"t": (df, ["few", "holed", "close", "once", "id"], None), "e": (df.limit(0), ["id"], None),
                            "n": (df, ["few"], None)})
    assert {r["table_name"]: r["key_column"] for r in out.collect()} == {"t": "id", "e": "id", "n": None}
    assert plan_of(G.key_candidates({"n": (df, ["few", "holed"], None)})).count("Range (") == 1   # nothing counted
    kept = merge_sketches(column_sketches(df, ["id", "few"]))
    again = G.key_candidates({"t": (df, ["few", "id"], None)}, sketches={"t": kept})
    assert again.first()["key_column"] == "id"


def test_density_of_another_table_is_refused(spark):
    details = spark.createDataFrame([(1, 5)], "item_id int, impact int")
    cols = spark.createDataFrame([(1, 3, "a", "EQUALITY")], "item_id int, object_id int, column_name string, usage string")
    sel = spark.createDataFrame([("a", 0.5)], "column_name string, density double")
    with pytest.raises(ValueError):
        W.rank_missing_index(details, cols, sel)


def test_duplicate_signatures_need_the_same_order(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a"), (3, 5, "a"), (3, 9, "b"), (4, 1, "a"), (4, 2, "a"), (5, 1, None)]
    df = spark.createDataFrame(rows, "item int, pos int, col string").withColumn("db", F.lit(None).cast("string"))
    got = W.duplicate_signatures(df, ["item"], "col", "pos").collect()
    assert sorted((r["key_list"], r["item"], r["n_duplicates"]) for r in got) == [("a,b", 1, 2), ("a,b", 3, 2)]


# --- roll-up states -----------------------------------------------------------

def readings(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v decimal(10,2)")


def test_rollup_states_after_replay_late_data_and_compaction(spark, tmpdir_path):
    from decimal import Decimal as D
    r = random.Random(4)
    start = dt.datetime(2024, 2, 27)
    rows = [(r.choice(["a", "b", None]), start + dt.timedelta(seconds=r.randint(0, 5 * 86400)),
             r.choice([None, D(r.randint(-500, 500)) / 100])) for _ in range(600)]
    loads = [rows[:250], rows[250:400], rows[400:]]                 # later loads hold readings of earlier times
    store = RollupStore(spark, os.path.join(tmpdir_path, "s"), ["v"], ["k"])
    for n, load in enumerate(loads, 1):
        store.load(readings(spark, load), "ts", n)
        store.load(readings(spark, load), "ts", n)
        if n == 2:
            store.compact(2)
            store.compact(2)
    sets = [["day"], ["hour", "am_pm"], ["minute"], [], ["year", "quarter", "month", "week", "day_of_month", "day_of_week"]]
    got = rollup_from_states(store.states(), ["v"], sets, keys=["k"], min_measures=[]).collect()
    whole = readings(spark, rows)
    for s in sets:
        if s:
            want = C.calendar_rollup(whole, "ts", ["v"], s, extra_keys=["k"])
            cols = ["k", *s, "avg_v", "max_v", "n_readings"]
            name = ",".join(p for p in ("year", "quarter", "month", "week", "day", "day_of_month", "day_of_week", "am_pm",
                                        "hour", "minute") if p in s)
            assert sorted(str([x[c] for c in cols]) for x in got if x["part_set"] == name) == sorted(
                str([x[c] for c in cols]) for x in want.collect())
    assert sum(x["n_readings"] for x in got if x["part_set"] == "") == 600
    part = rollup_from_states(store.states(), ["v"], [["hour"]], working_hours=True, weekend=False, min_measures=["v"],
                              date_from=start + dt.timedelta(days=1), date_before=start + dt.timedelta(days=3))
    want = C.calendar_rollup(whole.where((F.col("ts") < F.lit(start + dt.timedelta(days=3)).cast("timestamp_ntz"))), "ts", ["v"],
                             ["hour"], working_hours=True, weekend=False, min_measures=["v"],
                             date_from=F.lit(start + dt.timedelta(days=1)).cast("timestamp_ntz"))
    cols = ["hour", "avg_v", "min_v", "n_readings"]
    assert sorted(map(str, part.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    with pytest.raises(ValueError):
        rollup_from_states(store.states(), ["v"], [["decade"]])


# --- interval join ----------------------------------------------------------------

@pytest.mark.parametrize("hot", [100_000, 3])
def test_interval_join_matches_brute_force(spark, hot):
    r = random.Random(hot)
    base = dt.datetime(2024, 1, 1)

    def spans(n, tag):
        out = []
        for i in range(n):
            s = base + dt.timedelta(seconds=r.randint(-4000, 4000), microseconds=r.choice([0, 1, 999_999]))
            length = r.choice([0, 1, 7, 8, 64, 3600, 86400 * 400, -5])
            out.append((r.choice(["x", "y", None]), f"{tag}{i}", r.choice([s, s, s, None]), s + dt.timedelta(seconds=length)))
        return out

    left, right = spans(60, "l") + spans(1, "same") * 2, spans(50, "r")
    lf = spark.createDataFrame(left, "k string, a string, ls timestamp_ntz, le timestamp_ntz").withColumn("level", F.lit(1))
    rf = spark.createDataFrame(right, "k string, b string, rs timestamp_ntz, re timestamp_ntz").withColumn("s", F.lit(1))

    def pairs(keyed):
        return sorted((x[1], y[1]) for x in left for y in right if None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3]
                      and (not keyed or (x[0] == y[0] and x[0])) and x[2] <= y[3] and y[2] <= x[3])

    keyed = interval_join(lf, rf, ("ls", "le"), ("rs", "re"), ["k"], hot)
    assert sorted((x["a"], x["b"]) for x in keyed.collect()) == pairs(True)
    free = interval_join(lf, rf.drop("k"), ("ls", "le"), ("rs", "re"), hot_rows=hot)
    assert sorted((x["a"], x["b"]) for x in free.collect()) == pairs(False)
    assert "NestedLoop" not in plan_of(free) and "Cartesian" not in plan_of(free)
    assert interval_join(lf.limit(0), rf, ("ls", "le"), ("rs", "re"), ["k"]).collect() == []


def test_long_intervals_take_few_rows(spark):
    from fleetsight.operators import intervals
    df = spark.createDataFrame([(0, 10 ** 15)], "s long, e long").withColumn("lv", intervals._own_level(F.col("e") - F.col("s")))
    assert intervals._binned(df, list(range(intervals.LEVELS))).count() <= 2 * intervals.LEVELS


# --- events -----------------------------------------------------------------------

DEADLOCK = ('<event name="xml_deadlock_report" timestamp="2024-01-01T00:00:00Z"><data name="xml_report"><value>'
            '<deadlock><victim-list><victimProcess id="p1"/></victim-list>\n <process id="p1">UPDATE t</process></deadlock>'
            '</value></data><action name="db"><value>sales</value></action></event>')
REPORT = DEADLOCK[DEADLOCK.index("<deadlock>"):DEADLOCK.index("</value></data>")]
PLAIN = ('<event name="rpc" timestamp="2024-01-01T00:00:01Z"><data name="cpu"><value>5</value></data>'
         '<data name="plan"><value>x</value></data></event>')


def test_deadlock_reports_are_kept_whole(spark):
    ev = spark.createDataFrame([(1, DEADLOCK), (2, PLAIN), (3, None)], "event_id int, x string")
    rows = {r["event_id"]: r for r in G.event_attributes(ev, "x", ["xml_report", "cpu", "plan"], ["db"], "xml",
                                                         xml_events=["rpc"]).collect()}
    assert rows[1]["xml_report"] == REPORT and rows[1]["cpu"] is None and rows[1]["action_db"] == "sales"
    assert rows[2]["plan"] == PLAIN and rows[2]["xml_report"] is None
    values = {(r["event_id"], r["attribute"]): r["value"] for r in G.event_values(ev, "x", ["event_id"], "xml").collect()}
    assert values == {(1, "xml_report"): REPORT, (1, "db"): "sales", (2, "cpu"): "5", (2, "plan"): "x"}
    wide = G.found_event_attributes(ev, "x", fmt="xml")
    assert {"xml_report", "cpu", "plan", "action_db", "event_name", "event_time"} <= set(wide.columns)


def test_json_events_of_unknown_shape(spark):
    docs = ['{"name":"n1","timestamp":"t1","data":{"a":1,"b":"x y","c":{"d":[1,2]}},"actions":{"u":"me"}}',
            '{"name":"n2","data":{"odd.name":true}}', '{"k":7,"name":"field"}', "not json", "[1,2]", "{}", None,
            '{"data":5}']
    ev = spark.createDataFrame(list(enumerate(docs)), "event_id int, j string").withColumn("key", F.lit(0))
    got = {(r["event_id"], r["event_name"], r["part"], r["attribute"], r["value"])
           for r in G.event_values(ev, "j", ["event_id"]).collect()}
    assert got == {(0, "n1", "data", "a", "1"), (0, "n1", "data", "b", "x y"), (0, "n1", "data", "c", '{"d":[1,2]}'),
                   (0, "n1", "action", "u", "me"), (1, "n2", "data", "odd.name", "true"),
                   (2, None, "data", "k", "7"), (2, None, "data", "name", "field"), (7, None, "data", "data", "5")}
    wide = G.event_attributes(ev, "j", ["a", "odd.name"], ["u"])
    assert {(r["event_id"], r["event_name"], r["a"], r["odd.name"], r["action_u"]) for r in wide.where("event_id < 2").collect()} \
        == {(0, "n1", "1", None, "me"), (1, "n2", None, "true", None)}
    with pytest.raises(ValueError):
        G.found_attributes(G.event_values(ev, "j", ["event_id"]), most=2)


def test_preview_name_is_like_without_case(spark):
    t = spark.range(1)
    tables = {"Sales[1]": t, "sales1": t, "other": t}
    assert {r["table_name"] for r in G.preview(tables, "sales[1]").collect()} == {"Sales[1]"}
    assert {r["table_name"] for r in G.preview(tables, "SALES%").collect()} == {"Sales[1]", "sales1"}


# --- search index --------------------------------------------------------------------

def test_indexed_search_finds_what_the_scan_finds(spark, tmpdir_path):
    from fleetsight.sources.trigrams import TrigramIndex
    r = random.Random(12)
    words = ["select", "UPDATE", "Straße", "İstanbul", "日本語", "a_b", "100%", "x", "\\", "😀😀😀", "tab\tle"]
    rows = [(k, r.choice([None, "", "ab"]) if k % 17 == 0 else " ".join(r.choices(words, k=r.randint(1, 12)))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, body string")
    index = TrigramIndex(spark, tmpdir_path, 16, 16)
    index.add("doc", df.where("id < 200"), "id", "body", 1)
    index.add("doc", df, "id", "body", 2)
    index.add("doc", df, "id", "body", 2)                         # a rerun
    index.add("other", df.where("id < 9").withColumn("body", F.lit("only UPDATE here")), "id", "body", 3)
    assert index.texts.read().count() == sum(t is not None for _, t in rows) + 9
    sources = {"doc": (df, "id", "body"), "other": (df.where("id < 9").withColumn("body", F.lit("only UPDATE here")), "id", "body")}
    for pattern in ["update", "straße", "istanbul", "日本語", "a_b", "0% x", "tab\tle", "😀😀😀", "zzz", "only update here", "\\ x", "x", ""]:
        want = sorted(map(tuple, G.search_text(sources, pattern).collect()))
        assert sorted(map(tuple, G.search_indexed(index, pattern).collect())) == want, pattern
    few = index.candidates("only update")
    assert few.count() == 9 and len(index.texts.touched(few)) < 16
    plan = plan_of(index.read("only update"))
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert G.search_indexed(TrigramIndex(spark, tmpdir_path + "/none"), "abc").collect() == []
