"""Readers for captured text, XML event files and counter CSV exports."""

import os

from fleetsight.operators import capacity as C
from fleetsight.operators import profile as G
from fleetsight.operators import snapshot as A
from fleetsight.sources.readers import read_captures, read_counter_csv, read_xml_events


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_capture_files(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "cap", "srv1.txt"),
           "Host Name:  SRV1\nOS Name:  Windows Server (2019)\nMemory:  1,024 MB\nMemory:  512 MB\n"
           "Hotfix(s):  KB1\nHotfix(s):  KB2\n\n")
    _write(os.path.join(tmpdir_path, "disk", "srv1.txt"),
           "junk line\nCaption  FreeSpace   Size\n\nC:       100         500\nD:       7           20\n")
    lines = read_captures(spark, os.path.join(tmpdir_path, "cap"))
    r = A.parse_key_value(lines, "source", keys={"Host Name": "host"}, sum_keys={"Memory": "mem"},
                          count_keys={"Hotfix(s)": "n_fix"}, paren_keys={"OS Name": "os"}).first()
    assert (r["host"], str(r["mem"]), r["n_fix"], r["os"]) == ("SRV1", "1536.00", 2, "2019")
    disks = A.parse_fixed_width(read_captures(spark, os.path.join(tmpdir_path, "disk")), "source",
                                ["Caption", "FreeSpace", "Size"], r"^Caption")
    assert sorted((x["Caption"], x["FreeSpace"], x["Size"]) for x in disks.collect()) == \
        [("C:", "100", "500"), ("D:", "7", "20")]


def test_xml_event_files(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "xe", "f1.xel.xml"),
           '<events><event name="x" timestamp="t1"><data name="duration"><value>5</value></data>'
           '<action name="client"><value>app</value></action></event>'
           '<event name="y" timestamp="t2"><data name="duration"><value>7</value></data></event></events>')
    ev = read_xml_events(spark, os.path.join(tmpdir_path, "xe"))
    out = G.event_attributes(ev, "event_xml", ["duration"], actions=["client"], fmt="xml").collect()
    assert sorted((r["duration"], r["action_client"]) for r in out) == [("5", "app"), ("7", None)]


def test_counter_csv(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "cd", "data.csv"),
           "counter_id,record_index,counter_date_time,counter_value\n1,1,2024-01-01 10:00:00.123xyz,5.5\n"
           "2,1,2024-01-01 10:00:00.123xyz,1\n")
    _write(os.path.join(tmpdir_path, "cdd", "details.csv"),
           "counter_id,machine_name,object_name,counter_name,instance_name\n1,\\\\SRV,Memory,Available MB,\n"
           "2,\\\\SRV,Processor,% Time,_Total\n")
    data, details = read_counter_csv(spark, os.path.join(tmpdir_path, "cd"), os.path.join(tmpdir_path, "cdd"))
    r = C.pivot_counters(data, details, ["Memory\\Available MB", "Processor\\% Time (_Total)"]).first()
    assert r["machine_name"] == "SRV"
    assert r["Memory\\Available MB"] == 5.5 and r["Processor\\% Time (_Total)"] == 1.0
    assert r["counter_time"] == "10:00:00.123"


def test_deadlock_report_kept_whole(spark):
    x = ('<event name="xml_deadlock_report"><data name="xml_report"><value><deadlock><victim-list>'
         '<victimProcess id="p1"/></victim-list></deadlock></value></data><data name="k"><value>3</value></data></event>')
    df = spark.createDataFrame([(1, x)], "event_id int, payload string")
    r = G.event_attributes(df, "payload", ["xml_report", "k"], fmt="xml").first()
    assert r["k"] == "3"
    assert r["xml_report"].startswith("<deadlock><victim-list>") and 'id="p1"' in r["xml_report"]
