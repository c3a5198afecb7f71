"""Golden cases for the scalar expressions."""

from pyspark.sql import functions as F

from fleetsight.functions import scalar as X
from fleetsight.functions.calendar import calendar_range, clock_dim
from fleetsight.operators.reference import bitmask_names


def one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_fmt_seconds(spark):
    cases = {0: "00:00:00", 59: "00:00:59", 3600: "01:00:00", 86399: "23:59:59", 86400: "1.00:00:00",
             90061: "1.01:01:01", None: None}
    for v, want in cases.items():
        assert one(spark, X.fmt_seconds, v, "bigint") == want, v


def test_fmt_hhmmss(spark):
    cases = {5: "00:00:05", 130500: "13:05:00", 250000: "1.01:00:00", None: "-"}
    for v, want in cases.items():
        assert one(spark, X.fmt_hhmmss, v, "int") == want, v


def test_paths(spark):
    rows = [("C:\\data\\db1.mdf",), ("db1.mdf",), ("C:\\data\\",), ("\\\\srv\\share\\x.bak",), ("E:\\logs\\file",)]
    df = spark.createDataFrame(rows, "p string").select(
        "p", X.file_name("p").alias("n"), X.file_dir("p").alias("d"), X.file_ext("p").alias("e"),
        X.file_drive("p").alias("v"))
    got = {r["p"]: (r["n"], r["d"], r["e"], r["v"]) for r in df.collect()}
    assert got["C:\\data\\db1.mdf"] == ("db1.mdf", "C:\\data\\", ".mdf", "C:")
    assert got["db1.mdf"] == ("db1.mdf", "\\", ".mdf", "\\")
    assert got["C:\\data\\"] == ("", "C:\\data\\", "", "C:")
    assert got["\\\\srv\\share\\x.bak"] == ("x.bak", "\\\\srv\\share\\", ".bak", "\\")
    assert got["E:\\logs\\file"] == ("file", "E:\\logs\\", "", "E:")


def test_versions(spark):
    cases = {"10.50.1600.1": ("SQL Server 2008 R2", "10.5"), "10.0.1": ("SQL Server 2008", "10.0"),
             "9.00": ("SQL Server 2005", "9.0"), "7.0.623": ("SQL 7 or earlier", "7.0"), None: (None, None)}
    for v, (name, num) in cases.items():
        assert one(spark, X.decode_version, v, "string") == name
        got = one(spark, X.numeric_version, v, "string")
        assert (str(got) if got is not None else None) == num


def test_misc(spark):
    assert one(spark, X.unquote_name, "[dbo].[t]", "string") == "dbo.t"
    assert one(spark, X.hex_text, bytearray(b"\x01\xab"), "binary") == "0x01AB"
    assert str(one(spark, lambda c: X.space_mb(c, F.lit(8060)), 1000000, "bigint")) == "7686.61"
    assert one(spark, X.split_instance_machine, "HOST\\INST", "string") == "HOST"
    assert one(spark, X.split_instance_name, "HOST", "string") == "default"


def test_bitmask_names(spark):
    df = spark.createDataFrame([(0,), (1,), (127,), (62,)], "m int")
    got = {r["m"]: r["day_list"] for r in bitmask_names(df, "m").collect()}
    assert got[0] == "None"
    assert got[1] == "Sunday"
    assert got[127] == "Sunday, Monday, Tuesday, Wednesday, Thursday, Friday, Saturday"
    assert got[62] == "Monday, Tuesday, Wednesday, Thursday, Friday"


def test_calendar_and_clock(spark):
    cal = {r["full_date"].isoformat(): r for r in calendar_range(spark, "2023-12-30", "2024-01-02").collect()}
    assert len(cal) == 4
    d = cal["2024-01-01"]
    assert (d["day_of_week"], d["day_of_week_name"], d["week_of_year"], d["is_weekend"], d["is_leap_year"]) == \
        (2, "Monday", 1, False, True)
    assert cal["2023-12-30"]["is_weekend"] and cal["2023-12-30"]["week_of_year"] == 52
    clock = clock_dim(spark, 60)
    assert clock.count() == 1440
    r = clock.filter("second_of_day = 7 * 3600").first()
    assert (r["full_time"], r["am_pm"], r["is_working_hours"]) == ("07:00:00", "AM", True)
    assert not clock.filter("second_of_day = 19 * 3600").first()["is_working_hours"]


def test_time_texts(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 14, 7, 31),)], "t timestamp_ntz")
    r = df.select(X.now_text("t").alias("n"), X.to_utc_minute(F.col("t"), "Europe/Madrid").alias("u")).first()
    assert r["n"] == "20240305140731"
    assert str(r["u"]).startswith("2024-03-05 13:08")      # UTC+1 in March, rounded to the minute


def test_yes_no_and_ladders(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r["y"] for r in df.select(X.yes_no("f").alias("y")).collect()] == ["Yes", "No", None]


def test_declared_schemas_parse(spark):
    from fleetsight.sources.schemas import SCHEMAS, schema
    for name in SCHEMAS:
        st = schema(name)
        assert len(st.fields) > 1
        spark.createDataFrame([], st)          # usable as a reader / empty-frame schema


def test_ratio_half_up_is_exact(spark):
    rows = [(12345, 100000), (19974999, 1000000), (-5, 100), (1, 3), (2, 0), (21447992400, 1073741824)]
    df = spark.createDataFrame(rows, "n bigint, d bigint")
    got = [r[0] for r in df.select(X.ratio_half_up("n", "d", 2, "decimal(20,2)")).collect()]
    assert [str(x) if x is not None else None for x in got] == ["0.12", "19.97", "-0.05", "0.33", None, "19.97"]
