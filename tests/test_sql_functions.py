"""The SQL functions give what the column functions give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetsight.functions import scalar as S
from fleetsight.functions.sql import FUNCTIONS, register_functions
from fleetsight.operators.reference import bitmask_names

NUMBERS = [None, 0, 1, 59, 60, 3599, 86399, 86400, 100000, 235959, 240000, 1000000, 9999999]
TEXTS = [None, "", "[a].[b]]", "C:\\data\\x.mdf", "\\\\host\\share\\f", "name", "a.b.c", "14.0.1", "10.50.1", "10.0.9",
         "9.x", "7", "13", "x.1"]


@pytest.mark.parametrize("name", ["fmt_seconds", "fmt_hhmmss"])
def test_times(spark, name):
    register_functions(spark)
    df = spark.createDataFrame([(n,) for n in NUMBERS], "v bigint")
    rows = df.select("v", F.expr(f"{name}(v)").alias("got"), getattr(S, name)("v").alias("want")).collect()
    assert [(r.v, r.got) for r in rows] == [(r.v, r.want) for r in rows]


@pytest.mark.parametrize("name", ["unquote_name", "file_name", "file_dir", "file_ext", "file_drive", "decode_version",
                                  "numeric_version"])
def test_texts(spark, name):
    register_functions(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    rows = df.select("v", F.expr(f"{name}(v)").alias("got"), getattr(S, name)("v").alias("want")).collect()
    assert [(r.v, r.got) for r in rows] == [(r.v, r.want) for r in rows]


def test_day_names(spark):
    assert set(register_functions(spark)) == set(FUNCTIONS)
    masks = spark.createDataFrame([(None,), *[(m,) for m in range(130)]], "mask bigint")
    want = {r.mask: r.day_list for r in bitmask_names(masks, "mask").collect()}
    got = spark.sql("SELECT m.mask, day_names(m.mask) AS one, d.day_list FROM {m} m, LATERAL day_names_list(m.mask) d",
                    m=masks)
    rows = got.collect()
    assert {r.mask: r.one for r in rows} == want and {r.mask: r.day_list for r in rows} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan          # the call becomes a projection
