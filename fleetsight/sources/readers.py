"""Readers for the reference's non-tabular inputs.

* captured command output (one text file per source) -> lines
* XML event files -> one row per event with the raw XML payload
* CSV exports of performance counters (counter data / details)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.operators.snapshot import capture_lines
from fleetsight.sources.schemas import schema


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` is one capture: (source, line_no, line).
    ``wholetext`` keeps a file in one row (captures are small); files are
    spread over tasks."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value"))
    return capture_lines(raw, "source", "value")


def read_xml_events(spark: SparkSession, path: str, row_tag: str = "event") -> DataFrame:
    """XML event files -> (source, event_xml): each <event> element kept
    whole as text (deadlock reports stay intact), parsed later with xpath."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    pattern = rf"(?s)(<{row_tag}[\s>].*?</{row_tag}>)"
    return raw.select("source", F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("event_xml"))


def read_counter_csv(spark: SparkSession, data_path: str, details_path: str) -> tuple[DataFrame, DataFrame]:
    """Counter exports with declared schemas (no inference pass)."""
    data = spark.read.schema(schema("counter_data")).option("header", True).csv(data_path)
    details = spark.read.schema(schema("counter_details")).option("header", True).csv(details_path)
    return data, details
