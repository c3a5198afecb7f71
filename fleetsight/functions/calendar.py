"""Calendar and clock dimensions (B5), generated with sequence + explode.

Both are bounded by their arguments (one row per day / per step of a day),
so joining them to a fact table is a proven-small broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Working hours are 07:00 up to 19:00.
WORK_START_HOUR = 7
WORK_END_HOUR = 19


def sql_week_of_year(d: Column) -> Column:
    """Week number with weeks starting on Sunday and 1 January in week 1."""
    jan1 = F.make_date(F.year(d), F.lit(1), F.lit(1))
    return ((F.dayofyear(d) + F.dayofweek(jan1) - 2) / 7).cast("int") + 1


def date_attributes(d: Column, prefix: str = "") -> list[Column]:
    y = F.year(d)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return [
        F.date_format(d, "yyyy-MM-dd").alias(prefix + "date_string"),
        F.dayofweek(d).alias(prefix + "day_of_week"),
        F.date_format(d, "EEEE").alias(prefix + "day_of_week_name"),
        F.dayofmonth(d).alias(prefix + "day_of_month"),
        F.dayofyear(d).alias(prefix + "day_of_year"),
        sql_week_of_year(d).alias(prefix + "week_of_year"),
        F.date_format(d, "MMMM").alias(prefix + "month_name"),
        F.month(d).alias(prefix + "month_of_year"),
        F.quarter(d).alias(prefix + "calendar_quarter"),
        y.alias(prefix + "calendar_year"),
        F.dayofweek(d).isin(1, 7).alias(prefix + "is_weekend"),
        leap.alias(prefix + "is_leap_year"),
    ]


def calendar_dim(bounds: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """One row per day between each bounds row's start and end (inclusive).

    ``bounds`` is normally a one-row aggregate (min/max of a fact table's
    date), so the spine size is the number of days spanned.
    """
    days = bounds.select(F.explode(F.sequence(F.to_date(F.col(start_col)), F.to_date(F.col(end_col)),
                                              F.expr("INTERVAL 1 DAY"))).alias("full_date")).distinct()
    return days.select("full_date", *date_attributes(F.col("full_date")))


def calendar_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    bounds = spark.range(1).select(F.to_date(F.lit(start)).alias("s"), F.to_date(F.lit(end)).alias("e"))
    return calendar_dim(bounds, "s", "e")


def clock_dim(spark: SparkSession, step_seconds: int = 1) -> DataFrame:
    """One row per ``step_seconds`` of a day: second of day, text, parts, AM/PM, working hours."""
    n = 86400 // step_seconds
    s = (F.col("id") * step_seconds).cast("int")
    h = (s / 3600).cast("int")
    m = ((s / 60).cast("int") % 60)
    sec = s % 60
    return spark.range(n).select(
        s.alias("second_of_day"),
        F.format_string("%02d:%02d:%02d", h, m, sec).alias("full_time"),
        F.format_string("%02d:%02d", h, m).alias("hours_minutes"),
        h.alias("hour_of_day"), m.alias("minute"), sec.alias("second"),
        F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM")).alias("am_pm"),
        ((h >= WORK_START_HOUR) & (h < WORK_END_HOUR)).alias("is_working_hours"),
    )
