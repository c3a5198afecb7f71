"""Join of two interval tables on overlap (D1), without comparing every pair.

Time is cut into bins on several levels, each ``FACTOR`` times as wide as the
one below. An interval's own level is the finest whose bins are at least as
wide as the interval, so it touches at most two bins there and on every wider
level. Two intervals meet on the wider of their two own levels, in the one bin
that holds the later of their starts: each pair is given exactly once, and an
interval takes a few rows however long it is. The meeting is an equality join
on (keys, level, bin); bins that are hot are split into slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.plans.strategies import broadcast_if_small

FACTOR = 8
LEVELS = 14             # 8^14 seconds: longer than any calendar
HOT_ROWS = 100_000      # rows of one side in one bin above which it is cut into slices


def _width(level: Column) -> Column:
    """Microseconds of a bin on a level."""
    return F.element_at(F.array(*[F.lit(1_000_000 * FACTOR ** k).cast("long") for k in range(LEVELS)]), level + 1)


def _own_level(length: Column) -> Column:
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(length <= 1_000_000 * FACTOR ** k, F.lit(k)).otherwise(level)
    return level


def _levels(df: DataFrame) -> list[int]:
    """Levels that occur (at most ``LEVELS`` numbers)."""
    return sorted(r[0] for r in df.select("lv").distinct().collect())


def _binned(df: DataFrame, others: list[int]) -> DataFrame:
    """One row per level on which an interval can meet one of the other side, and bin there."""
    # on its own level it meets intervals of finer or equal levels, on a wider level those of that level
    wider = F.filter(F.array(*[F.lit(o) for o in others]).cast("array<int>"), lambda k: k > F.col("lv"))
    level = F.when(F.col("lv") >= min(others, default=LEVELS), F.concat(F.array("lv"), wider)).otherwise(wider)
    at = df.withColumn("level", F.explode(level))
    width = _width(F.col("level"))
    return at.withColumn("bin", F.explode(F.sequence(
        F.call_function("floor", F.col("s") / width).cast("long"), F.call_function("floor", F.col("e") / width).cast("long"))))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                  keys: list[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every pair of overlapping intervals (closed on both ends) with equal ``keys``, once each.

    The sides must share no column names but the keys. Intervals with a NULL
    end, a NULL key or an end before their start overlap nothing.
    """
    keys = list(keys)

    def side(df, span, tag):
        start, end = _micros(df, span[0]), _micros(df, span[1])
        rest = [c for c in df.columns if c not in keys]
        # a column struct keeps every name of the input out of the way of the working columns
        out = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)],
                        F.struct(*[F.col(f"`{c}`") for c in rest]).alias(tag), start.alias("s"), end.alias("e"))
        return out.where("s <= e").withColumn("lv", _own_level(F.col("e") - F.col("s"))), rest

    lo, l_cols = side(left, left_span, "a")
    ro, r_cols = side(right, right_span, "b")
    l_levels, r_levels = _levels(lo), _levels(ro)
    lb, rb = _binned(lo, r_levels), _binned(ro, l_levels)
    on = [*[f"k{i}" for i in range(len(keys))], "level", "bin"]

    # a hot bin of the left side is cut into slices; the right side's rows of that bin go to each
    hot = lb.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(
        *on, F.ceil(F.col("n") / hot_rows).cast("int").alias("slices"))
    hot = broadcast_if_small(hot)
    lb = lb.join(hot, on, "left").withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(
        F.xxhash64("a"), F.col("slices")).cast("int")).otherwise(F.lit(0))).drop("slices")
    rb = rb.join(hot, on, "left").withColumn("slice", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0))))).drop("slices")
    rb = rb.withColumnsRenamed({"s": "rs", "e": "re", "lv": "rlv"})
    width = _width(F.col("level"))
    later = F.call_function("floor", F.greatest("s", "rs") / width).cast("long")
    pairs = lb.join(rb, [*on, "slice"]).where(
        (F.col("s") <= F.col("re")) & (F.col("rs") <= F.col("e"))
        & (F.col("level") == F.greatest("lv", "rlv")) & (F.col("bin") == later))
    return pairs.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
                        *[F.col(f"a.`{c}`") for c in l_cols], *[F.col(f"b.`{c}`") for c in r_cols])


def _micros(df: DataFrame, c: str) -> Column:
    """A point in time (or a number, in seconds) as whole microseconds."""
    kind = dict(df.dtypes)[c]
    if kind.startswith(("timestamp", "date")):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{c}` as timestamp_ntz))")
    return (F.col(f"`{c}`") * 1_000_000).cast("long")
