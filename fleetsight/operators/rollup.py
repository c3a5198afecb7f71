"""Roll-up states that add up (C8): kept per minute, merged per load, answered for any set of parts.

A state is the exact partial result of one minute (and key): number of
readings, and per measure the number of values, their decimal sum, minimum
and maximum. States of loads merge by adding, so a load is read once, late
readings are just another load, and a replayed load replaces its own states.
The ten calendar and clock parts all follow from the minute, so every
combination of parts is answered from the states, many combinations in one
pass with GROUPING SETS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.calendar import WORK_END_HOUR, WORK_START_HOUR
from fleetsight.operators.capacity import time_parts
from fleetsight.sources.versioned import read_below, write_version

MINUTE = "minute_start"


def _merge(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    aggs = [F.sum("n_readings").alias("n_readings")]
    for m in measures:
        aggs += [F.sum(f"n_{m}").alias(f"n_{m}"), F.sum(f"sum_{m}").cast("decimal(38,6)").alias(f"sum_{m}"),
                 F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}")]
    return df.groupBy(*keys).agg(*aggs)


def rollup_states(df: DataFrame, ts: str, measures: list[str], keys: list[str] = ()) -> DataFrame:
    """One state per (keys, minute). Sums are exact decimals with six places."""
    aggs = [F.count(F.lit(1)).alias("n_readings")]
    for m in measures:
        aggs += [F.count(m).alias(f"n_{m}"), F.sum(F.col(m).cast("decimal(28,6)")).cast("decimal(38,6)").alias(f"sum_{m}"),
                 F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    minute = F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz").alias(MINUTE)
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, minute).agg(*aggs)


def merge_states(states: DataFrame, measures: list[str], keys: list[str] = ()) -> DataFrame:
    """Add up the states of several loads (partial sums before the shuffle)."""
    return _merge(states, [*keys, MINUTE], measures)


class RollupStore:
    """States in Parquet, one folder per load, in the shared folder ``base``.

    A load that is repeated replaces its folder, so nothing counts twice;
    :meth:`compact` merges the loads so far into one folder of the last of them.
    """

    def __init__(self, spark: SparkSession, base: str, measures: list[str], keys: list[str] = ()):
        self.spark, self.base, self.measures, self.keys = spark, base.rstrip("/"), list(measures), list(keys)

    def load(self, df: DataFrame, ts: str, version: int) -> None:
        write_version(rollup_states(df, ts, self.measures, self.keys), f"{self.base}/loads", version)

    def _compacted(self) -> int | None:
        from fleetsight.sources.versioned import current_version
        return current_version(self.spark, f"{self.base}/merged")

    def states(self) -> DataFrame | None:
        """The merged states of all complete loads."""
        from fleetsight.sources.versioned import versions
        upto = self._compacted()
        parts = [] if upto is None else [f"{self.base}/merged/version={upto}"]
        parts += [f"{self.base}/loads/version={v}" for v in versions(self.spark, f"{self.base}/loads")
                  if upto is None or v > upto]
        if not parts:
            return None
        return merge_states(self.spark.read.parquet(*parts), self.measures, self.keys)

    def compact(self, upto: int) -> None:
        """Merge loads up to ``upto`` into one folder; those loads are final from then on."""
        done = self._compacted()
        later = read_below(self.spark, f"{self.base}/loads", upto + 1)
        if later is None or (done is not None and done >= upto):
            return
        if done is not None:
            from fleetsight.sources.versioned import versions
            paths = [f"{self.base}/merged/version={done}"] + [
                f"{self.base}/loads/version={v}" for v in versions(self.spark, f"{self.base}/loads") if done < v <= upto]
            later = self.spark.read.parquet(*paths)
        write_version(merge_states(later, self.measures, self.keys), f"{self.base}/merged", upto)


def rollup_from_states(states: DataFrame, measures: list[str], sets: list[list[str]], *, keys: list[str] = (),
                       date_from=None, date_before=None, working_hours: bool | None = None,
                       weekend: bool | None = None, min_measures: list[str] = ()) -> DataFrame:
    """Mean and max (min for ``min_measures``) for every set of parts of ``sets``, in one pass.

    ``part_set`` names the set a row belongs to; parts outside it are NULL.
    The range is [date_from, date_before) in whole minutes. The rows of one
    set equal :func:`fleetsight.operators.capacity.calendar_rollup` by it.
    """
    d, t = states, F.col(MINUTE)
    if date_from is not None:
        d = d.filter(t >= F.lit(date_from))
    if date_before is not None:
        d = d.filter(t < F.lit(date_before))
    h = F.hour(t)
    if working_hours is not None:
        inside = (h >= WORK_START_HOUR) & (h < WORK_END_HOUR)
        d = d.filter(inside if working_hours else ~inside)
    if weekend is not None:
        free = F.dayofweek(t).isin(1, 7)
        d = d.filter(free if weekend else ~free)
    parts = time_parts(t)
    unknown = {p for s in sets for p in s} - set(parts)
    if unknown:
        raise ValueError(f"no such parts: {sorted(unknown)}")
    used = [p for p in parts if any(p in s for s in sets)]
    d = d.select(*keys, *[parts[p].alias(p) for p in used], *[c for c in states.columns if c not in (*keys, MINUTE)])
    aggs = [F.sum("n_readings").cast("bigint").alias("n_readings")]
    for m in measures:
        low = m in min_measures
        aggs += [(F.sum(f"sum_{m}").cast("double") / F.nullif(F.sum(f"n_{m}"), F.lit(0))).alias(f"avg_{m}"),
                 (F.min(f"min_{m}") if low else F.max(f"max_{m}")).alias(f"{'min' if low else 'max'}_{m}")]
    # one bit per part that a set leaves out, first part highest (as GROUPING_ID counts them)
    ids = {sum(1 << (len(used) - 1 - i) for i, p in enumerate(used) if p not in s): ",".join(
        p for p in used if p in s) for s in sets}
    grouped = d.groupingSets([[*keys, *[p for p in used if p in s]] for s in sets], *keys, *used).agg(
        F.grouping_id().alias("__id"), *aggs)
    name = F.lit(None).cast("string")
    for gid, text in ids.items():
        name = F.when(F.col("__id") == gid, F.lit(text)).otherwise(name)
    return grouped.withColumn("part_set", name).drop("__id")
