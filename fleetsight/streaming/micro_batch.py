"""Structured Streaming forms of the stateful operators.

State lives in Parquet tables under a shared folder, one version per
micro-batch (``<path>/batch=<id>``). A batch reads the newest version below
its own id and writes its own, so a batch replayed after a failure rewrites
the same version from the same input (idempotent), and a lost executor only
costs recomputation. The stream's own checkpoint (``checkpointLocation``)
records which batches are done.

* :class:`CounterStateSink` - C9: cumulative counters over readings that
  arrive in any number of micro-batches give the same totals as the
  ordered log form over all readings at once.
* :class:`SnapshotMergeSink` - A1 + A2 per loaded snapshot.
* :class:`MeasurementAppendSink` - A6 per batch of measurements.
* :func:`counter_totals_stream` - C9 with Spark's keyed state store
  (``applyInPandasWithState``): only keys seen in a batch are touched.
* :func:`windowed_rollup` - C8 over event time with a watermark (an
  addition: the reference only rolls up stored data).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.checksum import row_checksum
from fleetsight.operators.capacity import counter_increment
from fleetsight.operators.snapshot import (append_history, append_history_bucketed, append_if_changed,
                                           append_if_changed_bucketed, merged_current, pre_images, snapshot_merge)
from fleetsight.plans.strategies import previous_in_order, time_bucket
from fleetsight.session import cut_lineage
from fleetsight.sources.bucketed import BucketedHistory
from fleetsight.sources.versioned import read_below


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    out = []
    for st in fs.listStatus(hpath):
        name = st.getPath().getName()
        if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> str | None:
    vs = [v for v in _versions(spark, path) if below is None or v < below]
    return os.path.join(path, f"batch={vs[-1]}") if vs else None


class CounterStateSink:
    """foreachBatch sink that keeps cumulative counter totals.

    State schema: keys, <counter> (last reading), total_<counter>,
    last_reading_time (and the tiebreak columns as ``last_<c>``),
    late_readings. Readings not newer than the state's last one by (time,
    tiebreak) are dropped, as a counter cannot go back in time, and counted
    in ``late_readings``. A NULL reading counts as 0.
    """

    def __init__(self, state_path: str, keys: list[str], ts: str, counters: list[str],
                 tiebreak: list[str] = ()):
        self.state_path, self.keys, self.ts, self.counters = state_path, keys, ts, counters
        self.tiebreak = list(tiebreak)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev_path = latest_version(spark, self.state_path, below=batch_id)
        order = [self.ts, *self.tiebreak]
        rows = batch.select(*self.keys, *order, *[F.coalesce(F.col(c), F.lit(0).cast(batch.schema[c].dataType)).alias(c)
                                                  for c in self.counters]).withColumn("__seed", F.lit(False))
        late = None
        if prev_path:
            state = spark.read.parquet(prev_path)
            seed = state.select(*self.keys, F.col("last_reading_time").alias(self.ts),
                                *[F.col("last_" + c).alias(c) for c in self.tiebreak],
                                *self.counters, F.lit(True).alias("__seed"))
            cutoff = state.select(*self.keys, F.struct(
                F.col("last_reading_time").alias(self.ts), *[F.col("last_" + c).alias(c) for c in self.tiebreak])
                .alias("__cut"))
            tagged = rows.join(cutoff, self.keys, "left").withColumn(
                "__late", F.coalesce(F.struct(*order) <= F.col("__cut"), F.lit(False)))
            # readings not newer than the state cannot be placed: dropped, and counted per key
            late = tagged.filter("__late").groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n_late"))
            rows = tagged.filter(~F.col("__late")).drop("__cut", "__late").unionByName(seed)
        else:
            state = None
        d = previous_in_order(rows, self.keys, order, self.counters, time_bucket(self.ts),
                              prefix="__prev_", keep_bucket_last=True)
        d = d.filter(~F.col("__seed"))
        aggs = []
        for c in self.counters:
            aggs.append(F.sum(counter_increment(F.col("__prev_" + c), F.col(c))).alias("__inc_" + c))
            aggs.append(F.max_by(F.col("__last_" + c), F.col("__bucket")).alias("__new_" + c))
        inc = d.groupBy(*self.keys).agg(*aggs, F.max(F.struct(*order)).alias("__last")).select(
            "*", F.col("__last")[self.ts].alias("__lt"),
            *[F.col("__last")[c].alias("__lt_" + c) for c in self.tiebreak])
        if state is not None:
            j = state.join(inc, self.keys, "full_outer").join(late, self.keys, "left")
        else:
            j = inc.withColumn("last_reading_time", F.lit(None).cast(batch.schema[self.ts].dataType)) \
                   .withColumn("late_readings", F.lit(0).cast("bigint")).withColumn("__n_late", F.lit(0)) \
                   .withColumns({"last_" + c: F.lit(None).cast(batch.schema[c].dataType) for c in self.tiebreak})
            for c in self.counters:
                j = j.withColumn(c, F.lit(None).cast(batch.schema[c].dataType)) \
                     .withColumn("total_" + c, F.lit(None).cast(batch.schema[c].dataType))
        cols = list(self.keys)
        for c in self.counters:
            has = F.col("__lt").isNotNull()
            cols.append(F.when(has, F.col("__new_" + c)).otherwise(F.col(c)).alias(c))
            cols.append((F.coalesce(F.col("total_" + c), F.lit(0)) + F.coalesce(F.col("__inc_" + c), F.lit(0)))
                        .alias("total_" + c))
        cols.append(F.coalesce(F.col("__lt"), F.col("last_reading_time")).alias("last_reading_time"))
        cols += [F.when(F.col("__lt").isNotNull(), F.col("__lt_" + c)).otherwise(F.col("last_" + c)).alias("last_" + c)
                 for c in self.tiebreak]
        cols.append((F.coalesce(F.col("late_readings"), F.lit(0)) + F.coalesce(F.col("__n_late"), F.lit(0)))
                    .cast("bigint").alias("late_readings"))
        j.select(*cols).write.mode("overwrite").parquet(os.path.join(self.state_path, f"batch={batch_id}"))


class SnapshotMergeSink:
    """foreachBatch sink: each micro-batch is one loaded snapshot, merged into
    the current state (A1, empty at first unless ``initial`` is given) with
    its pre-images appended to history (A2: by key and checksum of
    ``checksum_cols``, all columns but the keys by default). With
    ``buckets`` the history is laid out by key hash and a batch reads only
    the buckets of its own keys."""

    def __init__(self, current_path: str, history_path: str, keys: list[str], initial: DataFrame | None = None,
                 checksum_cols: list[str] | None = None, buckets: int | None = None, **merge_args):
        self.current_path, self.history_path, self.keys = current_path, history_path, keys
        self.initial, self.checksum_cols, self.merge_args = initial, checksum_cols, merge_args
        self.buckets = buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = latest_version(spark, self.current_path, below=batch_id)
        current = spark.read.parquet(prev) if prev else self.initial if self.initial is not None else batch.limit(0)
        # both outputs read the merge: it is cut into the shared checkpoint folder
        tagged = cut_lineage(snapshot_merge(current, batch, self.keys, **self.merge_args))
        pre = pre_images(tagged)
        sums = self.checksum_cols or [c for c in batch.columns if c not in self.keys]
        if self.buckets:
            store = BucketedHistory(spark, self.history_path, self.keys, self.buckets, "batch=")
            append_history_bucketed(store, pre, batch_id, sums)
        else:
            history = read_below(spark, self.history_path, batch_id, "batch=")
            new = (pre.withColumn("row_checksum", row_checksum(sums)) if history is None
                   else append_history(history, pre, self.keys, sums))
            new.write.mode("overwrite").parquet(os.path.join(self.history_path, f"batch={batch_id}"))
        merged_current(tagged).write.mode("overwrite").parquet(os.path.join(self.current_path, f"batch={batch_id}"))


class MeasurementAppendSink:
    """foreachBatch sink for A6: each micro-batch of measurements is appended
    to the history (one partition per batch) unless a stored measurement of
    the same key has the same values - except on day 1 of a month. A batch
    compares with the partitions of earlier batches only, so a replayed batch
    rewrites its own partition identically. With ``buckets`` the history is
    laid out by key hash and a batch reads only the buckets of its own keys."""

    def __init__(self, history_path: str, keys: list[str], cols: list[str], ts: str, buckets: int | None = None):
        self.history_path, self.keys, self.cols, self.ts, self.buckets = history_path, keys, cols, ts, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*self.keys, *self.cols, self.ts)
        if self.buckets:
            store = BucketedHistory(spark, self.history_path, self.keys, self.buckets, "batch=")
            append_if_changed_bucketed(store, rows.dropDuplicates(), batch_id, self.cols, self.ts)
            return
        hist = read_below(spark, self.history_path, batch_id, "batch=")
        new = rows if hist is None else append_if_changed(hist, rows, self.keys, self.cols, self.ts)
        # measurements of one batch repeating each other are stored once; the batch's folder is replaced whole
        new.dropDuplicates([*self.keys, *self.cols, self.ts]).write.mode("overwrite").parquet(
            os.path.join(self.history_path, f"batch={batch_id}"))


def windowed_rollup(stream: DataFrame, ts: str, measures: list[str], window: str = "1 hour",
                    watermark: str = "2 hours", keys: list[str] = ()) -> DataFrame:
    """C8 on a stream: mean and max per event-time window (and keys); rows
    later than the watermark are dropped by Spark's state store."""
    if dict(stream.dtypes).get(ts) == "timestamp_ntz":
        # watermarks need TIMESTAMP; with a UTC session the wall-clock value is unchanged
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    w = stream.withWatermark(ts, watermark)
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias("avg_" + m), F.max(m).alias("max_" + m)]
    return w.groupBy(F.window(ts, window).alias("window"), *keys).agg(*aggs, F.count(F.lit(1)).alias("n_readings"))


def counter_totals_stream(stream: DataFrame, keys: list[str], ts: str, counters: list[str],
                          key_types: dict[str, str], counter_type: str = "bigint",
                          tiebreak: dict[str, str] | None = None) -> DataFrame:
    """C9 on a stream with Spark's keyed state store (``applyInPandasWithState``).

    State per key: last reading time and tiebreak values (``tiebreak``: column
    to type), last value and running total of each counter, all in
    ``counter_type``. Each micro-batch's readings of a key are sorted by time
    (one key's readings in one batch: bounded), readings not newer than the
    state are dropped, NULL readings count as 0, and the updated totals are
    emitted (output mode "update").
    Unlike :class:`CounterStateSink`, only the keys seen in a batch are
    touched, and the state is checkpointed incrementally with the stream.
    """
    from decimal import Decimal

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    key_schema = ", ".join(f"{k} {key_types[k]}" for k in keys)
    out_schema = (f"{key_schema}, " + ", ".join(f"{c} {counter_type}, total_{c} {counter_type}" for c in counters)
                  + ", last_reading_time timestamp_ntz, late_readings bigint")
    tie = dict(tiebreak or {})
    state_schema = ", ".join(["last_ts timestamp_ntz, late bigint", *[f"tie_{c} {k}" for c, k in tie.items()],
                              *[f"last_{c} {counter_type}, total_{c} {counter_type}" for c in counters]])
    # whole numbers and doubles as numpy arrays, decimals as Python decimals: nothing is cut
    kind = "int64" if counter_type in ("bigint", "int", "long") else "float64" if counter_type == "double" else object
    zero = Decimal(0) if kind is object else 0

    def update(key, pdfs, state):
        if state.exists:
            st = state.get
            last_ts, late, ties = st[0], st[1], list(st[2:2 + len(tie)])
            last = {c: st[2 + len(tie) + 2 * i] for i, c in enumerate(counters)}
            total = {c: st[3 + len(tie) + 2 * i] for i, c in enumerate(counters)}
        else:
            last_ts, late, ties = None, 0, [None] * len(tie)
            last, total = {c: None for c in counters}, {c: zero for c in counters}
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values([ts, *tie], kind="stable")
        if last_ts is not None:
            # newer by (time, tiebreak)
            fresh, same = pdf[ts] > pd.Timestamp(last_ts), pdf[ts] == pd.Timestamp(last_ts)
            for c, v in zip(tie, ties):
                fresh, same = fresh | (same & (pdf[c] > v)), same & (pdf[c] == v)
            late += int((~fresh).sum())          # readings older than the state are dropped and counted
            pdf = pdf[fresh]
        for c in counters:
            v = np.asarray([zero if pd.isna(x) else x for x in pdf[c]], dtype=kind)
            if len(v) == 0:
                continue
            # increments over the sorted readings, vectorised: a lower reading is a reset
            prev = np.concatenate([[v[0] if last[c] is None else last[c]], v[:-1]])
            inc = np.where(prev > v, v, v - prev)
            if last[c] is None:
                inc[0] = v[0]
            total[c] += inc.sum() if kind is object else inc.sum().item()
            last[c] = v[-1] if kind is object else v[-1].item()
        if len(pdf):
            last_ts = pdf[ts].max().to_pydatetime()
            ties = [pdf[c].iloc[-1].item() if hasattr(pdf[c].iloc[-1], "item") else pdf[c].iloc[-1] for c in tie]
        state.update(tuple([last_ts, late, *ties] + [x for c in counters for x in (last[c], total[c])]))
        row = dict(zip(keys, key))
        for c in counters:
            row[c], row["total_" + c] = last[c], total[c]
        row["last_reading_time"] = last_ts
        row["late_readings"] = late
        yield pd.DataFrame([row])

    return stream.groupBy(*keys).applyInPandasWithState(
        update, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout)
