"""Join and window strategies that keep plans safe at scale.

* :func:`broadcast_if_small` - broadcast only behind Catalyst's size estimate;
  above it the side is left to the planner (sort-merge / shuffled hash join,
  which AQE may still turn into a broadcast from runtime statistics).
* one-row aggregates (grand totals, latest collection time) are attached
  with ``DataFrame.scalar()`` - a scalar subquery computed once - not joined.
* :func:`previous_in_order` - "previous row of the same key" (LAG) that does
  not send a hot key to a single task: rows are windowed per (key, time
  bucket) and the first row of each bucket takes the last row of the nearest
  earlier bucket from a small per-(key, bucket) summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan (no job runs) - the
    estimate Spark's own broadcast threshold uses. For file scans it is the
    size of the files read, scaled down by column pruning; filters and
    aggregates do not lower it without cost-based statistics, so it does not
    shrink below what the scan reads. Decompressed rows can take a few times
    the file size, which the small default limit (8 MB) allows for. None
    when not available (Spark Connect)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when Catalyst's size estimate bounds it (no job runs);
    otherwise the planner, and AQE from runtime sizes, chooses the join."""
    est = estimated_bytes(df)
    return F.broadcast(df) if est is not None and est <= max_bytes else df


PARTITION_BYTES = 8 * 1024 * 1024


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, as stored (no job runs). None when it reads something else, such as a
    checkpoint, which does not tell its own size."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        leaves = [leaves.apply(k) for k in range(leaves.size())]
        files = all(x.getClass().getSimpleName() == "LogicalRelation" for x in leaves)
        return sum(int(str(x.stats().sizeInBytes())) for x in leaves) if files else None
    except Exception:  # noqa: BLE001 - Spark Connect
        return None


def spread_by(df: DataFrame, keys: list[str], each: int = PARTITION_BYTES) -> DataFrame:
    """``df`` exchanged by ``keys`` into one partition per ``each`` bytes read, at least the session's number. AQE
    alone merges partitions to one per core or 64 MB of compressed shuffle, so what a task holds grows with the
    table until then; that is left for sources that do not tell their size."""
    cols, size = [F.col(f"`{k}`") for k in keys], input_bytes(df)
    if size is None:
        return df.repartition(*cols)
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each)), *cols)


def previous_in_order(df: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str],
                      bucket: Column, prefix: str = "prev_", keep_bucket_last: bool = False) -> DataFrame:
    """Add ``prefix + v`` = value of ``v`` in the previous row of the same key.

    Order is ``order_cols`` (unique within a key for a deterministic
    answer). ``bucket`` must be monotone in that order (e.g. the hour of the
    timestamp), so a key's rows fall into independent window partitions.
    The first row of a key gets NULLs.

    One sort per (key, bucket) gives the in-bucket previous row and the
    bucket's last row; the summary (one row per key and bucket, a hash
    aggregate on the already partitioned data) is windowed per key to carry
    the last row of the previous bucket. With ``keep_bucket_last`` the
    columns ``__bucket`` and ``__last_<v>`` stay in the output.
    """
    b = "__bucket"
    d = df.withColumn(b, bucket)
    w = Window.partitionBy(*keys, b).orderBy(*order_cols)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for v in value_cols:
        d = d.withColumn("__in_" + v, F.lag(v).over(w)).withColumn("__last_" + v, F.last(v).over(whole))
    d = d.withColumn("__first", F.row_number().over(w) == 1)

    summary = d.groupBy(*keys, b).agg(*[F.first("__last_" + v).alias("__last_" + v) for v in value_cols])
    sw = Window.partitionBy(*keys).orderBy(b)
    summary = summary.select(*keys, b, *[F.lag("__last_" + v).over(sw).alias("__carry_" + v) for v in value_cols])

    # NULL-safe equality: no null filter is inferred for one side only, so
    # both sides keep the same shuffle below the window and it is reused
    s = summary.select(*[F.col(c).alias("__s_" + c) for c in [*keys, b]],
                       *["__carry_" + v for v in value_cols])
    cond = [d[c].eqNullSafe(s["__s_" + c]) for c in [*keys, b]]
    out = d.join(s, cond, how="left").drop(*["__s_" + c for c in [*keys, b]])
    for v in value_cols:
        out = out.withColumn(prefix + v, F.when(F.col("__first"), F.col("__carry_" + v))
                             .otherwise(F.col("__in_" + v)))
    drop = ["__first", *["__carry_" + v for v in value_cols], *["__in_" + v for v in value_cols]]
    if not keep_bucket_last:
        drop += [b, *["__last_" + v for v in value_cols]]
    return out.drop(*drop)


def time_bucket(ts, seconds: int = 3600) -> Column:
    """Monotone bucket number of a timestamp (``seconds`` wide), independent
    of the session time zone for TIMESTAMP_NTZ."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(c) / seconds).cast("bigint")


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    rank_col: str = "rn") -> DataFrame:
    """Top-n rows per group via ``row_number() <= n``.

    Catalyst plans this with a partial WindowGroupLimit *before* the shuffle,
    so a hot group only ships n rows per input partition.
    """
    if not group_cols:
        # global top-n: partial top-k per partition (TakeOrderedAndProject),
        # then numbering of the n survivors only
        top = df.orderBy(*order).limit(n)
        return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str,
                 right_cols: list[str], bucket_width: int, out: str = "match") -> DataFrame:
    """For each left row, the first right row of the same key whose position
    is >= the left row's position (forward as-of join).

    Left and right rows are unioned and scanned per (key, position bucket) in
    descending position, keeping the last right row seen. A left row with no
    right row after it in its bucket takes the first right row of the nearest
    later bucket, found with a window over the small per-(key, bucket)
    summary. No pairs are generated, and a hot key is spread over its
    buckets. ``out`` is a struct of ``right_pos`` and ``right_cols``, NULL
    when there is none.
    """
    payload = F.struct(F.col(right_pos).alias(right_pos), *[F.col(c) for c in right_cols])
    lrow = F.struct(*[F.col(c) for c in left.columns])
    r = right.select(*keys, F.col(right_pos).alias("__pos"), F.lit(1).alias("__tag"), payload.alias("__pay"))
    r = r.withColumn("__row", F.lit(None).cast(left.select(lrow.alias("x")).schema["x"].dataType))
    l_ = left.select(*keys, F.col(left_pos).alias("__pos"), F.lit(0).alias("__tag"),
                     F.lit(None).cast(r.schema["__pay"].dataType).alias("__pay"), lrow.alias("__row"))
    u = r.unionByName(l_).withColumn("__b", F.floor(F.col("__pos") / bucket_width).cast("long"))
    w = (Window.partitionBy(*keys, "__b").orderBy(F.col("__pos").desc(), F.col("__tag").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # __nxt: nearest right row at or after this position within the bucket;
    # __bfirst: the bucket's first right row (same sort, no extra shuffle)
    u = (u.withColumn("__nxt", F.last("__pay", ignorenulls=True).over(w))
          .withColumn("__bfirst", F.last("__pay", ignorenulls=True).over(whole)))
    summary = u.groupBy(*keys, "__b").agg(F.first("__bfirst").alias("__first"))
    bw = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*[F.col(k).alias("__s_" + k) for k in keys], F.col("__b").alias("__s_b"),
                             F.last("__first", ignorenulls=True).over(bw).alias("__carry"))
    # NULL-safe keys keep both join sides on the same (reused) shuffle
    cond = [u[k].eqNullSafe(summary["__s_" + k]) for k in keys] + [u["__b"].eqNullSafe(summary["__s_b"])]
    res = u.filter(F.col("__tag") == 0).join(summary, cond, "left")
    return res.select("__row.*", F.coalesce(F.col("__nxt"), F.col("__carry")).alias(out))
