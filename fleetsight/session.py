"""Session construction and lineage cutting.

The library never starts a session on its own inside an operator; callers
(tests, bench, the entry module) use :func:`get_session`.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (sort-merge -> broadcast when a side turns out small), coalesces small
# shuffle partitions and splits skewed ones.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "fleetsight", extra: dict | None = None) -> SparkSession:
    """Session with the library defaults (AQE, skew splitting, UTC). On a
    cluster leave ``master`` unset; settings already fixed by the cluster
    (or an existing session) take precedence."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` (or a directory already set on the
    context). Only when neither is set - local tests - a fallback is used;
    on a cluster that must be a shared filesystem path, never a local one.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    if fallback is None:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            fallback = tempfile.mkdtemp(prefix="fleetsight-ckpt-")
        else:
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder")
    if fallback.startswith("/"):
        os.makedirs(fallback, exist_ok=True)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint): the data is written to
    the shared folder and the plan restarts from there. Under Spark Connect
    (no SparkContext on the client) the server's checkpoint setting is used.
    With ``drop_shuffles`` the shuffle files behind it go as soon as it is
    written, not when the driver next collects garbage.
    """
    try:
        sc_available = df.sparkSession.sparkContext is not None
    except Exception:  # noqa: BLE001 - Spark Connect session
        sc_available = False
    if sc_available:
        checkpoint_dir(df.sparkSession)
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    before = conf.get(_DROP_SHUFFLES, "false")
    conf.set(_DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)      # planned anew, with the setting
    finally:
        conf.set(_DROP_SHUFFLES, before)
