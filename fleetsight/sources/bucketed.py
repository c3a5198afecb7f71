"""Append-only history laid out by key hash.

``<base>/version=<n>/bucket=<b>/`` holds the rows that run n added, by
bucket, the hash of their key modulo the number of buckets. A run knows the
keys it is about to add, so it reads only the folders of their buckets:
partition pruning takes the rest out of the scan, however long the history
has grown. The layout (keys and number of buckets) is fixed by the first
write and read back by later runs.

Versions follow the rules of :mod:`fleetsight.sources.versioned`: a version
counts when its folder is complete, a run for version n reads what is below n
and replaces only its own folder. :meth:`BucketedHistory.compact` rewrites
all versions below n into one folder ``compact=<n>`` with few files a bucket;
the versions it covers stay readable for a rerun until :meth:`vacuum`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.sources.versioned import _fs, versions

BUCKET = "bucket"
PIECES = 8              # tasks that write one bucket when compacting, so a hot key is not one task
FEW_ROWS = 200_000      # rows of one run, keys and checksum only, that are broadcast


class BucketedHistory:
    def __init__(self, spark: SparkSession, base: str, keys: list[str], buckets: int = 256, prefix: str = "version="):
        self.spark, self.base, self.prefix = spark, base.rstrip("/"), prefix
        layout = self._layout()
        if layout is not None and layout[0] != list(keys):
            raise ValueError(f"{base} is laid out by {layout[0]}, not by {list(keys)}")
        self.keys, self.buckets = list(keys), buckets if layout is None else layout[1]

    def _layout(self) -> tuple[list[str], int] | None:
        _, path, fs = _fs(self.spark, f"{self.base}/_layout/_SUCCESS")
        if not fs.exists(path):
            return None
        row = self.spark.read.json(f"{self.base}/_layout").first()
        return list(row["keys"]), row["buckets"]

    def bucket(self) -> Column:
        """The bucket of a row, from the text of its keys (so equal keys of two integer types meet)."""
        parts = [p for k in self.keys for p in (F.col(f"`{k}`").cast("string"), F.col(f"`{k}`").isNull())]
        return F.pmod(F.xxhash64(*parts), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> dict[int, int]:
        """Buckets of ``rows`` and how many rows each takes: at most ``buckets`` numbers."""
        return {r[0]: r[1] for r in rows.groupBy(self.bucket().alias(BUCKET)).agg(F.count(F.lit(1))).collect()}

    def folders(self, below: int | None = None) -> list[str]:
        """The folders that make up the history below a version: the newest compacted one and what came after."""
        done = [c for c in versions(self.spark, self.base, "compact=") if below is None or c <= below]
        start = done[-1] if done else None
        later = [v for v in versions(self.spark, self.base, self.prefix)
                 if (below is None or v < below) and (start is None or v >= start)]
        return ([f"{self.base}/compact={start}"] if done else []) + [f"{self.base}/{self.prefix}{v}" for v in later]

    def read(self, below: int | None = None, touched=None) -> DataFrame | None:
        """Rows below a version, of the ``touched`` buckets only when given; None when there is no history."""
        return self._rows(self.folders(below), touched)

    def _rows(self, folders: list[str], touched=None) -> DataFrame | None:
        """The rows of complete folders, with one scan for all versions and one for the compacted folder."""
        full = [f for f in folders if self._has_buckets(f)]
        scans = [[f for f in full if "/compact=" in f], [f for f in full if "/compact=" not in f]]
        parts = []
        for paths in filter(None, scans):
            part = self.spark.read.option("basePath", self.base).parquet(*paths)
            if touched is not None:
                part = part.where(F.col(BUCKET).isin(sorted(touched)))
            parts.append(part.drop(BUCKET, paths[0].rsplit("/", 1)[1].split("=")[0]))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def _has_buckets(self, folder: str) -> bool:
        """A version without rows has none."""
        _, path, fs = _fs(self.spark, folder)
        return any(s.getPath().getName().startswith(f"{BUCKET}=") for s in fs.listStatus(path))

    def write(self, rows: DataFrame, version: int) -> str:
        """Write ``rows`` as one version (a rerun replaces it)."""
        if self._layout() is None:
            self.spark.createDataFrame([(self.keys, self.buckets)], "keys array<string>, buckets int").coalesce(
                1).write.mode("overwrite").json(f"{self.base}/_layout")
        path = f"{self.base}/{self.prefix}{version}"
        rows.withColumn(BUCKET, self.bucket()).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        return path

    def append_new(self, rows: DataFrame, version: int, on: list[str], always: Column | None = None) -> DataFrame:
        """Write the ``rows`` that the history below ``version`` does not have (equal in ``on``, which holds the
        keys; rows for which ``always`` is true are written in any case) and return them as stored.

        The history is read once, in the buckets touched, and reduced to the values of this run before the
        anti join, so its shuffle is no larger than the run.
        """
        buckets = self.touched(rows)
        past = self.read(version, buckets) if buckets else None
        if past is not None:
            mine = rows.select(*on).distinct()
            if sum(buckets.values()) <= FEW_ROWS:
                mine = F.broadcast(mine)
            known = past.select(*on).join(mine, on, "left_semi").distinct()
            if always is None:
                rows = rows.join(known, on, "left_anti")
            else:
                keep = F.coalesce(always, F.lit(False))
                rows = rows.where(keep).unionByName(rows.where(~keep).join(known, on, "left_anti"))
        path = self.write(rows, version)
        back = self._rows([path])
        return rows.limit(0) if back is None else back

    def compact(self, below: int) -> str | None:
        """Rewrite all versions below ``below`` into one folder, a few files a bucket."""
        folders = self.folders(below)
        rows = self._rows(folders)
        if rows is None or folders == [f"{self.base}/compact={below}"]:
            return None
        path = f"{self.base}/compact={below}"
        piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(PIECES))
        (rows.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET), piece)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(path))
        return path

    def vacuum(self) -> list[str]:
        """Delete what the newest compacted folder covers; versions below it can then not be rerun."""
        done = versions(self.spark, self.base, "compact=")
        if not done:
            return []
        gone = [f"{self.base}/{self.prefix}{v}" for v in versions(self.spark, self.base, self.prefix) if v < done[-1]]
        gone += [f"{self.base}/compact={c}" for c in done[:-1]]
        for g in gone:
            _, path, fs = _fs(self.spark, g)
            fs.delete(path, True)
        return gone
