"""Search index over texts: postings of 3-character runs.

Two tables in the shared folder, both laid out by key hash
(:class:`fleetsight.sources.bucketed.BucketedHistory`): ``texts`` by (kind,
id), ``grams`` by the 3-character run: a row holds the ids of some of the
texts that have it, so that a task's texts give one row a run. A load adds the
texts that are not there yet and the postings of those only. A search reads the buckets of the
runs of its pattern, keeps the texts that have all of them, reads the buckets
of those texts, and verifies each with the search itself: a text that matches
has every run of the pattern, so no hit is lost. Runs are taken from the
lower-cased text by character, which is what ILIKE compares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm.ship import ship_package
from fleetsight.sources.bucketed import BucketedHistory

RUN = 3
PIECES = 8          # tasks that write one bucket of postings, so a frequent run is not one task
RUNS_HELD = 1 << 21  # runs of texts that are grouped at a time


def runs(text: Column) -> Column:
    """The different runs of ``RUN`` characters of a text, in one pass over its characters."""
    chars = F.split(F.lower(text), "", -1)
    # the characters are bound once by the outer transform, so the text is split once
    joined = F.get(F.transform(F.array(chars), lambda cs: F.transform(cs, lambda c, i: F.concat(
        c, *[F.get(cs, i + k) for k in range(1, RUN)]))), F.lit(0))
    return F.filter(F.array_distinct(F.array_compact(joined)), lambda r: F.length(r) == RUN)


def _text_runs(text: bytes) -> np.ndarray:
    """The different runs of a lower-cased text, 21 bits a character."""
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) >= RUN else np.zeros(0, np.int64)


def _postings(batches):
    """(gram, object_ids) of (id, lower-cased text): some texts at a time, one row a run."""
    def grouped(ids, found):
        size = [len(f) for f in found]
        run, owner = np.concatenate(found), np.repeat(np.arange(len(ids), dtype=np.int32), size)
        by = np.argsort(run, kind="stable")
        run, owner = run[by], owner[by]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        chars = np.stack([(run[first] >> shift) & 0x1FFFFF for shift in (42, 21, 0)], 1).astype("<u4").tobytes().decode(
            "utf-32-le", "surrogatepass")
        grams = [chars[k:k + RUN] for k in range(0, len(chars), RUN)]
        some = max(1, 65536 // max(1, len(ids)))           # rows of many ids in small batches
        ends = np.append(first, len(run))
        texts = pa.array(ids, pa.string())
        for k in range(0, len(grams), some):
            e = ends[k:k + some + 1]
            lists = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), texts.take(pa.array(owner[e[0]:e[-1]])))
            yield pa.RecordBatch.from_arrays([pa.array(grams[k:k + some], pa.string()), lists], ["gram", "object_ids"])

    ids, found, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            f = _text_runs(t.as_py())
            if not len(f):
                continue
            ids.append(i.as_py())
            found.append(f)
            held += len(f)
            if held >= RUNS_HELD:
                yield from grouped(ids, found)
                ids, found, held = [], [], 0
    if ids:
        yield from grouped(ids, found)


class TrigramIndex:
    """``kind`` tells sources apart (documents, pages, ...); ids are kept as text."""

    def __init__(self, spark: SparkSession, base: str, text_buckets: int = 64, gram_buckets: int = 256):
        self.spark = spark
        self.texts = BucketedHistory(spark, f"{base.rstrip('/')}/texts", ["kind", "object_id"], text_buckets)
        self.grams = BucketedHistory(spark, f"{base.rstrip('/')}/grams", ["gram"], gram_buckets)

    def add(self, kind: str, df: DataFrame, id_col: str, text_col: str, version: int) -> None:
        """Index the rows of ``df`` whose id is new, as one version (a rerun replaces it). NULL texts and ids are
        never found and not stored."""
        rows = df.select(F.lit(kind).alias("kind"), F.col(f"`{id_col}`").cast("string").alias("object_id"),
                         F.col(f"`{text_col}`").cast("string").alias("text")).where(
            F.col("object_id").isNotNull() & F.col("text").isNotNull())
        new = self.texts.append_new(rows, version, ["kind", "object_id"])
        ship_package(self.spark)
        posted = new.select("object_id", F.lower("text").cast("binary")).mapInArrow(
            _postings, "gram string, object_ids array<string>").withColumn("kind", F.lit(kind))
        piece = F.pmod(F.xxhash64(F.col("object_ids")[0]), F.lit(PIECES))
        self.grams.write(posted.repartition(self.grams.bucket(), piece).sortWithinPartitions("gram"), version)

    def candidates(self, pattern: str) -> DataFrame | None:
        """(kind, object_id) of the texts that have every run of the pattern; None when it is too short for one."""
        wanted = self.spark.range(1).select(F.explode(runs(F.lit(pattern))).alias("gram"))
        grams = [r[0] for r in wanted.collect()]
        if not grams:
            return None
        posted = self.grams.read(touched=self.grams.touched(wanted))
        empty = self.spark.createDataFrame([], "kind string, object_id string")
        if posted is None:
            return empty
        return posted.where(F.col("gram").isin(grams)).select(
            "gram", "kind", F.explode("object_ids").alias("object_id")).groupBy("kind", "object_id").agg(
            F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("kind", "object_id")

    def read(self, pattern: str) -> DataFrame | None:
        """(kind, object_id, text) of the candidates, from the buckets they lie in; of all texts for a pattern
        without runs. None when nothing is indexed."""
        some = self.candidates(pattern)
        if some is None:
            return self.texts.read()
        some = some.persist()
        touched = self.texts.touched(some)                # at most as many numbers as buckets
        past = self.texts.read(touched=touched)
        return past if past is None else past.join(some, ["kind", "object_id"], "left_semi")
