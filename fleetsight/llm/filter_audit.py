"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures are one bit mask. Everything the audit reports is a sum
over the documents of a part that have one of a few masks, so the table is
brought down to counts per (part, mask), which add up over tasks; all orders
and steps are then read off those counts.

The filter for repeated texts needs the smallest id of each text. A counting
Bloom sketch clears most unique texts first: tasks count the cells of their
text hashes, the sketches are merged shard by shard, and a text with a cell
that only one text reached is unique for certain. Only the others, the
possible repeats, are shuffled in full (copies within a task as one row) and
grouped by their text, so a hash that two texts share changes nothing. The
text with its smallest id then meets the flags by id and digest.

The sketch has about ``CELLS_PER_DOC`` cells a document up to ``max_shards``
shards (8 KB each when broadcast: 32 MB at most). Beyond that, more unique
texts pass as possible repeats; the results stay the same and at most every
text is shuffled once.

Defined results: a null text is empty (it fails on its length, and repeats
other empty texts); a null source is the part ''; a row without an id is no
repeat, makes none, and has no labels; rows that repeat an id are separate
documents with that id's labels, and none of the rows with the smallest id
of a text is a repeat; labels that repeat an id count if any does; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.session import cut_lineage

SPACE = "[\\x20\\x09-\\x0D]+"

CELLS = 1 << 16             # of a shard
CELLS_PER_DOC = 8
MIN_SHARDS, MAX_SHARDS = 64, 4096
PROBES = 3                  # cells of a text, all in one shard
FLUSH = 1 << 20             # cell numbers a task holds before it sums them up


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one text: name and condition of failure."""
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


REPEAT = "E"                # the filter for texts that a smaller id has


# --- counting Bloom sketch ------------------------------------------------------

def _shard(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 48), F.lit(shards)).cast("int")


def _sum_cells(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cell numbers with their counts, which stop at 2."""
    c, n = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    return c[at], np.minimum(np.add.reduceat(n, at), 2).astype(np.int64)


def _count_cells(shards: int):
    def task(batches):
        cells, counts, held = [], [], 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            base = (h >> np.uint64(48)) % np.uint64(shards) * np.uint64(CELLS)
            probes = [base + (h >> np.uint64(16 * p) & np.uint64(CELLS - 1)) for p in range(PROBES)]
            for k, p in enumerate(probes):          # a text counts once in a cell that two of its probes meet
                own = np.ones(len(h), bool)
                for q in probes[:k]:
                    own &= p != q
                cells.append(p[own].astype(np.int64))
                counts.append(np.ones(own.sum(), np.int64))
                held += len(cells[-1])
            if held > FLUSH:
                c, n = _sum_cells(cells, counts)
                cells, counts, held = [c], [n], 0
                if len(c) > FLUSH:
                    yield _sketch_rows(c, n)
                    cells, counts = [], []
        if any(map(len, cells)):
            yield _sketch_rows(*_sum_cells(cells, counts))

    return task


def _sketch_rows(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    shard = cells // CELLS
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(at[1:], len(cells))
    low = (cells % CELLS).astype("<u2")
    return pa.RecordBatch.from_arrays([
        pa.array(shard[at], pa.int32()), pa.array([low[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
        pa.array([counts[i:j].astype(np.uint8).tobytes() for i, j in zip(at, ends)], pa.binary())],
        ["shard", "cells", "counts"])


def _merge(batches):
    """Shards of this partition: cells that at least two texts reached, as 1,024 words of 64 bits."""
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            own = merged.setdefault(shard, np.zeros(CELLS, np.uint8))
            at = np.frombuffer(cells, "<u2")
            own[at] = np.minimum(own[at] + np.frombuffer(counts, np.uint8), 2)
    for shard, own in merged.items():
        bits = np.packbits(own >= 2, bitorder="little").view("<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([bits.tolist()], pa.list_(pa.int64()))], ["shard", "bits"])


def counting_sketch(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, bits) of a one-column table of 64-bit hashes."""
    parts = hashes.mapInArrow(_count_cells(shards), "shard int, cells binary, counts binary")
    return cut_lineage(parts.repartition("shard").mapInArrow(_merge, "shard int, bits array<long>"))


def shard_count(rows: int, max_shards: int = MAX_SHARDS) -> int:
    return max(1, min(max_shards, max(MIN_SHARDS, 1 << max(0, (rows * CELLS_PER_DOC // CELLS)).bit_length())))


def with_possible_repeat(df: DataFrame, sketch: DataFrame, shards: int) -> DataFrame:
    """``df`` (with a hash ``h``) with ``possible``: every cell of the hash has two texts. The sketch is bounded
    (``shards`` x 8 KB), so it is broadcast."""
    keyed = df.withColumn("shard", _shard(F.col("h"), shards)).join(F.broadcast(sketch), "shard", "left")
    hit = F.lit(True)
    for p in range(PROBES):
        cell = F.shiftrightunsigned(F.col("h"), 16 * p).bitwiseAND(F.lit(CELLS - 1)).cast("int")
        word = F.get(F.col("bits"), F.shiftright(cell, 6))
        hit = hit & (F.getbit(word, cell.bitwiseAND(F.lit(63))) == 1)
    return keyed.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("shard", "bits")


# --- masks and orders -------------------------------------------------------------

def mask_counts(docs: DataFrame, labels: DataFrame, max_shards: int = MAX_SHARDS) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of the mask."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    shards = shard_count(rows.count(), max_shards)
    sketch = counting_sketch(rows.select("h"), shards)

    checked = with_possible_repeat(rows, sketch, shards).withColumn(
        "words", F.array_remove(F.split("t", SPACE, -1), ""))
    tests = failures(F.col("t"), F.col("words"))
    mask = F.lit(0)
    for k, cond in enumerate(tests.values()):
        mask = mask + F.when(cond, 1 << k).otherwise(0)
    flags = cut_lineage(checked.select("id", "part", mask.alias("mask"), F.when(
        F.col("possible"), F.sha2(F.col("t").cast("binary"), 256)).alias("digest")))

    # exact smallest id of every possible repeat, by the full text
    first = with_possible_repeat(rows, sketch, shards).where("possible").groupBy("t").agg(F.min("id").alias("id"))
    first = first.select("id", F.sha2(F.col("t").cast("binary"), 256).alias("digest"), F.lit(True).alias("first"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    repeat = F.col("digest").isNotNull() & F.col("first").isNull()
    named = flags.where("id IS NOT NULL").join(first, ["id", "digest"], "left").join(marks, "id", "left").select(
        "part", (F.col("mask") + F.when(repeat, 1 << len(tests)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = flags.where("id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def all_orders(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order and step from mask counts (bit k of a mask: the k-th of ``names`` fails)."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # <= 2^k
    grid = parts.withColumn("filter_order", F.explode(F.array(
        *[F.lit("".join(p)) for p in permutations(names)]))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))

    def bit(place):
        letter = F.substr(F.col("filter_order"), place, F.lit(1))
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), letter) - 1)

    grid = grid.withColumns({"own": bit(F.col("step")), "before": F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda i: i < F.col("step")), F.lit(0),
        lambda acc, i: acc + bit(i))})

    def total(value, cond):
        return F.aggregate("m", F.lit(0).cast("long"), lambda acc, e: acc + F.when(
            cond(e["mask"]), value(e)).otherwise(F.lit(0).cast("long")))

    def reached(m):
        return m.bitwiseAND(F.col("before")) == 0

    def fails(m):
        return m.bitwiseAND(F.col("own")) != 0

    def n(e):
        return e["n"]

    # a filter removes a document in the orders that put it before the document's other failures: one in as
    # many as the document has failures
    every = factorial(len(names))
    return grid.select(
        "part", "filter_order", "step",
        total(n, lambda m: reached(m) & ~fails(m)).alias("kept"),
        total(n, lambda m: reached(m) & fails(m)).alias("removed"),
        total(n, lambda m: ~reached(m) & fails(m)).alias("redundant"),
        total(n, lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda e: e["good"], lambda m: reached(m) & fails(m)).alias("good_lost"),
        total(lambda e: e["toxic"], lambda m: reached(m) & fails(m)).alias("toxic_lost"),
        total(lambda e: F.call_function("div", e["n"] * F.lit(every), F.bit_count(e["mask"])), fails).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Documents kept, removed and lost at every step of every order of the five filters, per source."""
    return all_orders(mask_counts(docs, labels, max_shards), "ABCD" + REPEAT)
