"""SimHash near-dedup: tiled exact comparison by exclusive-or and bit counts.

Fingerprints are made in the scan's own stage. Equal fingerprints become one
class before anything is compared. Two fingerprints that differ in at most d
bits agree in at least one of d + 1 fixed blocks of bits, so the classes
that share a block's value form a tile row, and only those are compared: a
tile row of more than ``tile`` classes is cut into chunks and every pair of
chunks is a task's cell. Inside a cell the classes are sorted by population
count and cut into small tiles; a pair of tiles whose population counts
differ by more than d is skipped, the others are compared as whole arrays.

A cell returns a spanning forest of its links, never the pairs themselves,
so its output is at most its number of rows.

Defined results: a null text, an empty one and one of white space only have
fingerprint zero and link like any other; repeated rows and ids give
repeated rows; null ids are never a component's id unless all its ids are
null; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetsight.llm.components import components, local_roots
from fleetsight.session import cut_lineage

BITS = 64
SHINGLE = 3
RADIUS = 2
TILE = 4096
_SUB = 256                    # classes of a small tile inside a cell
_SHINGLES = 1 << 16           # hashes whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set when over half of the shingle hashes (repeats included) have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SHINGLES):
        part = hashes[at:at + _SHINGLES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return src.mapInArrow(run, StructType([src.schema["doc_id"], StructField("fp", LongType())]))


def _compare(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of places) of a cell. ``side``: 0 and 1 are compared with each other, 2 with all of its
    own kind. Tiles whose population counts are too far apart are skipped."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop, side = fps[order], pop[order].astype(np.int64), side[order]
    left, right = [], []
    for a in range(0, len(fps), _SUB):
        a_end = min(a + _SUB, len(fps))
        for b in range(a, len(fps), _SUB):
            if pop[b] - pop[a_end - 1] > radius:
                break
            b_end = min(b + _SUB, len(fps))
            near = np.bitwise_count(fps[a:a_end, None] ^ fps[None, b:b_end]) <= radius
            i, j = np.nonzero(near)
            keep = (i + a < j + b) & ((side[i + a] == 2) | (side[i + a] != side[j + b]))
            left.append(i[keep] + a)
            right.append(j[keep] + b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """Links inside many small groups at once: place k of each group against place k + s."""
    left, right = [], []
    at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes)]) if len(starts) else np.zeros(0, np.int64)
    room = np.repeat(starts + sizes, sizes) if len(starts) else at
    step = 1
    while len(at):
        on = at + step < room
        at, room = at[on], room[on]
        hit = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        left.append(at[hit])
        right.append(at[hit] + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning forest (u, v) of the links between distinct fingerprints ``classes`` (fp)."""
    width = -(-BITS // (radius + 1))
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND(
        F.lit((1 << min(width, BITS - k * width)) - 1)).alias("value")) for k in range(radius + 1)])
    rows = classes.select("fp", F.explode(blocks).alias("b")).select("fp", "b.block", "b.value")
    size = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    cells = (rows.join(size, ["block", "value"])
             .withColumn("k", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
             .withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("k")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("block", "value", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"),
                     F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0)
                     .otherwise(1).cast("int").alias("side"), "fp"))
    keys = ["block", "value", "x", "y"]
    ordered = cells.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def forest(table: pa.Table):
        fps = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        side = table["side"].to_numpy()
        cols = [table[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
        sizes = np.diff(np.append(new, len(fps)))
        small = sizes <= 32                    # cells (x, x) hold side 2 only; so do groups of one chunk
        small &= side[new] == 2
        i, j = _small_groups(fps, new[small], sizes[small], radius)
        left, right = [i], [j]
        for a, n in zip(new[~small], sizes[~small]):
            i, j = _compare(fps[a:a + n], side[a:a + n], radius)
            root = local_roots(n, i, j)
            ray = np.flatnonzero(root != np.arange(n))
            left.append(root[ray] + a)
            right.append(ray + a)
        i, j = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)[i]), pa.array(fps.view(np.int64)[j])], ["u", "v"])

    def run(batches):
        held = None                            # the rows of a cell may span Arrow batches
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables(
                [held, pa.Table.from_batches([batch])])
            last = [held[k][-1].as_py() for k in keys]
            same = np.ones(held.num_rows, bool)
            for k, v in zip(keys, last):
                same &= held[k].to_numpy() == v
            cut = int(np.argmax(same))
            if cut:
                yield forest(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None:
            yield forest(held.combine_chunks())

    return ordered.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes, radius, tile))
    rooted = classes.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    # one fingerprint may belong to a third of the rows: its rows are spread over salted keys
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return fps.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(8)).cast("int")).join(
        salted, ["fp", "salt"], "left").select("doc_id", "fp", "component_id")
