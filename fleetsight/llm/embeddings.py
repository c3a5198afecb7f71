"""Embedding near-dedup: PCA-ordered tiles with a suffix-norm bound.

Vectors are compared only inside a label (and a length). Equal vectors are one
class. A label's classes are cut into chunks by hash, every pair of chunks
is a task's cell, and a cell

1. turns its unit vectors to principal axes, strongest first,
2. sorts them along the first axis and skips pairs of small tiles whose
   distance there alone rules the threshold out,
3. multiplies the leading axes of a tile pair as matrices and keeps pairs whose
   partial product plus the product of the suffix norms can still reach the
   threshold, then goes on with further axes for these only,
4. decides by the cosine of the original vectors in double precision.

A cell returns, per class, how many vectors it links to and a spanning forest
of its links, never the pairs. The axes come from about ``pca_rows`` classes
(documented bound); they are any rotation to the result, so they change
speed only.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing and are their own
component; repeated rows link with each other; null ids are never a
component's id unless all its ids are null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.components import components, local_roots
from fleetsight.llm.sampling import hashed_sample
from fleetsight.session import cut_lineage

THRESHOLD = 0.93
TILE = 4096
PCA_ROWS = 4096
_SUB = 512
_PAIRS = 1 << 16              # pairs whose further axes are multiplied at a time
_SLACK = 1e-9                 # rounding room of the bound; the decision itself has none


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the axes of unit vectors, strongest first."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1].copy()


def tile_links(vectors: np.ndarray, side: np.ndarray, axes: np.ndarray | None,
               threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of places. ``side``: 2 is compared with its own kind, 0 with 1."""
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norm[:, None]
    turned = unit @ axes if axes is not None else unit
    order = np.argsort(turned[:, 0], kind="stable")
    turned, side = turned[order], side[order]
    dims = turned.shape[1]
    steps = sorted({min(dims, s) for s in (max(1, dims // 8), max(1, dims // 4), max(1, dims // 2), dims)})
    # norm of what follows each step's axes
    rest = {s: np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", turned[:, s:], turned[:, s:]))) for s in steps}
    left, right = [], []
    first = steps[0]
    for a in range(0, len(turned), _SUB):
        a_end = min(a + _SUB, len(turned))
        for b in range(a, len(turned), _SUB):
            gap = max(0.0, turned[b, 0] - turned[a_end - 1, 0])
            if 1 - gap * gap / 2 < threshold - _SLACK:
                break
            b_end = min(b + _SUB, len(turned))
            if side[a] != 2:
                differ = side[a:a_end, None] != side[None, b:b_end]
                if not differ.any():
                    continue
            part = turned[a:a_end, :first] @ turned[b:b_end, :first].T
            able = part + rest[first][a:a_end, None] * rest[first][None, b:b_end] >= threshold - _SLACK
            if side[a] != 2:
                able &= differ
            i, j = np.nonzero(able)
            if a == b:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), _PAIRS):
                p, q = i[at:at + _PAIRS], j[at:at + _PAIRS]
                dot, p, q = part[p, q], p + a, q + b
                done = first
                for s in steps[1:]:
                    dot = dot + np.einsum("ij,ij->i", turned[p, done:s], turned[q, done:s])
                    on = dot + rest[s][p] * rest[s][q] >= threshold - _SLACK
                    dot, p, q, done = dot[on], p[on], q[on], s
                p, q = order[p], order[q]
                cosine = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norm[p] * norm[q])
                left.append(p[cosine >= threshold])
                right.append(q[cosine >= threshold])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _usable(vec: str) -> Column:
    v = F.col(vec)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                                                 & (F.abs(x) != float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def links(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pca_rows: int = PCA_ROWS) -> DataFrame:
    """(kind, a, b) over ``classes`` (c, label, vec, n): kind 0 is a forest's link between classes a and b, kind
    1 says that class a links to b vectors of other classes in one cell."""
    sample = hashed_sample(classes.select("vec"), pca_rows, "vec").toArrow()["vec"].to_pylist()
    by_dims: dict[int, list] = {}
    for v in sample:
        by_dims.setdefault(len(v), []).append(v)
    axes = {}
    for dims, vs in by_dims.items():
        m = np.asarray(vs, float)
        m = m / np.abs(m).max(axis=1, keepdims=True)
        axes[dims] = principal_axes(m / np.linalg.norm(m, axis=1, keepdims=True))
    shared = classes.sparkSession.sparkContext.broadcast(axes)     # dims x dims, from about pca_rows vectors
    rows = classes.withColumn("dims", F.size("vec"))
    size = rows.groupBy("label", "dims").agg(F.count("*").alias("m"))
    cells = (rows.join(size, ["label", "dims"])
             .withColumn("k", F.ceil(F.col("m") / F.lit(tile)).cast("int"))
             .withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("label", "dims", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"),
                     F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0)
                     .otherwise(1).cast("int").alias("side"), "c", "n", "vec"))

    def cell(table: pa.Table) -> pa.Table:
        c, n, side = (table[k].to_numpy() for k in ("c", "n", "side"))
        dims = table["dims"][0].as_py()
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(-1, dims)
        # a power of two per vector keeps squares in range and changes no quotient
        vectors = vectors / np.exp2(np.floor(np.log2(np.abs(vectors).max(axis=1))))[:, None]
        i, j = tile_links(vectors, side, shared.value.get(dims), threshold)
        linked = np.bincount(i, n[j], len(c)) + np.bincount(j, n[i], len(c))
        root = local_roots(len(c), i, j)
        ray, some = np.flatnonzero(root != np.arange(len(c))), np.flatnonzero(linked)
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [len(ray), len(some)]), pa.int32()),
            "a": pa.array(np.concatenate([c[root[ray]], c[some]]), pa.int64()),
            "b": pa.array(np.concatenate([c[ray], linked[some].astype(np.int64)]), pa.int64())})

    return cells.groupBy("label", "dims", "x", "y").applyInArrow(cell, "kind int, a long, b long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                          F.col(f"`{vec_col}`").alias("vec")).withColumn(
        "usable", F.col("label").isNotNull() & _usable("vec"))
    good = rows.where("usable")
    classes = cut_lineage(good.groupBy("label", "vec").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("n"))).withColumn("c", F.monotonically_increasing_id())
    found = cut_lineage(links(classes, threshold, tile))
    roots = components(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = found.where("kind = 1").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("linked"))
    rooted = classes.join(roots.withColumnRenamed("vertex", "c"), "c", "left").withColumn(
        "root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").join(linked, "c", "left").select(
        "label", "vec", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"))
    # one vector may be a third of the rows: its rows are spread over salted keys
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = good.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int")).join(
        salted, ["label", "vec", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                            F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
