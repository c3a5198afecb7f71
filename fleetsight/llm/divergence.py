"""Source divergence audit: how far the vocabulary of each source stands from the others of its language.

Terms are counted by length bucket. A term of at most 8 UTF-8 bytes is one
unsigned 64-bit word and one of at most 16 bytes is two (big-endian, padded
with zeros, which no term contains); each bucket is radix-sorted by its
16-bit digits together with the group, and equal neighbours are counted as
runs. Longer terms go to one bucket per length and are sorted as bytes. A task
counts a few megabytes of text at a time, so its memory does not grow with
the table; Spark then sums the counts (partial sums before the shuffle).

Every term that enough documents of its language contain is kept, for every
group, also where it does not occur. Two groups are compared over blocks of
terms in small integer matrices (terms x sources, at most ``TILE`` sources a
side), so no row per pair and term is made; terms that occur in neither group
add the same known amount and need no row at all.

All arithmetic is on integers. Defined results: null text, language and source
are the empty string; a text without letters has no terms but its group
occurs; repeated rows and ids are separate documents; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.session import cut_lineage

LEAST_DOCS = 30          # documents of its language that contain a kept term
SMOOTH = 5               # added to every count
SCALE = 1_000_000_000    # shares are in billionths
TOP_TERMS = 50

CHUNK_BYTES = 4 << 20    # text counted at once in a task
TILE = 128               # sources a side of one comparison
BLOCK_TERMS = 256        # terms of one comparison
BROADCAST_GROUPS = 100_000   # (language, source) groups: at most some 10 MB

COUNTS = "lang string, source string, term string, n long, docs long"

# letter of a term, lower-cased; 0 for a byte that ends a term
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """Stable order by ``digits`` (16-bit, least significant first): one counting pass per digit that varies."""
    order = None
    for d in digits:
        if len(d) and d.min() == d.max():
            continue
        now = d if order is None else d[order]
        step = np.argsort(now, kind="stable").astype(np.int32)      # a radix sort for 16-bit values
        order = step if order is None else order[step]
    return np.arange(len(digits[0]), dtype=np.int32) if order is None else order


def _digits(words: np.ndarray) -> list[np.ndarray]:
    return [(words >> np.uint64(s)).astype(np.uint16) for s in (0, 16, 32, 48)]


def _runs(same: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, rows, documents) of each run; ``same[i]``: place i + 1 continues the run of place i."""
    first = np.concatenate(([True], ~same))
    at = np.flatnonzero(first)
    new_doc = first.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return at, np.diff(np.append(at, len(first))), np.add.reduceat(new_doc, at, dtype=np.int64)


def _strings(matrix: np.ndarray) -> pa.Array:
    """Rows of bytes, zero-padded, as a string array."""
    used = matrix != 0
    offsets = np.concatenate(([0], np.cumsum(used.sum(axis=1)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(matrix), pa.py_buffer(offsets), pa.py_buffer(matrix[used]))


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """(group, term, rows, documents) arrays of one chunk, one set per length bucket.

    ``data`` holds the texts' bytes end to end, ``offsets`` their borders, ``group`` the group of each text.
    """
    folded = np.zeros(len(data) + 24, np.uint8)              # zeros behind the end: whole words can be read anywhere
    folded[:len(data)] = _FOLD[data]
    letter = folded != 0
    border = np.zeros(len(folded), bool)                      # a term ends where its text ends
    border[offsets] = True
    start = np.flatnonzero(letter & (border | ~np.roll(letter, 1)))
    length = np.flatnonzero(letter & np.roll(border | ~letter, -1)) + 1 - start
    doc = np.searchsorted(offsets[1:], start, side="right").astype(np.int32)
    gr = group[doc]
    head = np.ndarray((len(folded) - 7,), ">u8", folded, strides=(1,))

    def word(at, size):
        shift = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        return (head[at].astype(np.uint64) >> shift) << shift

    g_digits = [lambda g: g.astype(np.uint16)]
    if len(group) and group.max() >= 1 << 16:
        g_digits.append(lambda g: (g >> 16).astype(np.uint16))

    for low, high in ((0, 8), (8, 16)):
        pick = np.flatnonzero((length > low) & (length <= high))
        if not len(pick):
            continue
        first = word(start[pick], length[pick])
        words = [first] if high == 8 else [first, word(start[pick] + 8, length[pick] - 8)]
        g, d = gr[pick], doc[pick]
        order = radix_order([x for w in reversed(words) for x in _digits(w)] + [f(g) for f in g_digits])
        words, g, d = [w[order] for w in words], g[order], d[order]
        same = g[1:] == g[:-1]
        for w in words:
            same &= w[1:] == w[:-1]
        at, n, docs = _runs(same, d)
        yield g[at], _strings(np.stack([w[at] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(
            len(at), 8 * len(words))), n, docs

    pick = np.flatnonzero(length > 16)
    for size in np.unique(length[pick]):
        own = pick[length[pick] == size]
        rows = np.lib.stride_tricks.sliding_window_view(folded, size)[start[own]]    # no more bytes than the text
        g, d, key = gr[own], doc[own], rows.view(f"S{size}").ravel()
        order = np.lexsort((key, g))
        key, g, d = key[order], g[order], d[order]
        at, n, docs = _runs((key[1:] == key[:-1]) & (g[1:] == g[:-1]), d)
        yield g[at], _strings(rows[order[at]]), n, docs


def _chunks(batch: pa.RecordBatch):
    """Slices of a batch with about ``CHUNK_BYTES`` of text; a longer text stands alone."""
    text = batch.column(2)
    if not len(text):
        return
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right")) - 1)
        yield batch.slice(at, stop - at), ends[at:stop + 1]
        at = stop


def _count_task(batches):
    for batch in batches:
        for part, ends in _chunks(batch):
            lang, source = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            codes, group = np.unique(code, return_inverse=True)
            langs = lang.dictionary.take(pa.array(codes // len(source.dictionary)))
            sources = source.dictionary.take(pa.array(codes % len(source.dictionary)))
            raw = np.frombuffer(part.column(2).buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
            schema = ["lang", "source", "term", "n", "docs"]
            none = np.zeros(len(codes), np.int64)
            # the group occurs, whether or not it has terms
            yield pa.RecordBatch.from_arrays(
                [langs, sources, pa.nulls(len(codes), pa.string()), pa.array(none), pa.array(none)], schema)
            for g, term, n, docs in count_terms(raw, ends - ends[0], group):
                at = pa.array(g)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(at), sources.take(at), term, pa.array(n.astype(np.int64)), pa.array(docs)], schema)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, and one row with
    a null term per group."""
    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
           for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    return (docs.select(*own).mapInArrow(_count_task, COUNTS)
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) without rounding or overflow."""
    top = (F.lit(SCALE).cast("decimal(10,0)") * (n + F.lit(SMOOTH)).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + F.lit(SMOOTH) * terms).cast("decimal(38,0)"))


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """Rows of kept terms with the language's count and a mark on one row per (lang, term); rows of groups stay."""
    w = Window.partitionBy("lang", "term")
    rows = counts.select("lang", "source", "term", "n", F.sum("n").over(w).alias("n_lang"),
                         F.sum("docs").over(w).alias("docs"),
                         (F.row_number().over(w.orderBy("source")) == 1).cast("long").alias("lead"))
    return cut_lineage(rows.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs"))


def _groups(kept: DataFrame) -> DataFrame:
    """One row per group: total of its kept terms, its language's terms and total, its share of an absent term."""
    term = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum(F.when(term, F.col("lead")).otherwise(0)).alias("leads"))
    w = Window.partitionBy("lang")
    groups = groups.withColumns({
        "terms": F.sum("leads").over(w), "lang_total": F.sum("total").over(w),
        "sources": F.count("*").over(w), "idx": F.row_number().over(w.orderBy("source")) - 1}).drop("leads")
    return cut_lineage(groups.withColumn("zero", F.when(F.col("terms") > 0, _share(
        F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0).cast("long"))))


PAIRS = "lang string, source string, item string, value long"


def _compare(table: pa.Table) -> pa.Table:
    """Distance of every pair of one tile over one block of terms, both ways."""
    is_head = table["term"].is_null()
    head, rows = table.filter(is_head), table.filter(pc.invert(is_head))
    order = np.argsort(head["idx"].to_numpy())
    idx, zero = head["idx"].to_numpy()[order], head["zero"].to_numpy()[order]
    names, lang = head["source"].combine_chunks().take(pa.array(order)), head["lang"][0].as_py()
    term = rows["term"].combine_chunks().dictionary_encode()
    share = np.repeat(zero[:, None], len(term.dictionary), axis=1)
    share[np.searchsorted(idx, rows["idx"].to_numpy()), term.indices.to_numpy()] = rows["share"].to_numpy()
    # terms that occur in neither of a pair: each adds the distance of the two shares of an absent term
    absent = head["in_block"][0].as_py() - len(term.dictionary)
    ti, tj = head["ti"][0].as_py(), head["tj"][0].as_py()
    left, right = np.flatnonzero(idx // TILE == ti), np.flatnonzero(idx // TILE == tj)
    a, b, value = [], [], []
    for i in left:
        far = np.abs(share[right] - share[i]).sum(axis=1) + absent * np.abs(zero[right] - zero[i])
        keep = right > i
        a.append(np.full(keep.sum(), i))
        b.append(right[keep])
        value.append(far[keep])
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "source": names.take(pa.array(x)),
                     "item": names.take(pa.array(y)), "value": np.concatenate([value, value])})


def _tiles(idx: Column, sources: Column) -> Column:
    """Every (ti, tj), ti <= tj, that the source's tile takes part in."""
    own = F.floor(idx / F.lit(TILE)).cast("int")
    last = F.floor((sources - 1) / F.lit(TILE)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(
        F.least(own, o).alias("ti"), F.greatest(own, o).alias("tj")))


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every pair of sources of a language: sum of the differences of all shares."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(BLOCK_TERMS)).cast("int"))
    block = F.pmod(F.xxhash64("term"), blocks).cast("int")
    columns = ["lang", "block", "t.ti", "t.tj", "source", "idx", "zero", "in_block", "term", "share"]
    present = shares.withColumns({"block": block, "in_block": F.lit(None).cast("long"),
                                  "t": F.explode(_tiles(F.col("idx"), F.col("sources")))}).select(*columns)
    # each source once per block and tile, with the number of terms of the block
    in_block = shares.where("lead = 1").groupBy("lang", block.alias("block")).agg(F.count("*").alias("in_block"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).join(
        in_block, ["lang", "block"], "left").withColumns({
            "in_block": F.coalesce("in_block", F.lit(0).cast("long")), "term": F.lit(None).cast("string"),
            "share": F.lit(None).cast("long"), "t": F.explode(_tiles(F.col("idx"), F.col("sources")))}).select(*columns)
    parts = heads.unionByName(present).groupBy("lang", "block", "ti", "tj").applyInArrow(_compare, PAIRS)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Distances between the sources of a language (part ``pair``) and the terms that each source has more of
    than its language (part ``term``, the ``top_terms`` first): (lang, source, part, item, value, rank)."""
    kept = _kept(term_counts(docs, text, lang, source), least_docs)
    groups = _groups(kept)
    small = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    shares = kept.where(F.col("term").isNotNull()).join(small, ["lang", "source"]).withColumns({
        "share": _share(F.col("n"), F.col("total"), F.col("terms")),
        "own": _share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))})
    terms = shares.where("n > 0 AND share > own").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("share") - F.col("own")).alias("value"))
    pairs = pair_distances(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(
        terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_terms))
