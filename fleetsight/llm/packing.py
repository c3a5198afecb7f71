"""Packing: cost-balanced assignment of documents to fixed-size token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (projections and
attention). Descending pieces go to the sequence of lowest cost that still
has room; when no open sequence has room for a whole piece, it is cut and
its head fills the cheapest one. A group opens ceil(tokens / capacity)
sequences, so all but the last few places of each group are filled.

Work is done per scan partition, in groups of at most ``group_tokens`` tokens:
no shuffle, memory bounded by one group and one document whatever the
input's size, and a retried task gives the same pieces.

Defined results: a null or empty text is one piece that holds only the end
id; repeated rows are packed once per row; null ids are carried; an empty
table gives no pieces. Only the id and the text column are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from fleetsight.llm.tokens import long_space, rank_encoding, simple, specials, tokenizer

CAPACITY = 2048
GROUP_TOKENS = 512 * CAPACITY
END_ID = 1


def assign(lengths: list[int], capacity: int, linear: float = 1.0,
           quadratic: float = 1.0 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in piece, length, sequence, offset) of a cost-balanced packing of one group."""
    n_seq = -(-sum(lengths) // capacity)
    room = [capacity] * n_seq
    heap = [(0.0, s) for s in range(n_seq)]
    todo = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    out = []
    while todo:
        n, piece, start = heapq.heappop(todo)
        n = -n
        passed = []
        while heap and room[heap[0][1]] < n:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, seq = heapq.heappop(heap)
            take = n
        else:                       # nowhere whole: cut, the cheapest open sequence is filled up
            cost, seq = passed.pop(0)
            take = room[seq]
            heapq.heappush(todo, (take - n, piece, start + take))
        out.append((piece, start, take, seq, capacity - room[seq]))
        room[seq] -= take
        for x in passed:
            heapq.heappush(heap, x)
        if room[seq]:
            heapq.heappush(heap, (cost + linear * take + quadratic * take * take, seq))
    return out


class _Encoder:
    """Little-endian unsigned 32-bit ids of texts, as the tokenizers library gives them.

    With the same vocabulary as ranks, simple texts take tiktoken's shorter way to the same ids
    (tests/llm/test_tokens.py compares them); long white-space runs, which it cannot split, do not.
    """

    def __init__(self, path: str, ranks: str | None):
        self.tok, self.special = tokenizer(path), specials(path)
        self.fast = rank_encoding(ranks) if ranks else None

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and simple(text, self.special) and not long_space(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def pack(docs: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1.0 / 4096,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Tokenize (vocabulary at ``path``, optionally the same one as ``ranks``) and pack every document.

    One row per piece: the id, ``start`` (ids of the document before it),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    schema = StructType([src.schema["doc_id"], *[StructField(c, LongType()) for c in ("start", "length")],
                         StructField("ids", BinaryType()),
                         *[StructField(c, LongType()) for c in ("doc_tokens", "sequence_id", "offset")]])

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        encode = _Encoder(path, ranks)
        state = {"next": base}
        id_type = None
        pend, held = [], 0

        def flush():
            pieces = assign([n for _, _, n, _, _ in pend], capacity, linear, quadratic)
            at = state["next"]
            cols = [[] for _ in range(7)]
            for p, s, n, seq, off in pieces:
                doc, start, _, ids, total = pend[p]
                for c, v in zip(cols, (doc, start + s, n, ids[4 * s:4 * (s + n)], total, at + seq, off)):
                    c.append(v)
            state["next"] = at + -(-sum(n for _, _, n, _, _ in pend) // capacity)
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def encoded(batches):
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                for doc, text in zip(batch.column(0), batch.column(1)):
                    yield doc.as_py(), encode(text.as_py())

        end = np.asarray([end_id], "<u4").tobytes()
        for doc, ids in encoded(batches):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                n = min(capacity, total - start)
                pend.append((doc, start, n, ids[4 * start:4 * (start + n)], total))
                held += n
                if held >= group_tokens:
                    yield flush()
                    pend, held = [], 0
        if pend:
            yield flush()

    return src.mapInArrow(run, schema)
