"""Byte-pair encoding through a minimal acyclic transducer, and decoding.

1. The frequent words of the whole corpus are counted by Spark.
2. The most frequent ones, at most ``size`` (a documented bound of what the
   driver holds; the cut lies at a power of two of their counts), are compiled into a minimal automaton over their UTF-8 bytes:
   states with equal continuations are shared, arcs carry counts whose sum
   along a path numbers the word, and the number points at the word's ids.
3. The automaton is one file that Spark ships to every executor, where the
   workers memory-map it. A batch's distinct words walk it together.
4. A word that the automaton does not hold is merged exactly by the
   tokenizers library.

The lexicon changes speed only, never a result. Defined results: null and
empty texts have no ids and decode to the empty string; repeated rows give
repeated rows; an empty table gives an empty result; other columns of the
input pass through, except ``ids`` (encode) and ``decoded`` (decode), which
the result replaces.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fleetsight.session import cut_lineage
from fleetsight.llm.tokens import WORD_SPLIT, simple, specials, tokenizer

LEXICON_SIZE = 150_000
_WORD_BYTES = 64             # longer words are left to the library
_SLICE = 1024                # documents handled at a time inside an Arrow batch


# --- the automaton -----------------------------------------------------------

def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted, distinct, non-empty words.

    States are numbered from the finished ones up; ``key`` is
    state * 256 + byte in ascending order, ``target`` and ``add`` belong to
    it, and the sum of ``add`` along a word's path (final states passed
    included) is its rank among ``words``.
    """
    arcs: list[list[list[int]]] = [[]]      # of the open path: [byte, state] pairs
    final = [False]
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    total: list[int] = []

    def close() -> int:
        k = (final.pop(), tuple(map(tuple, arcs.pop())))
        if k not in register:
            register[k] = len(states)
            states.append(k)
            total.append(k[0] + sum(total[t] for _, t in k[1]))
        return register[k]

    before = b""
    for w in words:
        same = len(os.path.commonprefix([before, w]))
        for _ in range(len(before) - same):
            s = close()
            arcs[-1][-1][1] = s
        for b in w[same:]:
            arcs[-1].append([b, -1])
            arcs.append([])
            final.append(False)
        final[-1] = True
        before = w
    for _ in range(len(before)):
        s = close()
        arcs[-1][-1][1] = s
    start = close()
    key, target, add = [], [], []
    for s, (is_final, out) in enumerate(states):
        n = int(is_final)
        for b, t in out:
            key.append(s * 256 + b)
            target.append(t)
            add.append(n)
            n += total[t]
    return {"key": np.asarray(key, np.int64), "target": np.asarray(target, np.int64),
            "add": np.asarray(add, np.int64), "final": np.asarray([f for f, _ in states], bool),
            "start": np.asarray([start], np.int64)}


def walk(lex: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Rank of each word, or -1 where the automaton does not accept it; all words step together."""
    out = np.full(len(words), -1, np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words) or not len(lex["key"]):
        return out
    # longest first: the words that still have a byte at step i are a prefix
    order = np.argsort(-length, kind="stable")
    length = length[order]
    flat = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    state = np.full(len(words), lex["start"][0], np.int64)
    rank = np.zeros(len(words), np.int64)
    for i in range(int(length[0])):
        live = np.flatnonzero(state[:np.searchsorted(-length, -i, "left")] >= 0)
        if not len(live):
            break
        want = state[live] * 256 + flat[begin[live] + i]
        at = np.minimum(np.searchsorted(lex["key"], want), len(lex["key"]) - 1)
        hit = lex["key"][at] == want
        state[live] = np.where(hit, lex["target"][at], -1)
        rank[live] += lex["add"][at]
    good = (state >= 0) & (length > 0)
    good[good] = lex["final"][state[good]]
    out[order[good]] = rank[good]
    return out


# --- the file -----------------------------------------------------------------

_PARTS = ("key", "target", "add", "final", "start", "first", "ids")


def _save(lex: dict[str, np.ndarray], path: str) -> None:
    """One file: a header of offsets and lengths, then the arrays as 64-bit integers."""
    parts = [np.asarray(lex[p], np.int64) for p in _PARTS]
    sizes = np.asarray([len(p) for p in parts], np.int64)
    with open(path, "wb") as f:
        f.write(sizes.tobytes())
        for p in parts:
            f.write(p.tobytes())


@lru_cache(maxsize=2)
def _open(name: str) -> dict[str, np.ndarray]:
    data = np.memmap(SparkFiles.get(name), np.int64, "r")
    ends = len(_PARTS) + np.cumsum(data[:len(_PARTS)])
    lex = {p: data[e - n:e] for p, n, e in zip(_PARTS, data[:len(_PARTS)], ends)}
    return lex | {"final": lex["final"] != 0}


# --- words of a text ------------------------------------------------------------

def _words(text: str) -> list[str]:
    return WORD_SPLIT.findall(text.lower())


def _rest(df: DataFrame, *drop: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in drop]


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over every whole text."""

    def run(batches):
        special = specials(path)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py()
                if t and simple(t, special):
                    counts.update(_words(t))
            if len(counts) > 300_000:        # bounded memory: Spark adds the partial counts up
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    def _counted(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    part = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_SIZE) -> str:
    """Compile at most ``size`` of the most frequent words and ship the file; returns its name for :func:`encode`."""
    spark = docs.sparkSession
    counts = cut_lineage(count_words(docs, path, text_col).where(
        (F.col("n") > 1) & (F.octet_length("word") <= _WORD_BYTES)))
    # the least frequency at which the lexicon holds, from the number of words per bit length of their count
    per = {r["bits"]: r["m"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(
        F.count("*").alias("m")).collect()}
    least, total = 2, sum(per.values())
    for bits in sorted(per):
        if total <= size:
            break
        total -= per[bits]
        least = 1 << bits
    rows = counts.where(F.col("n") >= least).select("word").collect()
    words = sorted(r["word"].encode() for r in rows)
    found = [e.ids for e in tokenizer(path).encode_batch([w.decode() for w in words], add_special_tokens=False)]
    lex = compile_lexicon(words) | {
        "first": np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64),
        "ids": np.asarray([i for x in found for i in x], np.int64)}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))
    _save(lex, os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def _ids_of(words: list[str], lex, tok) -> dict[str, bytes]:
    """The ids of distinct words as bytes: the automaton's, or merged exactly."""
    rank = walk(lex, [w.encode() for w in words])
    first, ids = lex["first"], np.asarray(lex["ids"], np.int32)
    held = rank >= 0
    begin, end = first[rank[held]].tolist(), first[rank[held] + 1].tolist()
    names = np.asarray(words, object)
    raw = ids.tobytes()
    got = {w: raw[4 * a:4 * b] for w, a, b in zip(names[held], begin, end)}
    unseen = names[~held].tolist()
    for w, e in zip(unseen, tok.encode_batch_fast(unseen, add_special_tokens=False)):
        got[w] = np.asarray(e.ids, np.int32).tobytes()
    return got


def _encode_batches(batches, path: str, lexicon: str):
    """Record batches whose last column is the text, with the ids in its place."""
    lex, tok, special = _open(lexicon), tokenizer(path), specials(path)
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            split = [_words(t) if simple(t, special) else None for t in texts]
            known = _ids_of(list({w for ws in split if ws for w in ws}), lex, tok)
            flat = [b"".join(map(known.__getitem__, ws)) if ws is not None
                    else np.asarray(tok.encode(t, add_special_tokens=False).ids, np.int32).tobytes()
                    for t, ws in zip(texts, split)]
            ends = np.cumsum([0] + [len(x) // 4 for x in flat]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])


def _decode_batches(batches, path: str):
    """Record batches whose last column is the ids, with the decoded text behind it."""
    tok = tokenizer(path)
    names = [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            lists = batch.column(batch.num_columns - 1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            text = [" ".join(map(names.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())],
                                             [*batch.schema.names, "decoded"])


def _source(docs: DataFrame, text_col: str, *taken: str) -> DataFrame:
    rest = _rest(docs, text_col.lower(), *taken)
    return docs.select(*[f"`{c}`" for c in rest], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_whole_text"))


_IDS = StructField("ids", ArrayType(IntegerType()))
_DECODED = StructField("decoded", StringType())


def encode(docs: DataFrame, path: str, lexicon: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` (array of int)."""
    src = _source(docs, text_col, "ids")
    return src.mapInArrow(lambda batches: _encode_batches(batches, path, lexicon),
                          StructType([*src.schema.fields[:-1], _IDS]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of the ids, special tokens kept.

    The vocabulary has no decoder, so the library joins the tokens' own
    strings by one space.
    """
    rest = _rest(encoded, "decoded", ids_col.lower())
    src = encoded.select(*[f"`{c}`" for c in rest], F.col(f"`{ids_col}`").alias(ids_col))
    return src.mapInArrow(lambda batches: _decode_batches(batches, path),
                          StructType([*src.schema.fields, _DECODED]))


def round_trip(docs: DataFrame, path: str, lexicon: str, text_col: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass of the same workers."""
    src = _source(docs, text_col, "ids", "decoded")
    return src.mapInArrow(lambda batches: _decode_batches(_encode_batches(batches, path, lexicon), path),
                          StructType([*src.schema.fields[:-1], _IDS, _DECODED]))


__all__ = ["LEXICON_SIZE", "build_lexicon", "compile_lexicon", "count_words", "decode", "encode", "round_trip", "walk"]
