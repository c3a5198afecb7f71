"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (3 to 6, inside blank-delimited words with
their borders). A word that makes up a share s of the text's words adds
log(1 + 200 s) to each n-gram it holds, so a rare chance hit in a long text
weighs little and a marker's steady rate counts the same at any length; an
n-gram's value is the sum over its places in words.

That makes a score additive by word: with weights on n-grams, a word's
weight is the sum over its n-grams, computed once per word. The matrix of fit
rows is never built either: it is (rows x words) times (words x n-grams),
and the solver multiplies by the two factors.

1. Fit rows: all labelled documents or, of more than ``fit_rows``, about so
   many by the hash of their id (documented bound; what is collected below,
   each fit row's distinct words with their counts, is bounded by it).
2. The log-count ratio r of an n-gram is log(p / q) of its mean values over
   toxic and other fit rows, smoothed towards 0.
3. Every n-gram of the fit rows, scaled by its r, carries a logistic
   regression with a ridge penalty, fitted by Newton steps (conjugate
   gradients, so no matrix of n-grams by n-grams is built). There is no floor
   and no cap on features.

Scoring reads whole texts in one pass over the scan, no shuffle. Defined
results: null and empty texts hold no n-gram and get the intercept's score;
repeated rows are scored one by one; with no labelled row, or labels of one
class only, every score is that class's smoothed share; an empty table gives
an empty result; only id and text are read, so clashing names of further
columns do not matter unless ``keep`` asks for them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fleetsight.llm.langid import suffix_hashes
from fleetsight.llm.sampling import hashed_sample

FIT_ROWS = 4_000
GRAMS = (3, 4, 5, 6)
RATE = 200.0                 # of a word's share of the text, inside the logarithm
SMOOTH = 1.0                 # values spread over both classes before the log-count ratio
_SLICE = 512                 # texts handled at a time inside an Arrow batch
_WORDS = 50_000              # words whose n-grams are hashed at a time
_PART = 1 << 20             # places of a product at a time
_MEMO = 500_000              # words kept per worker, not a bound of the result
_MEMO_CHARS = 64


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the 3- to 6-grams of each word with its borders, word by word; the number of the word of
    each). Every word has one at least."""
    keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k in range(0, len(words), _WORDS):
        some = words[k:k + _WORDS]
        with np.errstate(over="ignore"):
            word, place, hashes = suffix_hashes([f" {w} " for w in some], max(GRAMS))
        at = [np.flatnonzero(place >= n - 1) for n in GRAMS]
        number = np.concatenate([word[i] for i in at])
        order = np.argsort(number, kind="stable")
        keys.append(np.concatenate([hashes[n - 1][i] for n, i in zip(GRAMS, at)])[order])
        own.append((number[order] + k).astype(np.int32))
    return np.concatenate(keys), np.concatenate(own)


def word_counts(text: str | None) -> Counter:
    return Counter(text.lower().split()) if text else Counter()


def word_values(counts: np.ndarray) -> np.ndarray:
    """What each word of a text adds to its n-grams."""
    return np.log1p(RATE / max(1, counts.sum()) * counts)


def _sliced(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            yield whole.slice(at, _SLICE)


def fit_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(t, y) of the labelled rows to learn from; the broadcast side holds about ``limit`` rows."""
    few = hashed_sample(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()), limit, "doc_id").select(
        "doc_id", (F.col("toxic") == 1).cast("int").alias("y"))
    return docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(few), "doc_id").select("t", "y")


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression; each step is halved until the loss falls."""
    x = np.hstack([x, np.ones((len(x), 1))])
    k = np.ones(len(x)) if weight is None else weight
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return k @ (np.logaddexp(0, z) - y * z) + 0.5 * (pen * w * w).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (k * (p - y)) + pen * w
        hess = (x * (k * p * (1 - p))[:, None]).T @ x
        hess[np.diag_indices_from(hess)] += pen
        move, size = np.linalg.solve(hess, grad), 1.0
        while (new := loss(w - size * move)) > now and size > 1e-4:
            size /= 2
        if now - new < 1e-6 * (1 + abs(now)):
            break
        w, now = w - size * move, new
    return w


class Factors:
    """Fit rows times n-grams as (rows x words) times (words x n-grams), the n-grams scaled by ``scale``; a last
    column of ones. Numbers take 4 bytes, and products go by parts, so that a driver of 1 GB holds it."""

    def __init__(self, row, word, value, n_rows: int, grams, own):
        self.row, self.word, self.value, self.n_rows = row, word, value, n_rows
        self.keys = np.unique(grams)
        self.gram = np.empty(len(grams), np.int32)
        for at in range(0, len(grams), _PART):
            self.gram[at:at + _PART] = np.searchsorted(self.keys, grams[at:at + _PART])
        # the places of the second factor twice: by word, and by n-gram
        self.word_start = np.searchsorted(own, np.arange(own[-1] + 1))
        order = np.argsort(self.gram, kind="stable").astype(np.int32)
        self.words_of_gram = own[order]
        self.gram_start = np.searchsorted(self.gram, np.arange(len(self.keys)), sorter=order)
        self.scale, self.width = np.ones(len(self.keys)), len(self.keys) + 1

    @staticmethod
    def _sums(values: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum of ``values[places]`` over each run of ``places`` that begins at ``starts``."""
        out, at = np.empty(len(starts)), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + _PART)))
            end = starts[to] if to < len(starts) else len(places)
            out[at:to] = np.add.reduceat(values[places[starts[at]:end]], starts[at:to] - starts[at])
            at = to
        return out

    def word_weights(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[:-1] * self.scale, self.gram, self.word_start)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * self.word_weights(w)[self.word], self.n_rows) + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.word, self.value * g[self.row], len(self.word_start))
        return np.append(self.scale * self._sums(by_word, self.words_of_gram, self.gram_start), g.sum())


def _inner(a: np.ndarray, b: np.ndarray) -> float:
    """Without a linear-algebra library's own threads: a task or driver has the cores it was given."""
    return float((a * b).sum())


def sparse_newton(x: Factors, y: np.ndarray, ridge: float, steps: int = 15, inner: int = 30,
                  exact: float = 1e-2, end: float = 1e-3) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression. Each Newton step is solved by conjugate gradients
    and halved until the loss falls."""
    pen = np.full(x.width, ridge)
    pen[-1] = 1e-6
    w = np.zeros(x.width)

    def loss(z, w):
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (pen * w * w).sum()

    z = x.dot(w)
    now = loss(z, w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        left = x.back(p - y) + pen * w                     # of hess @ move = grad
        move, way, size, k = np.zeros(x.width), left.copy(), _inner(left, left), p * (1 - p)
        goal = exact * size
        for _ in range(inner):
            if size <= goal:
                break
            turned = x.back(k * x.dot(way)) + pen * way
            step = size / _inner(way, turned)
            move += step * way
            left = left - step * turned
            size, before = _inner(left, left), size
            way = left + size / before * way
        zm, size = x.dot(move), 1.0
        while (new := loss(z - size * zm, w - size * move)) > now and size > 1e-4:
            size /= 2
        done = now - new < end * (1 + abs(now))
        if new < now:
            w, z, now = w - size * move, z - size * zm, new
        if done:
            break
    return w


class Model:
    """``weight`` per n-gram (sorted 64-bit ``keys``; others weigh nothing) and the intercept."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray, intercept: float):
        self.keys, self.weight, self.intercept = keys, weight, intercept

    def word_weights(self, words: list[str]) -> np.ndarray:
        grams, own = word_grams(words)
        if not len(self.keys):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.bincount(own, np.where(self.keys[at] == grams, self.weight[at], 0.0), len(words))

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + total))))


class Scorer:
    """Scores of texts, with a per-worker memo of the weights of words."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        counts = [word_counts(t) for t in texts]
        memo = self.memo
        new = list({w for c in counts for w in c if w not in memo})
        if len(memo) + len(new) > _MEMO:
            memo.clear()
            new = list({w for c in counts for w in c})
        got = dict(zip(new, self.model.word_weights(new).tolist()))
        out = []
        for c in counts:
            u = np.fromiter((got[w] if w in got else memo[w] for w in c), np.float64, len(c))
            n = np.fromiter(c.values(), np.float64, len(c))
            out.append(self.model.score(math.fsum(u * word_values(n))))
        memo.update((w, u) for w, u in got.items() if len(w) <= _MEMO_CHARS)
        return out


def _words_task(batches):
    """Each fit row's distinct words and their counts, packed."""
    for batch in _sliced(batches):
        counts = [word_counts(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([zlib.compress("\n".join(c).encode(), 1) for c in counts], pa.binary()),
            pa.array([zlib.compress(np.fromiter(c.values(), "<i4", len(c)).tobytes(), 1) for c in counts], pa.binary()),
            batch.column(1)], ["w", "n", "y"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, ridge: float = 1.0) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    got = fit_rows(docs, labels, limit).mapInArrow(_words_task, "w binary, n binary, y int").toArrow()
    # in an order of their own, so that sums do not depend on the order of tasks
    rows = sorted(zip(got["w"].to_pylist(), got["n"].to_pylist(), got["y"].to_pylist()))
    del got
    y = np.asarray([r[2] for r in rows], float)
    toxic, other = y.sum(), len(y) - y.sum()
    share = (toxic + 1.0) / (len(y) + 2.0)
    even = math.log(share / (1 - share))
    vocabulary: dict[str, int] = {}
    words, values = [], []
    for w, n, _ in rows:
        own = zlib.decompress(w).decode().split("\n")
        words.append(np.asarray([vocabulary.setdefault(x, len(vocabulary)) for x in own if x], np.int32))
        values.append(word_values(np.frombuffer(zlib.decompress(n), "<i4")).astype(np.float32))
    del rows
    if not toxic or not other or not vocabulary:
        return Model(np.zeros(0, np.uint64), np.zeros(0), even)
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(w) for w in words])
    words, values, vocabulary = np.concatenate(words), np.concatenate(values), list(vocabulary)
    x = Factors(row, words, values, len(y), *word_grams(vocabulary))
    del vocabulary
    p = x.back(y)[:-1] + SMOOTH * toxic / len(y)
    q = x.back(1 - y)[:-1] + SMOOTH * other / len(y)
    x.scale = np.log((p / toxic) / (q / other))
    w = sparse_newton(x, y, ridge)
    return Model(x.keys, w[:-1] * x.scale, float(w[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` without the text, with ``score_col`` in 0 to 1; the other columns pass through."""
    rest = [c for c in docs.columns if c.lower() not in {score_col.lower(), text_col.lower()}]
    src = docs.select(*[f"`{c}`" for c in rest], F.col(f"`{text_col}`").alias("_whole_text"))
    schema = StructType([*src.schema.fields[:-1], StructField(score_col, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)      # the n-grams of the fit rows, which are bounded

    def run(batches):
        scores = Scorer(shared.value)
        for batch in _sliced(batches):
            out = scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*rest, score_col])

    return src.mapInArrow(run, schema)
