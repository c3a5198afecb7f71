"""Language ID by interpolated Kneser-Ney character models, one per language.

A word (a run of letters and marks, lower case) is read as ``^word$`` with
contexts inside it, up to ``order`` characters. The cross-entropy of a text
under a language is the mean negative log-probability of its characters and
word ends; the lowest wins (ties: first language by name).

The models are learned from about ``fit_rows`` documents a language, those
with the smallest id hash (documented bound of what is learned from; the
rate follows from counts over all rows). N-grams are counted by tasks; the
driver turns the counts into probabilities and back-off weights, kept for
all languages in sorted arrays of 64-bit n-gram hashes and broadcast (their
size is bounded by the fit rows' distinct n-grams).

A fifth of the fit rows is held back for calibration: the score is the
logistic probability that the winner is right, given its lead; ``accepted``
is false when a text's cross-entropy is beyond nearly all calibration rows.

Defined results: null texts and texts without a letter are ``und`` with
score 0 and not accepted; so is every text when nothing can be learned;
repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from fleetsight.llm.sampling import unit_hash

ORDER = 5
FIT_ROWS = 2_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 512
_MEMO = 200_000


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def suffix_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Over the bordered words laid end to end: word number and place of each character, and the hash of the
    1 to ``order`` characters that end there (only meaningful when the place allows so many)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    out, acc, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    for k in range(order):
        acc = acc.copy()
        acc[k:] += codes[:max(0, len(codes) - k)] * power
        power = power * _PRIME
        out.append(_mix(acc, k + 1))
    return word, place, out


def _gram_hash(grams: list[str]) -> np.ndarray:
    """Hash of each gram, equal to the suffix hash of its last character."""
    out = np.zeros(len(grams), np.uint64)
    by = defaultdict(list)
    for i, g in enumerate(grams):
        by[len(g)].append(i)
    with np.errstate(over="ignore"):
        for k, at in by.items():
            _, place, h = suffix_hashes([grams[i] for i in at], k)
            out[at] = h[k - 1][place == k - 1]
    return out


# --- learning -------------------------------------------------------------------

def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of the longest n-gram that ends at each character of the bordered words."""

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(WORD.findall(text.lower()))
        langs, grams, ns = [], [], []
        for lang, counts in words.items():
            got: Counter = Counter()
            for w, n in counts.items():
                b = f"^{w}$"
                for i in range(1, len(b)):
                    got[b[max(0, i + 1 - order):i + 1]] += n
            langs += [lang] * len(got)
            grams += got.keys()
            ns += got.values()
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()),
                                          pa.array(ns, pa.int64())], ["lang", "gram", "n"])

    return (rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def kneser_ney(top: dict[str, int], order: int, alphabet: int) -> tuple[dict[str, float], dict[str, float]]:
    """(log probability of a gram's last character, log back-off weight of a context) from the counts of the
    longest grams; shorter grams count their distinct left neighbours, unless a word start leaves none."""
    level: list[dict[str, float]] = [defaultdict(float) for _ in range(order + 1)]
    for g, n in top.items():
        level[len(g)][g] += n
    for k in range(order, 1, -1):
        for g in list(level[k]):
            # a gram that starts a word was counted itself; its tail is seen once more with this neighbour
            level[k - 1][g[1:]] += 1
    logp: dict[str, float] = {}
    bow: dict[str, float] = {}
    prob: dict[str, float] = {}
    for k in range(1, order + 1):
        counts = Counter(min(int(n), 3) for n in level[k].values())
        d = counts[1] / (counts[1] + 2 * counts[2]) if counts[1] and counts[2] else 0.5
        total: dict[str, float] = defaultdict(float)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in level[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        for h in total:
            bow[h] = d * kinds[h] / total[h]
        for g, n in level[k].items():
            lower = prob[g[1:]] if k > 1 else 1.0 / alphabet
            prob[g] = max(n - d, 0.0) / total[g[:-1]] + bow[g[:-1]] * lower
    for g, p in prob.items():
        logp[g] = math.log(p)
    return logp, {h: math.log(b) for h, b in bow.items()}


class Models:
    """All languages' grams in one sorted hash array, all contexts in another; one column a language."""

    def __init__(self, langs: list[str], top: dict[str, dict[str, int]], order: int):
        self.langs, self.order = langs, order
        alphabet = len({c for grams in top.values() for g in grams for c in g}) + 1
        parts = [kneser_ney(top[lang], order, alphabet) for lang in langs]
        self.unseen = math.log(1.0 / alphabet)
        self.gram, self.logp = self._table([p for p, _ in parts], np.nan)
        self.context, self.bow = self._table([b for _, b in parts], 0.0)
        self.slope, self.bias, self.reject = 1.0, 0.0, math.inf

    @staticmethod
    def _table(parts, fill):
        names = sorted({g for p in parts for g in p if g})
        hashes = _gram_hash(names)
        by = np.argsort(hashes, kind="stable")
        values = np.full((len(names), len(parts)), fill)
        at = {g: i for i, g in enumerate(names)}
        for j, p in enumerate(parts):
            for g, v in p.items():
                if g:
                    values[at[g], j] = v
        # the empty context's back-off weight is constant per language and only needed for unseen characters
        return hashes[by], values[by]

    @staticmethod
    def _find(table, want):
        at = np.minimum(np.searchsorted(table, want), max(len(table) - 1, 0))
        return at, table[at] == want if len(table) else np.zeros(len(want), bool)

    def words(self, words: list[str]) -> np.ndarray:
        """Summed log-probabilities of each word's characters and end: one row a word, one column a language."""
        out = np.zeros((len(words), len(self.langs)))
        with np.errstate(over="ignore"):
            word, place, h = suffix_hashes([f"^{w}$" for w in words], self.order)
        inside = np.flatnonzero(place > 0)
        value = np.full((len(inside), len(self.langs)), np.nan)
        carry = np.zeros_like(value)                     # back-off weights passed on the way down
        for k in range(self.order, 0, -1):
            fits = place[inside] >= k - 1
            at, hit = self._find(self.gram, h[k - 1][inside])
            got = np.where((fits & hit)[:, None], self.logp[at] if len(self.gram) else np.nan, np.nan)
            open_ = np.isnan(value)
            value = np.where(open_ & ~np.isnan(got), got + carry, value)
            if k > 1:                                    # not found: weight of the context of k - 1 characters
                at, hit = self._find(self.context, h[k - 2][inside - 1])
                carry += np.where((fits & hit)[:, None], self.bow[at], 0.0)
        value = np.where(np.isnan(value), self.unseen + carry, value)
        np.add.at(out, word[inside], value)
        return out


class Scorer:
    """Cross-entropies of texts, with a per-worker memo of words."""

    def __init__(self, models: Models):
        self.models, self.at = models, {}
        self.values = np.zeros((0, len(models.langs)))
        self.size = np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """One row a text (NaN: no letter), one column a language."""
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.at})
        if len(self.at) + len(new) > _MEMO:
            self.at, self.values, self.size = {}, self.values[:0], self.size[:0]
            new = list({w for ws in split for w in ws})
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.values = np.vstack([self.values, self.models.words(new)])
            self.size = np.append(self.size, [len(w) + 1 for w in new])
        out = np.full((len(texts), len(self.models.langs)), np.nan)
        for i, ws in enumerate(split):
            if ws:
                at = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
                out[i] = -self.values[at].sum(axis=0) / self.size[at].sum()
        return out


def _lead(ce: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its cross-entropy and its lead over the next (one language: a lead of 1)."""
    best = np.argmin(np.where(np.isnan(ce), np.inf, ce), axis=1)
    low = np.sort(ce, axis=1)
    return best, low[:, 0], low[:, 1] - low[:, 0] if ce.shape[1] > 1 else np.ones(len(ce))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        fit_rows: int = FIT_ROWS, order: int = ORDER) -> Models | None:
    """Learn from rows with text and language; None when there are none."""
    u = unit_hash(id_col)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), u.alias("u"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return None
    rate = F.create_map(*[x for lang, n in per.items() for x in (F.lit(lang), F.lit(fit_rows / n))])
    chosen = rows.where(F.col("u") < rate[F.col("lang")])
    held = F.pmod(F.xxhash64("u", F.lit("calibrate")), F.lit(5)) == 0
    top: dict[str, dict[str, int]] = defaultdict(dict)
    grams = count_grams(chosen.where(~held), order).toArrow()
    for lang, g, n in zip(*(grams[c].to_pylist() for c in ("lang", "gram", "n"))):
        top[lang][g] = n
    lacking = sorted(set(per) - set(top))        # so few rows that all were held back
    if lacking:
        grams = count_grams(rows.where(F.col("lang").isin(lacking)), order).toArrow()
        for lang, g, n in zip(*(grams[c].to_pylist() for c in ("lang", "gram", "n"))):
            top[lang][g] = n
    if not top:
        return None
    models = Models(sorted(top), top, order)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            ce = scorer(batch.column(1).to_pylist())
            some = ~np.isnan(ce[:, 0])
            best, low, lead = _lead(ce[some])
            right = [shared.value.langs[b] == lang for b, lang in
                     zip(best, np.asarray(batch.column(0).to_pylist(), object)[some])]
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.float64()), pa.array(low, pa.float64()),
                                              pa.array(right, pa.bool_())], ["lead", "low", "good"])

    got = chosen.where(held).select("lang", "text").mapInArrow(run, "lead double, low double, good boolean").toArrow()
    if got.num_rows:
        _calibrate(models, got["lead"].to_numpy(), got["low"].to_numpy(),
                   got["good"].to_numpy(zero_copy_only=False).astype(bool))
    return models


def _calibrate(models: Models, lead: np.ndarray, low: np.ndarray, good: np.ndarray) -> None:
    """Platt's fit of P(right | lead) with his smoothed targets, and the rejection bound."""
    y = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([lead, np.ones(len(lead))], axis=1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + 1e-3 * w), -5, 5)
    models.slope, models.bias = max(float(w[0]), 0.0), float(w[1])
    models.reject = float(np.quantile(low, 0.999) * 1.25)


def predict(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score``, ``cross_entropy`` and ``accepted``."""
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()),
           StructField("cross_entropy", DoubleType()), StructField("accepted", BooleanType())]
    taken = {text_col.lower(), *[f.name for f in new]}
    rest = [c for c in docs.columns if c.lower() not in taken]
    src = docs.select(*[f"`{c}`" for c in rest], F.col(f"`{text_col}`").alias("_whole_text"))
    if models is None:
        return src.drop("_whole_text").withColumns({
            "lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"),
            "accepted": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = shared.value
        scorer, names = Scorer(m), np.asarray(m.langs, object)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                ce = scorer(batch.column(batch.num_columns - 1).to_pylist())
                best, low, lead = _lead(ce)
                none = np.isnan(low)
                sure = 1 / (1 + np.exp(-np.clip(m.slope * np.nan_to_num(lead) + m.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(np.where(none, "und", names[best]), pa.string()),
                     pa.array(np.where(none, 0.0, sure)), pa.array(low, pa.float64(), mask=none),
                     pa.array(~none & (np.nan_to_num(low) <= m.reject))], [*rest, *[f.name for f in new]])

    return src.mapInArrow(run, StructType([*src.schema.fields[:-1], *new]))
