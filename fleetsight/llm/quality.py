"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic and every rule is a built-in column expression, so a document
is judged in the scan's own stage: no shuffle, no user function.

Words are maximal runs of characters other than ASCII white space.
Defined results: a null text has no words (all counts 0, so it fails on
length); an empty table gives an empty result; repeated rows and ids are
judged row by row; other columns of the input pass through untouched unless
they carry the name of a result column, which the result replaces.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages judged.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this",
           "are", "or", "from", "an", "at", "have", "not"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "sur", "par",
           "est", "avec", "au", "ne", "pas"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "des", "ein", "eine", "auf", "nicht",
           "sich", "für", "im", "dem", "als"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "que", "en", "un", "una", "se", "por", "con", "para", "su", "al",
           "es", "no", "lo"],
}


class Rule(NamedTuple):
    """Keep a document when ``low <= numerator / denominator <= high`` (a None bound is open)."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


# Ratios of prose; the bounds are wide, so only text that is clearly something else fails.
THRESHOLDS = (
    Rule("length", "n_words", None, 50, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_text_lines", None, 0.5),
)


def _rule(rule: Rule) -> Column:
    """True when the rule holds; a zero denominator fails no rule by itself."""
    value = F.col(rule.numerator).cast("double")
    if rule.denominator:
        value = value / F.when(F.col(rule.denominator) > 0, F.col(rule.denominator))
    parts = [value >= rule.low] if rule.low is not None else []
    parts += [value <= rule.high] if rule.high is not None else []
    holds = parts[0]
    for p in parts[1:]:
        holds = holds & p
    return F.coalesce(holds, F.lit(True))


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the counts that the rules divide."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_stop_words", "n_repeat_words"]
    rest = [c for c in docs.columns if c.lower() not in {text.lower(), *own, "_t", "_w", "_lines", "_sorted", "_dup"}]
    body = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = body.select(
        *[F.col(f"`{c}`") for c in rest], "_t",
        F.array_remove(F.split("_t", SPACE, -1), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda s: F.translate(s, SPACE_CHARS, "") != "").alias("_lines"))
    # 3-word windows with their places, ordered so that equal windows are neighbours
    windows = split.withColumn("_sorted", F.sort_array(F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.struct(F.struct(w.alias("a"), F.get(F.col("_w"), i + 1).alias("b"),
                                       F.get(F.col("_w"), i + 2).alias("c")).alias("w"), i.alias("i")))))
    repeated = windows.withColumn("_dup", F.filter(
        "_sorted", lambda s, k: s["w"].eqNullSafe(F.get(F.col("_sorted"), k - 1)["w"])
        | s["w"].eqNullSafe(F.get(F.col("_sorted"), k + 1)["w"])))
    return repeated.select(
        *[F.col(f"`{c}`") for c in rest],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_text_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct(F.flatten(F.transform("_dup", lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
        .cast("long").alias("n_repeat_words"))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Judge every document by the threshold table.

    Adds the counts, ``failed`` (names of the rules that do not hold),
    ``base_failed`` (under 50 words, or over half the words in repeated
    3-word windows) and ``kept``.
    """
    stats = word_statistics(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~_rule(r), F.lit(r.name)) for r in rules]))
    verdict = F.lit(True)
    for r in rules:
        verdict = verdict & _rule(r)
    return stats.withColumns({"failed": failed, "base_failed": base, "kept": ~base & verdict})
