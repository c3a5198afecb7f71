"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a path that points at a blob, the SHA-256 of its
content. The ledger holds, per blob, which rule versions were run on it and
what they found; a scan reads only (blob, rule version) pairs that the ledger
lacks, each distinct blob once, and its findings are joined back to all
paths. Only DataFrame functions are used.

Places are found without a user function: the text split at a pattern gives
the gaps, the extracted matches give the rest, and a running sum of both
lengths gives start and end in code points.

Copies: blobs are grouped with map-side partial aggregation, so a text that
a third of the paths share arrives once per map task; the join back spreads
each blob over salted keys. Lineage is cut with ``checkpoint()`` in the
shared folder, so a lost executor costs its tasks only.

Defined results: a null text is the empty blob; repeated rows and ids are
separate paths; an empty table gives an empty result; other columns pass
through unless they carry the name of a result column.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.session import cut_lineage

SALTS = 8


class Rule(NamedTuple):
    """A kind of secret. ``hint`` are strings one of which any match contains (empty: none known);
    ``group`` of the match must have ``least`` characters."""

    kind: str
    version: int
    pattern: str
    hint: tuple[str, ...] = ()
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# The whole block: header lines, base64 lines (also with written-out line ends) and the END line where there is one.
# At most 240 lines are followed, several times the longest key in use (written as four parts: one pattern engine
# takes no larger count).
_BREAK = "(?:[\\x20\\x09-\\x0D]|\\\\[nr])"
PRIVATE_KEY = ("-----BEGIN [A-Z ]*PRIVATE KEY-----(?:" + _BREAK + "+[A-Za-z-]+: [^\\n\\\\]*){0,8}"
               + ("(?:" + _BREAK + "+[A-Za-z0-9+/=]{16,}){0,60}") * 4 +
               "(?:" + _BREAK + "*[A-Za-z0-9+/=]*" + _BREAK + "*-----END [A-Z ]*PRIVATE KEY-----)?")
# A run shorter than the least length cannot contain a longer match, so the counts stand in the patterns.
BASE_RULES = (
    Rule("assign", 1, ASSIGN, (":", "="), 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", 2, PRIVATE_KEY, ("PRIVATE KEY-----",)),
    Rule("forge_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", ("gh",)),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", ("eyJ",)),
)
RULES = BASE_RULES + MORE_RULES

HIT = "array<struct<start:int,end:int,key:string>>"                  # in the ledger
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"       # of a path
LEDGER = f"blob string, scanned array<string>, found {HIT}"


def _hits(text: Column, rule: Rule) -> Column:
    """Places of the leftmost non-overlapping matches that are long enough."""
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1)).alias("hit"))

    def step(acc, z):
        gap, hit = z["gap"], z["hit"]
        start = acc["at"] + F.length(gap)
        end = start + F.length(hit)
        good = F.length(hit if rule.group == 0 else F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.key).alias("key"))
        return F.when(hit.isNull(), acc).otherwise(F.struct(
            end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")))

    empty = F.array().cast(HIT)
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    likely = F.lit(False)
    for h in rule.hint:
        likely = likely | F.contains(text, F.lit(h))
    return F.when((likely if rule.hint else F.lit(True)) & F.rlike(text, F.lit(rule.pattern)), found).otherwise(empty)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
               text_col: str = "text") -> DataFrame:
    """New ledger rows: each distinct blob of ``versions`` with the rule versions the ledger lacks for it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blobs = versions.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    if ledger is not None:
        seen = ledger.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(
            F.collect_set("key").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").where(~F.coalesce(
            F.forall(F.array(*[F.lit(r.key) for r in rules]), lambda k: F.array_contains("seen", k)), F.lit(False)))
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    todo = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    lacks = {r: ~F.coalesce(F.array_contains("seen", r.key), F.lit(False)) for r in rules}
    parts = [F.when(lacks[r], _hits(F.col("text"), r)).otherwise(F.array().cast(HIT)) for r in rules]
    return todo.select(
        "blob", F.array_compact(F.array(*[F.when(lacks[r], F.lit(r.key)) for r in rules])).alias("scanned"),
        F.concat(*parts).alias("found"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
                     text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``versions`` with ``spans``: what the current rule versions found in the path's blob, by start, then
    rule. The text itself is dropped unless ``keep_text``."""
    order = F.array(*[F.lit(r.key) for r in rules])
    known = (ledger.select("blob", F.explode("found").alias("h")).where(F.array_contains(order, F.col("h.key")))
             .groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(
                 "h.start", (F.array_position(order, F.col("h.key")) - 1).cast("int").alias("rank"),
                 F.split_part("h.key", F.lit("@"), F.lit(1)).alias("kind"), "h.end"))).alias("spans")))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [c for c in versions.columns if c.lower() not in {"blob", "spans"}
            and (keep_text or c.lower() != text_col.lower())]
    # the path's own columns travel as one, so no name of theirs meets a working column
    paths = versions.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("path"),
                            F.sha2(text.cast("binary"), 256).alias("blob"),
                            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    return paths.join(known, ["blob", "salt"], "left").select(
        *[F.col(f"path.`{c}`") for c in rest], "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         text_col: str = "text", keep_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, new ledger rows to append). Findings use the old ledger and the new rows."""
    new = cut_lineage(scan_blobs(versions, ledger, rules, text_col))
    full = new if ledger is None else ledger.select("blob", "scanned", "found").unionByName(new)
    return findings_by_path(versions, full, rules, text_col, keep_text), new


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans are replaced together."""
    def step(acc, s):
        ends = F.greatest(acc["at"], s["end"])
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(
            ends.alias("at"), F.concat(acc["out"], F.array(gap, F.lit(mark))).alias("out"))).otherwise(
            F.struct(ends.alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
