"""Personal data: patterns, and terms that give away a protected entity although it is masked.

Information-theoretic sanitisation: the entities that the patterns find are to
be protected. How much a term t tells about an entity c is their pointwise
mutual information over the corpus,

    PMI(c, t) = log(n(c, t) * D / (n(c) * n(t))),

with D documents, n(c) that hold c, n(t) that hold t and n(c, t) in which t
stands within ``WINDOW`` terms of c. The entity's own information is
IC(c) = log(D / n(c)), so PMI / IC is the share of it that t discloses (1: t
occurs only by c). In a document that holds c, the terms by c that disclose
at least ``GENERALISE`` of it are replaced by their class and those that
disclose at least ``REMOVE`` are removed, everywhere in that document; a
document without entities is left alone. ``SUPPORT`` documents must hold the
two together.

Terms are runs of letters and digits (any character from U+0080 on counts as a
letter), with A-Z lower-cased; terms that overlap an entity are part of it.

One pass over the texts finds entities and the terms by them; a second counts
the documents of every term. What follows are sums and joins on (entity,
term): counts are summed in the tasks first, the side that a hot entity is
joined with has one row per key, and a document's spans are only ever grouped
by document. Both passes are linear in the text; a task holds one batch.

Defined results: a null or empty text has no spans; repeated rows and ids are
separate documents; an entity that all documents hold discloses nothing; an
empty table gives an empty result; other columns pass through unless they
carry the name of a result column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.session import cut_lineage

WINDOW = 8              # terms on either side of an entity
SUPPORT = 2             # documents that hold entity and term together
GENERALISE = 0.8        # share of an entity's information from which a term is generalised
REMOVE = 0.95           # ... from which it is removed

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")
FLUSH = 400_000         # different terms a task counts before it hands them on

# an address is found from its '@': the part behind it, then the run of name characters before it
_HOST = re.compile("@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot begin inside a run of digits: it would have begun with the run
_IP = re.compile("(?<![0-9])[0-9]++(?:\\.[0-9]++){3}")
_CARD = re.compile("[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile("\\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    end = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _NAME:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end, text[start:end]


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.start(), m.end(), m.group()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), digits


def _phones(text: str):
    for m in _PHONE.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 8 <= len(digits) <= 15:
            yield m.start(), m.end(), digits


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(rank of the kind, start, end, value) by kind, then start. Cards and phones are known by their digits."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    found += [(1, *s) for s in _ips(text)] + [(2, *s) for s in _cards(text)]
    return found + ([(3, *s) for s in _phones(text)] if "+" in text else [])


def fold(text: str) -> str:
    """``text`` with A-Z lower-cased and nothing else."""
    return text.encode().lower().decode()


def neighbours(text: str, found: list[tuple[int, int, int, str]]):
    """({entity: terms within the window}, every place of those terms in the text)."""
    taken = sorted((s, e) for _, s, e, _ in found)
    words, k, reach = [], 0, 0
    for m in _TERM.finditer(fold(text)):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            words.append((m.start(), m.end(), m.group()))
    starts = [w[0] for w in words]
    links: dict[str, set[str]] = {}
    for rank, s, _, value in found:
        at = bisect_left(starts, s)
        links.setdefault(f"{KINDS[rank]}:{value}", set()).update(
            w[2] for w in words[max(0, at - WINDOW):at + WINDOW])
    by = set().union(*links.values())
    return links, [w for w in words if w[2] in by]


_SPAN = "array<struct<rank:int,start:int,end:int>>"
_PLACES = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_LINKS = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))
_SPANS = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
RECORD = (f"base {_SPAN}, places array<struct<term:string,start:int,end:int>>, "
          "links array<struct<entity:string,terms:array<string>>>")


def _read_task(batches):
    """The first column is the text, the rest passes through."""
    for batch in batches:
        base, places, links = [], [], []
        for text in batch.column(0).to_pylist():
            found = entities(text) if text else []
            own, at = neighbours(text, found) if found else ({}, [])
            base.append([{"rank": r, "start": s, "end": e} for r, s, e, _ in found])
            places.append([{"term": t, "start": s, "end": e} for s, e, t in at])
            links.append([{"entity": c, "terms": sorted(t)} for c, t in own.items()])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(base, _SPANS), pa.array(places, _PLACES), pa.array(links, _LINKS)],
            [*batch.schema.names[1:], "base", "places", "links"])


def _term_rows(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])


def _term_task(batches):
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(set(_TERM.findall(fold(text))))
                if len(counts) > FLUSH:
                    yield _term_rows(counts)
                    counts = Counter()
    yield _term_rows(counts)


def read_entities(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """One record per document, written to the shared folder: id, the other columns as ``row``, the entities'
    spans (``base``), terms by an entity (``links``) and the places of those terms (``places``)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()]
    own = docs.select(body.alias("body"), F.monotonically_increasing_id().alias("id"),
                      F.struct(*rest, F.lit(0).alias("_")).alias("row"),
                      (body if keep_text else F.lit(None).cast("string")).alias("kept"))
    row = own.schema["row"].dataType.simpleString()
    return cut_lineage(own.mapInArrow(_read_task, f"id long, row {row}, kept string, {RECORD}"))


def disclosing_terms(records: DataFrame, docs: DataFrame, text: str = "text", support: int = SUPPORT,
                     least: float = GENERALISE) -> DataFrame:
    """(entity, term, share): terms that disclose at least ``least`` of an entity's information."""
    total = records.count()
    held = records.select(F.explode("links").alias("l")).select("l.entity", "l.terms")
    n_entity = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_both = held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    n_term = docs.select(F.col(f"`{text}`").cast("string").alias("body")).mapInArrow(
        _term_task, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    docs_ = F.lit(float(total))
    pmi = F.log(F.col("n_both") * docs_ / (F.col("n_entity").cast("double") * F.col("n_term")))
    own = F.log(docs_ / F.col("n_entity"))
    return n_both.join(n_entity, "entity").join(n_term, "term").where(F.col("n_entity") < total).select(
        "entity", "term", (pmi / own).alias("share")).where(F.col("share") >= least)


def scan(docs: DataFrame, text: str = "text", keep_text: bool = False, support: int = SUPPORT,
         generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), with ``spans``: (rank, kind, start, end) of entities
    and of disclosing terms, by kind, then start."""
    records = read_entities(docs, text, keep_text)
    told = disclosing_terms(records, docs, text, support, generalise)
    hits = (records.select("id", F.explode("links").alias("l")).select("id", "l.entity", F.explode("l.terms").alias("term"))
            .join(told, ["entity", "term"]).groupBy("id", "term").agg(F.max("share").alias("share")))
    rank = len(KINDS) + F.when(F.col("share") >= remove, 1).otherwise(0)
    more = (records.select("id", F.explode("places").alias("p")).select("id", "p.term", "p.start", "p.end")
            .join(hits, ["id", "term"]).groupBy("id").agg(F.collect_list(F.struct(
                rank.cast("int").alias("rank"), "start", "end")).alias("more")))
    kinds = F.array(*[F.lit(k) for k in KINDS + TERM_KINDS])
    spans = F.transform(
        F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))),
        lambda s: F.struct(s["rank"].alias("rank"), F.get(kinds, s["rank"]).alias("kind"),
                           s["start"].alias("start"), s["end"].alias("end")))
    keep = [c for c in docs.columns if c.lower() not in {text.lower(), "spans"}]
    out = records.join(more, "id", "left").select(
        *[F.col(f"row.`{c}`") for c in keep], *([F.col("kept").alias(text)] if keep_text else []), spans.alias("spans"))
    return out


def _surrogate(kind: Column, piece: Column) -> Column:
    """What stands for a span: the mark of an entity's kind, the class of a generalised term, nothing."""
    shape = F.when(F.rlike(piece, F.lit("^[0-9]+$")), "[NUMBER]").when(
        F.rlike(piece, F.lit("^\\p{Lu}")), "[NAME]").otherwise("[WORD]")
    return F.when(kind == "removed", "").when(kind == "generalised", shape).otherwise(
        F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def sanitise(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its surrogate; of overlapping spans the first stands for all."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc, s):
        start, end = s["start"], -s["back"]
        new = F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.substring(text, acc["at"] + 1, start - acc["at"]),
            _surrogate(s["kind"], F.substring(text, start + 1, end - start)))).alias("out"))
        return F.when(start >= acc["at"], new).otherwise(
            F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(ordered, begin, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
