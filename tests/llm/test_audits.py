"""Source divergence and filter interaction audits against brute force; personal data against plain patterns."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight.llm import divergence, filter_audit, pii, queries
from fleetsight.sources.tables import TABLE_NAMES
from oracle_check import rows_of

DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_filter_interaction", "op13_pii_disclosure"])
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], False) == rows_of(cols, cur.fetchall(), False)


# --- source divergence --------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence_of(rows, least, top=50):
    n, df, groups = Counter(), defaultdict(set), set()
    for k, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").encode().lower().decode()):
            n[lang, source, t] += 1
            df[lang, t].add(k)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), d in df.items() if g == lang and len(d) >= least]
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)

        def shares(count):
            total = sum(count(t) for t in kept)
            return {t: 1 + 1_000_000_000 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s: n[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(n[lang, s, t] for s in sources))
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items) if part == "pair" or r < top]
    return sorted(out)


def words(r, size):
    pool = ["a", "bb", "Ünder", "eightchr", "ninechars", "sixteen" + "x" * 9, "seventeen" + "y" * 8, "long" * 30,
            "日本語の長い言葉", "Zeta", "zeta", "x" * 8 + "é", "tail\x00", "n1m"]
    return "".join(r.choice(pool) + r.choice([" ", "\n", "1", ", ", "\x00"]) for _ in range(size))


def test_divergence_matches_brute_force(spark):
    r = random.Random(5)
    rows = [(k, r.choice([None, "", words(r, r.randint(0, 30)), words(r, 5)]), r.choice(["en", None, "de"]),
             r.choice(["s1", "s2", None, "s10", "é"])) for k in range(120)] + [(1, "same row", "en", "s1")] * 3
    rows += [(500, "12 34 5", "fr", "only"), (501, None, "fr", "other")]           # a language without terms
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).withColumns(
        {c: F.lit("x") for c in ("n", "term", "rank", "block")}), least_docs=9)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_of(rows, 9)


def test_divergence_of_many_sources_in_tiles(spark):
    r = random.Random(6)
    rows = [(k, words(r, 3), "en", f"s{k % 300}") for k in range(600)]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), least_docs=2, top_terms=3)
    assert sorted(map(tuple, got.collect())) == divergence_of(rows, 2, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_radix_order_is_stable_and_sorted():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**64, 5000, dtype=np.uint64) % np.uint64(977) * np.uint64(2**55 // 977 + 3)
    order = divergence.radix_order(divergence._digits(w))
    assert (order == np.argsort(w, kind="stable")).all()


def test_a_share_does_not_overflow(spark):
    n, total = 9_000_000_000_000_000, 9_100_000_000_000_000
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(7).cast("long"))).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 5) // (total + 35)


# --- filter interaction ----------------------------------------------------------------

def audit_of(rows, labels):
    texts = [(i, r[1] or "", r[3] or "") for i, r in enumerate(rows)]
    first = {}
    for k, t, _ in texts:
        if rows[k][0] is not None:
            first[t] = min(first.get(t, rows[k][0]), rows[k][0])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for k, t, part in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) > 5 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": rows[k][0] is not None and rows[k][0] > first[t]}
        docs.append((part, {f for f in fails if fails[f]}, rows[k][0] in good, rows[k][0] in toxic))
    out, removed = [], Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [d for d in docs if d[0] == part and f in d[1] and not d[1] & before]
                removed[part, f] += len(here)
                out.append([part, "".join(order), step + 1,
                            sum(d[0] == part and not d[1] & (before | {f}) for d in docs), len(here),
                            sum(d[0] == part and f in d[1] and bool(d[1] & before) for d in docs),
                            sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in here),
                            sum(d[3] for d in here)])
    return sorted(tuple(o) + (removed[o[0], o[1][o[2] - 1]],) for o in out)


@pytest.mark.parametrize("shards", [filter_audit.MAX_SHARDS, 1])
def test_filter_audit_matches_brute_force(spark, shards):
    r = random.Random(9)
    pool = [None, "", " ".join(f"w{i}" for i in range(60)), "x " * 70, "ABC " * 50, "a#b", "one two",
            " ".join(f"q{i}$" for i in range(80)), "\t" + " ".join(f"z{i}" for i in range(49))]
    rows = [(r.choice([None, *range(40)]), r.choice(pool + [f"own text {k} " * 20]), "en", r.choice([None, "", "a", "b"]))
            for k in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in list(range(0, 40, 2)) + [4, 4]] + [(None, 1, 1)]
    got = filter_audit.filter_audit(
        spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("h", "mask", "shard", "t", "id")}),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(9)), shards)
    assert sorted(map(tuple, got.collect())) == audit_of(rows, labels)


def test_filter_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), labels).collect() == []
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, None)], DOCS), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120


def test_sketch_clears_only_unique_texts(spark):
    rows = [(f"t{k}",) for k in range(3000)] + [(f"t{k}",) for k in range(0, 3000, 10)]
    df = spark.createDataFrame(rows, "t string").withColumn("h", F.xxhash64("t"))
    shards = filter_audit.shard_count(len(rows))
    sketch = filter_audit.counting_sketch(df.select("h"), shards)
    seen = filter_audit.with_possible_repeat(df, sketch, shards).where("possible").select("t").distinct().collect()
    assert {f"t{k}" for k in range(0, 3000, 10)} <= {r.t for r in seen} and len(seen) < 320


# --- personal data ------------------------------------------------------------------------

PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_entities(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and checks(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((list(PLAIN).index(kind), m.start(), m.end()))
    return out


def checks(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_entities_match_the_plain_patterns():
    r = random.Random(2)
    parts = ["a@b.c", "@", ".", "x", "-", " ", "1.2.3.4", "256.1.1.1", "5", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+", "+1 (555) 010-9999", "é", "\n", "00", "%", "0.0.0.0", "a-b@c-d.e-f.g", "  ", "(", "9999999999999995"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert [e[:3] for e in pii.entities(text)] == plain_entities(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.entities(text)


def disclosed(rows):
    """Spans of every row by the definition, over all words of all rows."""
    found = [pii.entities(t or "") for _, t, _, _ in rows]
    near = [pii.neighbours(t, f)[0] if f else {} for (_, t, _, _), f in zip(rows, found)]
    n_c, n_ct, n_t = Counter(), Counter(), Counter()
    for (_, t, _, _), links in zip(rows, near):
        n_t.update(set(pii._TERM.findall(pii.fold(t or ""))))
        n_c.update(links.keys())
        n_ct.update((c, w) for c, ws in links.items() for w in ws)
    share = {(c, w): log(n * len(rows) / (n_c[c] * n_t[w])) / log(len(rows) / n_c[c])
             for (c, w), n in n_ct.items() if n >= pii.SUPPORT and n_c[c] < len(rows)}
    out = []
    for (_, t, _, _), f, links in zip(rows, found, near):
        best = defaultdict(float)
        for c, ws in links.items():
            for w in ws:
                best[w] = max(best[w], share.get((c, w), 0))
        spans = [(r, s, e) for r, s, e, _ in f]
        for m in pii._TERM.finditer(pii.fold(t or "")):
            if best[m.group()] >= pii.GENERALISE and not any(s < m.end() and m.start() < e for _, s, e, _ in f):
                spans.append((5 if best[m.group()] >= pii.REMOVE else 4, m.start(), m.end()))
        out.append(sorted(spans))
    return out


def test_disclosing_terms_match_the_definition(spark):
    r = random.Random(3)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for k in range(80):
        t = [r.choice(common) for _ in range(r.randint(0, 40))]
        if k % 4 == 0:
            t[len(t) // 2:len(t) // 2] = ["Quentin", "wrote", "q.ash@mail.example", "from", "Tarn"]
        if k % 9 == 0:
            t += ["card", "4111 1111 1111 1111", "Élan"]
        if k % 10 == 0:
            t += ["Tarn"] + [r.choice(common) for _ in range(20)]
        rows.append((k % 50, r.choice([None, ""]) if k % 13 == 12 else " ".join(t), "en", "s"))
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("spans", "row", "base", "entity")})
    docs = docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = pii.scan(docs, keep_text=True)
    assert set(got.columns) == {"doc_id", "lang", "source", "row", "base", "entity", "m", "text", "spans"}
    have = sorted((g.doc_id, g.text, sorted((s.rank, s.start, s.end) for s in g.spans)) for g in got.collect())
    assert have == sorted((i, t or "", s) for (i, t, _, _), s in zip(rows, disclosed(rows)))
    kinds = {s.kind for g in got.collect() for s in g.spans}
    assert {"email", "card", "generalised", "removed"} <= kinds
    clean = got.withColumn("clean", pii.sanitise(F.col("text"), F.col("spans"))).where("contains(text, 'Quentin')").first()
    assert "Quentin" not in clean.clean and "q.ash" not in clean.clean and "[EMAIL]" in clean.clean


def test_surrogates(spark):
    text = "Ann met b@c.de at 12 Elm or 1.2.3.4"
    spans = [("removed", 0, 3), ("email", 8, 14), ("generalised", 18, 20), ("generalised", 21, 24), ("generalised", 4, 7),
             ("ip", 28, 35)]
    df = spark.createDataFrame([(text, spans), ("", [])], "t string, s array<struct<kind:string,start:int,end:int>>")
    assert [r[0] for r in df.select(pii.sanitise(F.col("t"), F.col("s"))).collect()] == [
        " [WORD] [EMAIL] at [NUMBER] [NAME] or [IP]", ""]


def test_personal_data_of_an_empty_table_and_of_a_hot_entity(spark):
    assert pii.scan(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(k, "write to help@site.example now please", "en", "s") for k in range(30)]
    assert {tuple((s.kind, s.start, s.end) for s in g.spans) for g in pii.scan(
        spark.createDataFrame(rows, DOCS)).collect()} == {(("email", 9, 26),)}     # all hold it: nothing to disclose
