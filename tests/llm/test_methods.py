"""Each operator against a brute-force version, an exact round trip, its SQL or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetsight.llm import (dom, embeddings, html, langid, layouts, lexicon, packing, queries, secrets, simhash,
                            substrings, tokens, toxicity)
from fleetsight.sources.tables import TABLE_NAMES
from oracle_check import rows_of

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- tokenizers -------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_safe_characters_split_as_the_library_does(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    split = tokens.BYTE_SPLIT if name.startswith("byte") else tokens.WORD_SPLIT
    for ch in map(chr, range(0x2100)):
        if tokens.UNSAFE_CHAR.match(ch):
            continue
        s = f"ab{ch}cd {ch}{ch} 1{ch}2 '{ch}x{ch}\n{ch} !{ch}? {ch}"
        t = s if name.startswith("byte") else s.lower()
        assert [i for w in split.findall(t) for i in tok.encode(w, add_special_tokens=False).ids] == tok.encode(
            s, add_special_tokens=False).ids, hex(ord(ch))


def test_rank_file_gives_the_same_ids():
    tok = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = tokens.rank_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    safe = [c for c in map(chr, range(0x2100)) if not tokens.UNSAFE_CHAR.match(c)]
    r = random.Random(3)
    for _ in range(3000):
        pool = r.choice([safe, ["a", "b", " ", " ", "\n", "'s", "1", "é", "!", "\t", "  ", "'ll", "the", "\r\n"]])
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        assert ranks.encode_ordinary(t) == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert tokens.long_space("a" + " " * 500) and not tokens.long_space("a  b")


# --- packing -----------------------------------------------------------------

def test_assign_fills_every_sequence_but_the_last_places():
    r = random.Random(1)
    for _ in range(50):
        lengths = [r.choice([0, 1, r.randint(1, 50), r.randint(1, 2048), 2048]) for _ in range(r.randint(0, 60))]
        out = packing.assign(lengths, 2048)
        by, seq = defaultdict(list), defaultdict(list)
        for piece, start, n, s, off in out:
            by[piece].append((start, n))
            seq[s].append((off, n))
        for k, n in enumerate(lengths):
            assert sum(m for _, m in by[k]) == n
        for parts in [*by.values(), *seq.values()]:
            end = 0
            for at, n in sorted(parts):
                assert at == end and n > 0
                end += n
        assert len(seq) == -(-sum(lengths) // 2048) and all(sum(n for _, n in p) <= 2048 for p in seq.values())


def test_packing_balances_cost():
    out = packing.assign([1000, 1000, 1000, 1000, 40, 40, 40, 40], 2048)
    assert Counter(s for _, _, n, s, _ in out if n == 1000).most_common(1)[0][1] <= 2


def test_op1_matches_the_tokenizer(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.asarray(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in texts(spark, SF2).items()}
    rows = queries.QUERIES["op1_cost_balanced_packing"](spark, SF2).collect()
    cover, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        cover[r.doc_id].append((r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
    for k, parts in [*cover.items(), *seq.items()]:
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert parts is not cover.get(k) or end == len(ids[k])
    assert cover.keys() == ids.keys()
    assert sum(len(i) for i in ids.values()) > 0.99 * 2048 * (len(seq) - 1)


# --- html ---------------------------------------------------------------------

def test_dom_reads_broken_markup():
    p = dom.Page("<p><b>One &amp; two.<br><p>Three<ul><li>a<li>b</ul>&copy &am<script>var x='</p>';</script><!-- no -->")
    assert [t for _, t in p.runs] == ["One & two.", "Three", "a", "b", "© &am"]
    assert dom.Page("<div a='x>y'>in</div> out <").runs[0][1] == "in"


def test_marginals_are_exact():
    """Sum-product against summing over all labellings of a small tree."""
    page = dom.Page("<div class=menu><a href=x>m</a></div><article><h1>T</h1><p>Some text here.</p></article><footer>f</footer>")
    model = html.learn(Counter(e for h in layouts.pages(40) for e in html._examples(h)))
    n = len(page.parent)
    total, one = 0.0, [0.0] * n
    z = [sum(model.weight.get(f, 0.0) for f in html.features(page, k)) for k in range(n)]
    p = [1 / (1 + np.exp(-max(-30, min(30, v)))) for v in z]
    for code in range(1 << n):
        x = [code >> k & 1 for k in range(n)]
        w = model.root if x[0] else 1 - model.root
        for k in range(n):
            w *= p[k] if x[k] else 1 - p[k]
            if k:
                w *= model.step[x[page.parent[k]]][x[k]]
        total += w
        for k in range(n):
            one[k] += w * x[k]
    assert np.allclose(model.marginals(page), [v / total for v in one])


def test_op2_extracts_the_article(spark):
    import html as entities

    def want(h):
        m = re.search(r"<article>(.*?)</article>", h, re.S)
        t = re.sub(r"</?(?:p|h1)>", "\0", m[1])
        t = re.sub(r"<[^>]*>", " ", t)
        return "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in t.split("\0")) if x)

    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF2}/pages.parquet").collect()}
    rows = queries.QUERIES["op2_dom_marginals"](spark, SF2).collect()
    assert len(rows) == len(src)
    assert [r.page_id for r in rows if r.text != want(src[r.page_id]) or r.n_chars != len(r.text)] == []


def test_layouts_not_learned_from(spark):
    model = html.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    wrong = runs = 0
    for h in layouts.pages(150, seed=1234):
        page = dom.Page(h)
        inside = [0] * len(page.parent)
        for k in range(1, len(inside)):
            inside[k] = inside[page.parent[k]] if page.main[k] is None else int(page.main[k])
        p = model.marginals(page)
        runs += len(page.runs)
        wrong += sum((p[k] >= 0.5) != bool(inside[k]) for k, _ in page.runs)
    assert wrong < 0.02 * runs


# --- lexicon --------------------------------------------------------------------

def test_transducer_is_minimal_and_ranks_words():
    words = sorted({b"a", b"ab", b"abs", b"tabs", b"tab", b"stab", b"stabs", b"zoo", "é".encode()})
    lex = lexicon.compile_lexicon(words)
    assert lexicon.walk(lex, words).tolist() == list(range(len(words)))
    assert lexicon.walk(lex, [b"", b"b", b"abc", b"tabss", b"zo"]).tolist() == [-1] * 5
    suffixes = {w: frozenset(v[len(w):] for v in words if v.startswith(w)) for v in words for w in
                [v[:k] for k in range(len(v) + 1)]}
    assert len(lex["final"]) == len(set(suffixes.values()))      # one state per distinct continuation
    assert lexicon.walk(lexicon.compile_lexicon([]), [b"x", b""]).tolist() == [-1, -1]


def test_op3_matches_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    src = texts(spark, SF2)
    for r in queries.QUERIES["op3_lexicon_bpe"](spark, SF2).collect():
        ids = tok.encode(src[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- language and toxicity ---------------------------------------------------------

def test_a_language_of_one_row_is_learned(spark):
    rows = [(k, "the cat and the dog went home", "en") for k in range(30)]
    for k in range(100, 112):
        docs = spark.createDataFrame([*rows, (k, "zhopa kvak munir", "qx")], "doc_id long, text string, lang string")
        models = langid.fit(docs)
        assert models.langs == ["en", "qx"]
        if k == 100:
            got = langid.predict(docs.where("doc_id = 100").select("doc_id", "text"), models).first()
            assert got.lang_pred == "qx"


def test_pages_keep_article_text():
    def runs(h):
        return " | ".join(t for _, t in dom.Page(h).runs)

    assert runs('<p>See <svg class="i"/> the rest</p>') == "See the rest"
    assert runs("<p>a <svg><path d='x'/><text>hid</text></svg> b</p>") == "a b"
    assert runs("f(<math><mi>x</mi></math>) holds") == "f(x) holds"
    assert runs("<map><area>m</map> <object>o</object>") == "m o"
    assert runs("x &lt<b>;y</b> &am<i>p;</i>") == "x <;y &amp;"
    page = dom.Page("<p>" + "<b>x" * 20_000 + "</i>" * 20_000 + "</p>")
    assert page.chars[0] == 20_000 and not any(page.links)
    assert dom.Page("<p><a>li<b>nk</b></a> no <a>two").links[0] == 7


def test_private_keys_are_found_whole(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA7" + "Ab+/" * 12 for _ in range(20))
    whole = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\nQmFzZQ==\n-----END RSA PRIVATE KEY-----"
    one_line = whole.replace("\n", "\\n")
    cases = [f"a {whole} b", f'{{"k": "{one_line}"}}', "-----BEGIN PRIVATE KEY----- and then some prose follows here",
             f"-----BEGIN PRIVATE KEY-----\n{body}\nthe end"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").withColumn(
        "m", F.create_map(F.lit("a"), F.lit(1)))
    found = {r.doc_id: [cases[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "private_key"]
             for r in secrets.scan(docs)[0].collect()}
    assert found == {0: [whole], 1: [one_line], 2: ["-----BEGIN PRIVATE KEY-----"], 3: [cases[3][:-len("\nthe end")]]}
    only_text = spark.createDataFrame([("password=abcdef1",)], "text string")
    assert [len(r.spans) for r in secrets.scan(only_text)[0].collect()] == [1]


def test_kneser_ney_sums_to_one():
    top = Counter()
    for w in ["abba", "abab", "ba", "cab"]:
        b = f"^{w}$"
        for i in range(1, len(b)):
            top[b[max(0, i - 2):i + 1]] += 1
    langs = langid.Models(["x"], {"x": dict(top)}, 3)
    logp, bow = langid.kneser_ney(dict(top), 3, len({c for g in top for c in g}) + 1)
    for h in ["^", "a", "ab", "^a"]:
        seen = sum(np.exp(logp[g]) for g in logp if g[:-1] == h)
        lower = sum(np.exp(logp[g[1:]]) for g in logp if g[:-1] == h)
        assert abs(seen + np.exp(bow[h]) * (1 - lower) - 1) < 1e-9
    # the arrays give the same as the tables
    want = sum(logp[g] for g in ["^a", "^ab", "aba", "ba$"])
    assert abs(langs.words(["aba"])[0, 0] - want) < 1e-9


def test_op4_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    got = queries.QUERIES["op4_kneser_ney_language"](spark, SF2).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = [r for r in got.collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_op10_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = queries.QUERIES["op10_ngram_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def plain_score(model, text):
    """The score of a text by its definition: every place of every n-gram of every word."""
    words = Counter((text or "").lower().split())
    total, weight = 0.0, dict(zip(model.keys.tolist(), model.weight.tolist()))
    for w, n in words.items():
        grams = [f" {w} "[i:i + k] for k in toxicity.GRAMS for i in range(len(w) + 3 - k)]
        total += np.log1p(toxicity.RATE * n / sum(words.values())) * sum(
            weight.get(h, 0.0) for h in langid._gram_hash(grams).tolist())
    return model.score(total)


def test_toxicity_scores_match_the_definition(spark):
    model = queries.toxicity_model(spark, SF)
    t = texts(spark, SF)
    got = {r.doc_id: r.score for r in queries.QUERIES["op10_ngram_toxicity"](spark, SF).collect()}
    for k in sorted(t)[:25]:
        assert got[k] == pytest.approx(plain_score(model, t[k]), abs=1e-9)
    odd = ["", "aaaa aaaa b", "a" * 3000, "Ünïcode \u2003 x", None]
    assert toxicity.Scorer(model)(odd) == pytest.approx([plain_score(model, x) for x in odd], abs=1e-9)


def test_factors_multiply_as_the_matrix():
    r = random.Random(8)
    rows = [" ".join(r.choice(["ab", "abc", "b", "xyzzy", "abab"]) for _ in range(r.randint(0, 6))) for _ in range(30)]
    counts = [toxicity.word_counts(t) for t in rows]
    vocabulary = {w: k for k, w in enumerate(sorted({w for c in counts for w in c}))}
    values = [toxicity.word_values(np.fromiter(c.values(), float, len(c))) for c in counts]
    x = toxicity.Factors(np.repeat(np.arange(30), [len(c) for c in counts]),
                         np.asarray([vocabulary[w] for c in counts for w in c]), np.concatenate(values), 30,
                         *toxicity.word_grams(list(vocabulary)))
    x.scale = np.random.default_rng(1).normal(size=len(x.keys))
    full = np.zeros((30, x.width))
    full[:, -1] = 1
    place = {k: i for i, k in enumerate(x.keys.tolist())}
    for i, (c, v) in enumerate(zip(counts, values)):
        for w, a in zip(c, v):
            for h in toxicity.word_grams([w])[0].tolist():
                full[i, place[h]] += a * x.scale[place[h]]
    w, g = np.random.default_rng(2).normal(size=x.width), np.random.default_rng(3).normal(size=30)
    assert np.allclose(x.dot(w), full @ w) and np.allclose(x.back(g), full.T @ g)
    y = (np.arange(30) % 3 == 0).astype(float)
    dense = toxicity.newton(full[:, :-1], y, 1.0, steps=50)
    assert np.allclose(toxicity.sparse_newton(x, y, 1.0, exact=1e-12, end=1e-12), dense, atol=1e-3)


def test_many_toxic_words(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    clean, bad = [word() for _ in range(2000)], [word() for _ in range(120)]
    rows = []
    for k in range(1500):
        w = [r.choice(clean) for _ in range(60)]
        if k % 3 == 0:                              # three toxic words of 120
            w[5:8] = r.sample(bad, 3)
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id < 900").select("doc_id", "toxic"))
    held = [x for x in toxicity.score(docs, model).collect() if x.doc_id >= 900]
    right = sum((x.score >= 0.5) == bool(x.toxic) for x in held)
    assert sum(x.score >= 0.5 for x in held if x.toxic) >= 0.95 * 200 and right >= 0.95 * len(held)


# --- vectors and fingerprints ----------------------------------------------------------

def test_tiles_find_the_links_of_all_pairs():
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 16))
    v = np.concatenate([base, base + 0.25 * r.normal(size=base.shape), base + 0.05 * r.normal(size=base.shape)])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.93)) if i < j}
    axes = embeddings.principal_axes(unit)
    i, j = embeddings.tile_links(v, np.full(len(v), 2), axes, 0.93)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(want) > 60
    side = np.arange(len(v)) % 2
    i, j = embeddings.tile_links(v, side, axes, 0.93)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {
        (a, b) for a, b in want if side[a] != side[b]}


def test_small_tiles_give_the_same_groups(spark):
    v = spark.read.parquet(f"{SF2}/embeddings.parquet")
    one = sorted(map(tuple, embeddings.embedding_groups(v).collect()))
    assert sorted(map(tuple, embeddings.embedding_groups(v, tile=16).collect())) == one


def brute_simhash(src):
    fp = {}
    for k, t in src.items():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
        fp[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    a = np.array([fp[i] for i in ids], np.uint64)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= 2) + i + 1:
            x, y = top(ids[i]), top(ids[j])
            up[max(x, y)] = min(x, y)
    return {i: ("%016x" % fp[i], top(i)) for i in ids}


def test_op6_matches_brute_force(spark):
    want = brute_simhash(texts(spark, SF2))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash_tiles"](spark, SF2).collect()}
    assert got == want


def test_links_of_close_fingerprints_with_small_tiles(spark):
    r = random.Random(4)
    fps = set()
    for _ in range(8):
        base = r.getrandbits(64)
        fps |= {base}
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    a = np.asarray(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 2
    want = {fps[k]: fps[v] for k, v in enumerate(simhash.local_roots(len(fps), *np.nonzero(near)))}
    for tile in (7, 64, 4096):
        links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=tile)
        got = {f: f for f in fps} | {r.vertex: r.root for r in simhash.components(links).collect()}
        assert got == want


# --- secrets ---------------------------------------------------------------------------

def test_ledger_scans_only_unseen_pairs(spark):
    rows = [(1, 1, "password=hunter22 x"), (1, 2, "password=hunter22 x"), (2, 1, "AKIA" + "A" * 20 + " token: ab12cd34"),
            (3, 1, None), (4, 1, "key 0123456789abcdef0123456789")]
    versions = spark.createDataFrame(rows, "path long, version long, text string")
    found, ledger = secrets.scan(versions, rules=secrets.BASE_RULES)
    spans = {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans[1, 1] == spans[1, 2] == [("assign", 0, 17)] and spans[3, 1] == []
    assert [k for k, _, _ in spans[2, 1]] == ["access", "assign"] and spans[4, 1] == [("hex", 4, 30)]
    assert ledger.count() == 4
    more = versions.unionAll(spark.createDataFrame([(5, 1, "secret: abcdef99")], versions.schema))
    again, new = secrets.scan(more, ledger, secrets.BASE_RULES)
    assert new.count() == 1 and again.count() == 6
    assert {tuple((s.kind, s.start) for s in r.spans) for r in again.collect() if r.path == 5} == {(("assign", 0),)}
    rules = (secrets.BASE_RULES[0]._replace(version=2), *secrets.BASE_RULES[1:])
    renewed, new = secrets.scan(versions, ledger, rules)
    assert {tuple(r.scanned) for r in new.collect()} == {("assign@2",)}
    assert {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.spans] for r in renewed.collect()} == spans
    text = spark.createDataFrame([("a token=abcdef99 b", [(2, 0, "assign", 16), (8, 1, "hex", 14)])],
                                 f"t string, s {secrets.SPAN}")
    assert text.select(secrets.redact(F.col("t"), F.col("s"))).first()[0] == "a [SECRET] b"


def test_op7_uses_no_python(spark):
    plan = queries.QUERIES["op7_secret_ledger"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- substrings --------------------------------------------------------------------------

def test_compact_windows_are_the_cartesian_tree():
    r = np.random.default_rng(2)
    for width in (1, 3, 8):
        h = r.integers(1, 12, 60).astype(np.uint64)
        begin = np.array([0, 5, 5, 33])
        got = set(zip(*(x.tolist() for x in substrings.compact_windows(h, begin, width))))
        want = set()
        for lo, hi in ((0, 5), (5, 33), (33, 60)):
            for c in range(lo, hi):
                a, b = c, c
                while a > lo and h[a - 1] > h[c]:
                    a -= 1
                while b + 1 < hi and h[b + 1] >= h[c]:
                    b += 1
                if b - a + 1 >= width:
                    want.add((a, c, b))
        assert got == want


def test_planted_passages(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    passage = [r.choice(vocab) for _ in range(70)]
    docs = {}
    for k in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(60, 300))]
        if k % 3 == 0:                              # a third of the documents share it, some with a changed word
            p = list(passage)
            if k % 9 == 0 and k:
                p[r.randrange(70)] = "changed"
            at = r.randint(0, len(w))
            w = w[:at] + p + w[at:]
        docs[k] = " ".join(w)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = substrings.near_duplicate_passages(frame).collect()
    assert {x.doc_id for x in rows} | {x.match_doc_id for x in rows} == {k for k in docs if k % 3 == 0}
    for x in rows:
        a = docs[x.doc_id].split()[x.start_word:x.end_word]
        b = docs[x.match_doc_id].split()[x.match_start:x.match_end]
        sa, sb = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert x.match_doc_id < x.doc_id and min(len(a), len(b)) >= 50
        assert abs(len(sa & sb) / len(sa | sb) - x.similarity) < 1e-12 and x.similarity >= 0.8
    cut = {x.doc_id: x.text for x in substrings.cut_passages(frame, spark.createDataFrame(rows)).collect()}
    middle = " ".join(passage[:20])
    assert [k for k, t in sorted(cut.items()) if middle in t] == [k for k in sorted(docs) if middle in docs[k]][:1]


def test_passages_round_a_common_phrase(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    docs, pairs = {}, []
    for g in range(12):                             # 15 documents share 30 or 40 words, two of them 60 words
        phrase = [word() for _ in range(30 + 10 * (g % 2))]
        side = [word() for _ in range(60 - len(phrase))]
        cut = r.randrange(len(side) + 1)
        pair = sorted(r.sample(range(3, 15), 2))
        for k in range(15):
            own = [word() for _ in range(200)]
            mid = side[:cut] + phrase + side[cut:] if k in pair else phrase
            at = r.randint(0, 200)
            docs[12 * k + g] = " ".join(own[:at] + mid + own[at:])
        pairs.append((12 * pair[1] + g, 12 * pair[0] + g))
    for parts in (1, 7):                            # in one task and across tasks
        frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts)
        rows = substrings.near_duplicate_passages(frame).collect()
        whole = {(x.doc_id, x.match_doc_id) for x in rows if x.end_word - x.start_word >= 60}
        assert whole == set(pairs)


def test_passages_with_a_changed_word(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    docs = []
    for k in range(400):                            # 50 words with the middle one changed: 0.80 alike
        p = [word() for _ in range(50)]
        q = p[:25] + [word()] + p[26:]
        docs += [(2 * k + n, " ".join([word() for _ in range(20)] + w + [word() for _ in range(20)]))
                 for n, w in enumerate((p, q))]
    rows = substrings.near_duplicate_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(x.doc_id, x.match_doc_id) for x in rows}
    assert found <= {(2 * k + 1, 2 * k) for k in range(400)} and len(found) >= 397


def test_every_alike_part_of_a_stretch_is_found():
    r = np.random.default_rng(5)
    word = lambda n: r.integers(1, 1 << 62, n).astype(np.uint64)
    for extra in (12, 18, 24):                      # words put in the middle, and four words changed
        a = word(200)
        b = a.copy()
        b[[2, 50, 149, 197]] = word(4)
        b = np.concatenate([b[:100], word(extra), b[100:]])
        for x, y in ((a, b), (b, a)):
            margin = word(50)
            got = substrings.verify(np.concatenate([margin, x, word(50)]), y)
            covered = set().union(*(range(p[0] - 50, p[1] - 50) for p in got))
            assert all(p[4] >= 0.8 and p[1] - p[0] >= 50 and p[3] - p[2] >= 50 for p in got)
            words = [k for k, w in enumerate(x.tolist()) if w in set(y.tolist())]
            assert len(set(words) - covered) <= 10
    a = word(300)                                   # the first 180 words are alike, more than half of the stretch
    b = a.copy()
    b[200::9] = word(len(b[200::9]))
    got = substrings.verify(a, b)
    assert max(p[1] - p[0] for p in got) >= 180


def test_op9_covers_exact_repeats(spark):
    docs = {k: t.encode().lower().split() for k, t in texts(spark, SF2).items()}
    where, cover = defaultdict(set), defaultdict(set)
    for k, w in docs.items():
        for i in range(len(w) - 49):
            where[tuple(w[i:i + 50])].add((k, i))
    rows = queries.QUERIES["op9_compact_windows"](spark, SF2).collect()
    for x in rows:
        cover[x.doc_id].update(range(x.start_word, x.end_word))
    shared = [(k, i) for ps in where.values() if len({k for k, _ in ps}) > 1
              for k, i in ps if k != min(d for d, _ in ps)]
    missed = [(k, i) for k, i in shared if not cover[k].issuperset(range(i, i + 50))]
    assert len(missed) <= 0.002 * len(shared) and {k for k, _ in shared} <= cover.keys()


# --- SQL ----------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    got, want = [tuple(r) for r in df.collect()], cur.fetchall()
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got, False) == rows_of(columns, want, False)
