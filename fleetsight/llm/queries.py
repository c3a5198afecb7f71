"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm import (divergence, embeddings, filter_audit, html, langid, lexicon, packing, pii, quality, secrets,
                            simhash, substrings, toxicity)
from fleetsight.llm.ship import ship_package
from fleetsight.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def _in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


@register("op8_quality_rules", f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, t, words, lines, row_number() OVER () AS r FROM w),
pos AS (
  SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM g WHERE len(words) >= 3),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n >= 2) GROUP BY r),
s AS (
  SELECT g.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({_in_list({w for ws in quality.STOP_WORDS.values() for w in ws})})))
           AS n_stop,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 20.0
         AND n_symbols::DOUBLE / n_words <= 0.3
         AND n_stop::DOUBLE / n_words >= 0.02
         AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5) AS kept
FROM s
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op1_cost_balanced_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenized and packed into sequences of at most 2048 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register("op2_dom_marginals")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages)).select("page_id", "url", "text", "n_chars")


@register("op3_lexicon_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    both = lexicon.round_trip(docs, path, lexicon.build_lexicon(docs, path))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op5_pca_tiles", """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) AS (SELECT r, r FROM e UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT reach.x AS r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.y GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = e.r) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c USING (r)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link count and near-duplicate component of every vector."""
    return embeddings.embedding_groups(read_table(spark, sf_dir, "embeddings"))


@register("op6_simhash_tiles")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_SQL_ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") \
    + "_?" + _any_case("key") + ")[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SQL_RULES = [("assign", _SQL_ASSIGN)] + [(r.kind, r.pattern) for r in secrets.RULES[1:]]


def _sql_found(rules, table: str = "d") -> str:
    """Places of the matches of each (kind, pattern) in the texts ``t`` of ``table``."""
    return " UNION ALL ".join(f"""
  SELECT r, {k} AS rank, '{kind}' AS kind, gap, hit, i, sum(length(gap) + coalesce(length(hit), 0))
           OVER (PARTITION BY r ORDER BY i) AS "end"
  FROM (SELECT r, unnest(string_split_regex(t, '{pattern}')) AS gap,
               unnest(list_append(regexp_extract_all(t, '{pattern}'), NULL)) AS hit,
               generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i FROM {table})"""
                              for k, (kind, pattern) in enumerate(rules))


_SQL_FOUND = _sql_found(_SQL_RULES)


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@register("op4_kneser_ney_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(_crc_mod(3) == 1, F.lit(False))
    models = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), models).select(
        "doc_id", "held_out", "lang_pred", "score")


@register("op7_secret_ledger", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT r, rank, kind, "end" - length(hit) AS start, "end" FROM ({_SQL_FOUND})
  WHERE hit IS NOT NULL AND (kind <> 'assign' OR length(regexp_extract(hit, '{_SQL_ASSIGN}', 2)) >= 6)),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
         count(*) FILTER (kind = 'hex') AS h,
         string_agg(concat_ws(':', kind, start::BIGINT, "end"::BIGINT), ',' ORDER BY start, rank)
           FILTER (rank < 3) AS base,
         string_agg(concat_ws(':', kind, start::BIGINT, "end"::BIGINT), ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned with an empty ledger."""
    found, _ = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


@register("op9_compact_windows")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that repeat one of a document with a smaller id."""
    return substrings.near_duplicate_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """The model that the query and the pipeline use: learned from the rows that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels.where(_crc_mod(5) != 0))


@register("op10_ngram_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select(
        "doc_id", "text", F.coalesce(_crc_mod(5) == 0, F.lit(False)).alias("held_out")),
        toxicity_model(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_SQL_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@register("op11_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{_SQL_TERM}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gk AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang
       FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
gn AS (SELECT lang, source, sum(n) AS total FROM gk GROUP BY ALL),
p AS (SELECT lang, source, term, gk.n,
             1 + (1000000000::HUGEINT * (gk.n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (n_lang + 5)::HUGEINT) // (v.n + 5 * v)::HUGEINT AS q
      FROM gk JOIN gn USING (lang, source) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
f AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM f QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary distance of every pair of sources of a language, and each source's own terms."""
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


@register("op12_filter_interaction", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
               + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
               + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS mask,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d JOIN m USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(o, '') AS filter_order, step::INT AS step, 1 << (ascii(o[step]) - 65) AS own,
             coalesce(list_sum(list_transform(o[:step - 1], lambda l: 1 << (ascii(l) - 65))), 0)::INT AS before
      FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, own, n, good, toxic, mask & own <> 0 AS fails, mask & before = 0 AS reached,
             mask = own AS alone FROM c, s),
a AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (reached AND NOT fails), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (reached AND fails), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (NOT reached AND fails), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (reached AND fails), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (reached AND fails), 0)::BIGINT AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM a
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, per source."""
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_SQL_PII = _sql_found([
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"),
    ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)"),
    ("card", "[0-9]([\\x20-]?[0-9])+"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]")])
_SQL_WORDS = _sql_found([("word", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")], "held")
_SQL_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op13_pii_disclosure", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hit AS (SELECT r, rank, kind, "end" - length(hit) AS start, "end", hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits
        FROM ({_SQL_PII}) WHERE hit IS NOT NULL),
base AS (
  SELECT r, rank, kind, start, "end",
         kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE hit END AS entity
  FROM hit WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3
                       OR coalesce(try_cast(left(ltrim(p, '0'), 3) AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(
      range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INT
                                              WHEN digits[-i]::INT > 4 THEN 2 * digits[-i]::INT - 9
                                              ELSE 2 * digits[-i]::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 ELSE true END),
held AS (SELECT r, t FROM d WHERE r IN (SELECT r FROM base)),
word AS (SELECT w.r, w."end" - length(w.hit) AS start, w."end", {_SQL_FOLD.format('w.hit')} AS term
         FROM ({_SQL_WORDS}) w WHERE w.hit IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM base b WHERE b.r = w.r AND b.start < w."end" AND w."end" - length(w.hit) < b."end")),
pos AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY start) AS i FROM word),
near_at AS (SELECT b.r, b.entity, b.start, b."end", count(p.i) AS k
       FROM base b LEFT JOIN pos p ON p.r = b.r AND p.start < b.start GROUP BY ALL),
link AS (SELECT DISTINCT a.r, entity, term FROM near_at a JOIN pos p ON p.r = a.r
           AND p.i BETWEEN k - {pii.WINDOW} + 1 AND k + {pii.WINDOW}),
n AS (SELECT count(*) AS n FROM d),
ne AS (SELECT entity, count(DISTINCT r) AS ne FROM base GROUP BY entity),
nb AS (SELECT entity, term, count(*) AS nb FROM link GROUP BY ALL HAVING count(*) >= {pii.SUPPORT}),
nt AS (SELECT term, count(DISTINCT r) AS nt FROM (
         SELECT r, unnest(regexp_extract_all({_SQL_FOLD.format('t')},
                   '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d) GROUP BY term),
told AS (SELECT entity, term, ln(nb * n::DOUBLE / (ne * nt)) / ln(n::DOUBLE / ne) AS share
         FROM nb JOIN ne USING (entity) JOIN nt USING (term), n WHERE ne < n),
best AS (SELECT r, term, max(share) AS share FROM link JOIN told USING (entity, term)
         WHERE share >= {pii.GENERALISE} GROUP BY ALL),
span AS (SELECT r, rank, kind, start, "end" FROM base
         UNION ALL SELECT r, CASE WHEN share >= {pii.REMOVE} THEN 5 ELSE 4 END,
                          CASE WHEN share >= {pii.REMOVE} THEN 'removed' ELSE 'generalised' END, start, "end"
         FROM pos JOIN best USING (r, term)),
g AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
             count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
             string_agg(concat_ws(':', kind, start::BIGINT, "end"::BIGINT), ',' ORDER BY rank, start)
               FILTER (rank < 4) AS base,
             string_agg(concat_ws(':', kind, start::BIGINT, "end"::BIGINT), ',' ORDER BY rank, start) AS spans
      FROM span GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    found = pii.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(pii.KINDS))
    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))
