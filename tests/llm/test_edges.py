"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from fleetsight.llm import embeddings, html, langid, lexicon, packing, quality, secrets, simhash, substrings, toxicity

BYTE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = "the long text goes on " * 4000

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("score", StringType()),
                   StructField("ids", StringType()), StructField("spans", StringType()),
                   StructField("kept", StringType()), StructField("fp", StringType())])
ROWS = [(1, None, None, "x", "x", "x", "x", "x"), (2, "", "en", None, "x", "x", "x", "x"),
        (3, LONG, "en", "x", None, "x", "x", "x"), (3, LONG, "en", "x", None, "x", "x", "x"),
        (None, "a text without an id", "fr", "x", "x", "x", "x", "x"), (4, " \n\t ", "fr", "x", "x", "x", "x", "x"),
        (5, "\U0001F600 é̂ 漢字 <|endoftext|> \x00 x", "en", "x", "x", "x", "x", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_packing(docs, empty):
    rows = packing.pack(docs, BYTE, RANKS).collect()
    assert len([r for r in rows if r.doc_id == 1]) == 1 and next(r for r in rows if r.doc_id == 1).doc_tokens == 1
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * next(r for r in rows if r.doc_id == 3).doc_tokens
    assert [r.doc_tokens for r in rows if r.doc_id is None] != []
    assert packing.pack(empty, BYTE, RANKS).count() == 0


def test_html(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    pages = spark.createDataFrame([
        (1, None, None, "x", 1), (2, "u", "", "x", 1), (3, "u", "<p", "x", 1), (None, "u", "&am &amp", "x", 1),
        (4, "u", "<article><p>" + "Long text goes on. " * 50_000 + "</article>", "x", 1),
        (5, "u", "<div>" * 5000 + "deep" + "</div>" * 5000, "x", 1)], schema)
    model = html.fit(pages, built=60)
    got = {r.page_id: r for r in html.extract(pages, model).collect()}
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[4].n_chars == len(got[4].text) == len("Long text goes on. " * 50_000) - 1
    assert html.extract(pages.limit(0), html.fit(pages.limit(0), built=60)).count() == 0


def test_lexicon(docs, empty):
    name = lexicon.build_lexicon(docs, WORD)
    rows = lexicon.round_trip(docs, WORD, name).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 3, 4, 5]
    assert next(r for r in rows if r.doc_id == 1).ids == [] and next(r for r in rows if r.doc_id == 1).decoded == ""
    assert lexicon.encode(empty, WORD, lexicon.build_lexicon(empty, WORD)).count() == 0


def test_language(docs, empty):
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 4)} == {"und"} and {r.score for r in got if r.doc_id == 1} == {0.0}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(empty, langid.fit(docs)).count() == 0


def test_embeddings(spark):
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                         StructField("label", IntegerType()), StructField("n_links", IntegerType())])
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, 9), (2, [], 0, 9), (3, [0.0, 0.0], 0, 9), (4, [nan, 1.0], 0, 9), (5, [inf, 1.0], 0, 9),
            (6, [None, 1.0], 0, 9), (7, [1.0, 0.0], None, 9), (8, [1.0, 0.0], 0, 9), (8, [1.0, 0.0], 0, 9),
            (9, [2.0, 0.0], 0, 9), (10, [1.0, 0.0], 1, 9), (11, [1.0], 0, 9), (None, [1.0, 0.0], 0, 9),
            (12, [1e-30, 0.0], 0, 9)]
    v = spark.createDataFrame(rows, schema)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(v).collect())
    assert got == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)]
                         + [(8, 4, 8, True), (8, 4, 8, True), (9, 4, 8, False), (0, 4, 8, False), (12, 4, 8, False)])
    assert embeddings.embedding_groups(v.limit(0)).count() == 0


def test_simhash(docs, empty):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert {(1, 0, 1), (2, 0, 1), (4, 0, 1)} <= got and len({c for d, _, c in got if d == 3}) == 1
    assert simhash.simhash_groups(empty).count() == 0


def test_secrets(spark, docs, empty):
    found, new = secrets.scan(docs, keep_text=True)
    assert found.count() == len(ROWS) and new.count() == 5      # null and empty are one blob, so are the two long rows
    assert set(found.columns) >= set(DOCS.fieldNames())
    assert secrets.scan(empty)[0].count() == 0


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[4].n_words == 0
    assert got[3].n_words == 20_000 and got[3].n_repeat_words == 20_000 and got[3].base_failed
    assert quality.quality_rules(empty).count() == 0


def test_substrings(docs, empty):
    assert substrings.near_duplicate_passages(docs).count() == 0       # the repeated row is the same document
    assert substrings.near_duplicate_passages(empty).count() == 0
    cut = substrings.cut_passages(docs, substrings.near_duplicate_passages(docs))
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_toxicity(spark, docs, empty):
    none = toxicity.fit(docs, labels(spark, []))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    one = toxicity.fit(docs, labels(spark, [(3, 1), (2, 1), (1, None), (None, 1)]))
    assert all(0.5 < r.score < 1 for r in toxicity.score(docs, one).collect())
    both = toxicity.fit(docs, labels(spark, [(3, 1), (3, 0), (2, 0)]))
    scored = toxicity.score(docs, both)
    assert scored.where(F.col("score").isNull()).count() == 0 and set(scored.columns) == set(DOCS.fieldNames()) - {"text"}
    assert toxicity.score(empty, both).count() == 0
