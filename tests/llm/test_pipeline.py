"""Every stage of the pipeline against a brute-force version on the smallest tables."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetsight.llm import queries
from test_methods import brute_simhash, plain_score

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The documents and what each stage leaves."""
    base, out = tmp_path_factory.mktemp("pipeline"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_toxic_documents_go(spark, tables):
    model = queries.toxicity_model(spark, SF)
    want = {k for k, r in rows(tables[0]).items() if plain_score(model, r.text) < 0.5}
    assert rows(tables[1]).keys() == want and len(want) < tables[0].count()


def test_one_of_each_group_stays(tables):
    groups = brute_simhash({k: r.text or "" for k, r in rows(tables[1]).items()})
    assert rows(tables[2]).keys() == {c for _, c in groups.values()}


def test_repeated_passages_are_cut(tables):
    before, after = rows(tables[2]), rows(tables[3])
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text or "") for r in after.values())
    where = {}
    for k, r in sorted(after.items()):
        w = (r.text or "").encode().lower().split()
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i:i + 50]), set()).add(k)
    old = {}
    for k, r in sorted(before.items()):
        w = (r.text or "").encode().lower().split()
        for i in range(len(w) - 49):
            old.setdefault(tuple(w[i:i + 50]), set()).add(k)
    left, had = (sum(len(v) > 1 for v in x.values()) for x in (where, old))
    assert had > 0 and left <= 0.01 * had
    shared = {k for v in old.values() if len(v) > 1 for k in v}
    same = [k for k in before if k not in shared and before[k].text == after[k].text]
    assert len(same) >= 0.9 * len(before.keys() - shared)     # near-duplicate passages may change a few more


def test_secrets_are_masked(tables):
    before, after = rows(tables[3]), rows(tables[4])
    for k, r in after.items():
        text = r.text or ""
        assert all(len(m[1]) < 6 for m in ASSIGN.finditer(text)), text
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", text)
        if "[SECRET]" not in text:
            assert text == (before[k].text or "")


def test_sequences_hold_the_documents(tables):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in tables[5].collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for k, r in rows(tables[4]).items():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert b"".join(b for _, b in sorted(got.pop(k))) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert not got


def test_run_gives_the_last_table(spark, tables):
    key = ["doc_id", "start", "length", "ids"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect())) == sorted(
        map(tuple, tables[-1].select(key).collect()))


def test_stages_take_nulls_repeats_and_clashing_names(spark, tmp_path_factory):
    """Rows that share an id but no group are decided on their own; other columns come through unchanged."""
    base = tmp_path_factory.mktemp("edges")
    long, other = ("".join(f"{w}{k} " for k in range(60)) for w in ("alpha", "beta"))
    rows = [(1, long), (1, other), (1, other), (2, long), (3, None), (4, ""), (None, long), (None, None), (5, "one two three"),
            (6, other + " password = hunter2secret"), (6, None)]
    names = ["salt", "spans", "blob", "_id", "_rows", "_doc", "_spans", "_text", "_score", "score", "copy", "rest", "h"]
    docs = spark.createDataFrame([(*r, "en", "s", 1 if r[1] is None else len(r[1])) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).withColumn(
        "tags", F.create_map(F.lit("k"), F.col("doc_id")))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{base}/{empty}-{k}"
            stage(spark, now, SF).write.parquet(out)
            after = spark.read.schema(now.schema).parquet(out) if k < 4 else spark.read.parquet(out)
            if k < 4:
                assert after.columns == docs.columns
                got = after.collect()
                assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in names)
                assert all(r.n_chars == (1 if r.text is None else len(r.text)) for r in got)
                if name == "simhash_near_dedup" and not empty:
                    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in got) == sorted(
                        [(0, ""), (0, "alpha"), (1, "alpha"), (1, "beta0"), (3, ""), (5, "one t"), (6, "beta0")])
                if name == "secret_scan" and not empty:
                    assert not any("hunter2" in (r.text or "") for r in got)
            now = after
        assert empty == now.isEmpty()
