"""The training-data pipeline: five stages over ``documents``, each calling one operator of ``fleetsight.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm import packing, secrets, simhash, substrings, toxicity
from fleetsight.llm.queries import toxicity_model
from fleetsight.llm.ship import ship_package
from fleetsight.session import checkpoint_dir
from fleetsight.sources.tables import read_table

TOXIC = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs meets a working column of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("rest"))


def _unpacked(packed: DataFrame, docs: DataFrame, recount: bool = False) -> DataFrame:
    """The columns of ``docs`` again; with ``recount`` n_chars follows the text (of a null text it stays)."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns}
    if recount and "n_chars" in own:
        own["n_chars"] = F.when(F.col("text").isNull(), own["n_chars"]).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType))
    return packed.select(*[v.alias(c) for c, v in own.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship_package(spark)
    scored = toxicity.score(_packed(docs).withColumn("copy", F.col("text")), toxicity_model(spark, sf_dir), "copy")
    return _unpacked(scored.where(F.col("score") < TOXIC), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; of several rows with that id in one
    group, one. Rows are told apart by id and text, so rows that share an id but not a group are decided on
    their own. Rows without an id stay."""
    ship_package(spark)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", h.alias("h")))
    groups = simhash.simhash_groups(docs.select(row.alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("times")).select(
        F.col("doc_id.doc_id").alias("kept_id"), F.col("doc_id.h").alias("kept_h"), "times")
    packed = _packed(docs).withColumn("h", h)
    stay = packed.join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("h") == F.col("kept_h")))
    out = stay.where("times = 1").unionByName(stay.where("times > 1").dropDuplicates(["doc_id", "h"]))
    return _unpacked(out, docs).unionByName(docs.where(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of a document with a smaller id are cut out; n_chars follows the text (a null text
    keeps its own)."""
    ship_package(spark)
    packed = _packed(docs)
    return _unpacked(substrings.cut_passages(packed, substrings.near_duplicate_passages(packed)), docs, recount=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text (a null text keeps its own)."""
    ship_package(spark)
    found, _ = secrets.scan(_packed(docs), keep_text=True)
    return _unpacked(found.withColumn("text", secrets.redact(F.col("text"), F.col("spans"))), docs, recount=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece."""
    ship_package(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

# Byte-pair encoding and the trained classifier are not SQL; tests/llm/test_pipeline.py holds every stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; the tables between them lie in the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            _delete(spark, before)                 # its successor holds what is kept
        before = out
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
