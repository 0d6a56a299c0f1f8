"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before;
what it returns is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize
from packetloom.llm import alike, decontam, langid, packing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text in any of the learned languages is surer of one of them than this.
LEAST_LANGUAGE_SCORE = 0.3
#: Texts are long: so many rows, at most, are handed to a Python worker at once.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Bounds the memory of texts on their way to Python; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those no learned language stands out for; lang becomes what was found.

    NULL texts, empty ones and those without a letter have no language and go. Texts are
    read whole, however long; equal texts get the same answer, rows that repeat each stay.
    The model learns from the rows' own tags; where there is none, nothing stays. Other
    columns are dropped; an empty table gives an empty one.
    """
    _small_batches(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(F.lit(False)).select(*COLUMNS)
    told = docs.select(*COLUMNS).withColumn("__language", langid.label(F.col("text"), model))
    kept = told.filter((F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("__language.lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts linked by a similarity of 0.8 or more over five-word shingles.

    The row with the smallest doc_id stays, of several the one with the smallest text.
    Rows that share a doc_id but not their text are documents of their own. Rows with
    a NULL doc_id stay. NULL, empty and blank texts are one group, the texts without a
    word. Texts are compared whole. Other columns are dropped; an empty table gives an
    empty one.
    """
    _small_batches(spark)
    groups = materialize(alike.groups(docs), "groups")
    firsts = groups.groupBy("component").agg(F.min("first").alias("doc_id"))
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"))
    firsts = materialize(firsts.join(ids.hint("merge"), "doc_id"), "firsts")
    # the ids grow with the documents: the same join at every size, never a broadcast
    once = docs.join(firsts.filter("rows = 1").hint("merge"), "doc_id", "left_semi").select(*COLUMNS)
    # repeated ids are few as a rule: then only their rows are moved
    again = attach(docs, firsts.filter("rows > 1").select("doc_id").distinct(), ["doc_id"], "left_semi").withColumn("copy", alike.copy_of(F.col("text")))
    again = again.join(groups.select("copy", "component"), "copy").join(firsts.filter("rows > 1").select("component", "doc_id"), ["component", "doc_id"])
    twice = again.groupBy("component", "doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    unnamed = docs.filter(F.col("doc_id").isNull()).select(*COLUMNS)
    return once.unionByName(twice.select(*COLUMNS)).unionByName(unnamed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    NULL and empty texts hold none and stay; a long text is searched whole. Each row is
    judged for itself, repeated ones and NULL ids too. Other columns are dropped; an empty
    table, or an empty benchmark, gives the rows back.
    """
    _small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind; n_chars follows the new text.

    NULL texts stay NULL and have no n_chars. Texts are searched whole, every row for
    itself. Other columns are dropped; an empty table gives an empty one.
    """
    model = pii.train(docs)
    return pii.redact(docs, model).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens.

    NULL texts count as empty, and an empty text is one closing token. Long texts are cut,
    nothing is left out; rows that share a doc_id are packed each for itself. An empty
    table gives an empty one.
    """
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", language),
    ("SimHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", redact),
    ("packing", pack),
]

#: Trained models, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
