"""Corpus pipeline: each stage applies one operator to all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes every stage below
spark.checkpoint.dir and reads it again, so a lost executor repeats part of one
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcollide.llm import jaccard, packing, secrets, substring, toxicity
from sparkcollide.llm.queries import vocabulary
from sparkcollide.session import cut_lineage, table

SECRET = "[secret]"


def _documents(rows: DataFrame, text) -> DataFrame:
    """Columns of documents; n_chars follows the text."""
    return rows.select("doc_id", text.alias("text"), "carry.lang", "carry.source", F.length(text).cast("long").alias("n_chars"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects (score 0.5 or more); texts stay as they are."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    kept = toxicity.score(docs, model, ("lang", "source", "n_chars"), keep_text=True).where("score < 0.5")
    return kept.select("doc_id", "text", "carry.lang", "carry.source", "carry.n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; repeated rows count once."""
    groups = jaccard.link_groups(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("d"), F.col("th").alias("h")).distinct()
    keyed = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(groups, keyed["doc_id"].eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_h"]).select("doc_id", "text", "lang", "source", "n_chars")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages of 35 or more words that also start elsewhere; documents stay, some with an empty text.

    Words are joined by one space. A text from which nothing is cut stays as it is.
    """
    rows = substring.remove_repeats(docs, carry=("lang", "source"), whole=True)
    return _documents(rows, F.col("kept"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each found secret by a mark; documents stay."""
    rows = secrets.scan(docs, vocabulary("word_bpe_49k.json"), redact=SECRET, carry=("lang", "source"))
    return _documents(rows, F.col("redacted"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.op3_best_fit(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("jaccard_join", near_duplicates), ("substring_dedup", repeats), ("secret_scan", hide_secrets), ("best_fit_packing", pack)]

#: A trained kernel, exact word windows and a tokenizer have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
