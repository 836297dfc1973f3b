"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sparkcollide.llm import bpe, conversations, fingerprints, jaccard, kneser_ney, nearest, packing, periods, secrets, substring, toxicity, url_filter, vectors
from sparkcollide.session import table

VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    return os.path.join(VOCABULARIES, name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op1_url_filter(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2_secrets(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3_best_fit(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op4_jaccard(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op6_substring(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op7_bpe(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.op8_vectors(table(spark, sf_dir, "embeddings"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.op9_language_model(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op10_fingerprints(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op11_repair(table(spark, sf_dir, "conversations"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.op12_runs(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.op13_nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1,
    "op2_secret_scan": op2,
    "op3_best_fit_packing": op3,
    "op4_jaccard_join": op4,
    "op5_toxicity": op5,
    "op6_substring_dedup": op6,
    "op7_bpe": op7,
    "op8_embedding_dedup": op8,
    "op9_language_model": op9,
    "op10_fingerprints": op10,
    "op11_conversation_repair": op11,
    "op12_periodic_runs": op12,
    "op13_nearest_neighbours": op13,
}
ORACLES: dict[str, str] = {"op1_url_filter": url_filter.ORACLE}
