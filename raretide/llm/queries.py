"""The registered queries of this package and the SQL that checks them: one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from raretide.llm import bpe, divergence, exact_dedup, language, lengths, licenses, mixing, near_dedup, quality, set_join, spelling, templates, toxicity
from raretide.llm.common import fold, table
from raretide.llm.sql import DIVERGENCE_SQL, EXACT_DEDUP_SQL, JACCARD_SQL, LICENSE_SQL, QUALITY_SQL

RANKS = "byte_bpe_50k.tiktoken"

# Domains of the mix, from the label table, and their shares of the tokens.
DOMAIN_SQL = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END"
WEIGHTS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
ANCHOR = "good"  # the mix is as large as all good documents allow


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return verdicts.drop("char_distance", "word_distance")


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(DOMAIN_SQL), WEIGHTS, anchor=ANCHOR)
    shares = [(F.col("__mix.p")[i] / mixing.GRID).alias(f"p_{name}") for i, name in enumerate(WEIGHTS)]
    return mixed.select("doc_id", F.col("__mix.n_tokens").alias("n_tokens"), *shares, F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, where=fold("doc_id", 4) != 2)
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return language.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=fold("__id", 3) != 1)
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return toxicity.predict(rows, model).select("doc_id", "held_out", "score", "predicted")


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lengths.length_histogram(lengths.encoded_lengths(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_pages(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_divergence, op2_soft_mixing, op3_chunk_recipes, op4_license_scan, op5_language_mixture, op6_toxicity_ratio,
    op7_length_histogram, op8_probminhash, op9_page_templates, op10_byte_bpe,
    op11_source_divergence, op12_jaccard_components, op13_spelling_variants)}
ORACLES = {"op1_quality_divergence": QUALITY_SQL, "op3_chunk_recipes": EXACT_DEDUP_SQL, "op4_license_scan": LICENSE_SQL,
           "op11_source_divergence": DIVERGENCE_SQL, "op12_jaccard_components": JACCARD_SQL}
