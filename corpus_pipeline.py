"""The corpus pipeline: five stages from raw documents to token counts, each a Spark job over what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from raretide.llm import bpe, exact_dedup, language, mixing, near_dedup
from raretide.llm.common import fold, stage, table
from raretide.llm.queries import ANCHOR, DOMAIN_SQL, RANKS, WEIGHTS

# A text is rejected if it has no letters or less than this share of it is in its main language.
LEAST_LANGUAGE_SHARE = 0.3


# Stand-ins of null and repeated ids lie above all ids of a corpus that numbers its documents.
STAND_INS = 1 << 62


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told; others go. One map over the rows after the fit.

    Every row is judged by its own text, so null and repeated ids do not matter; null texts and those without letters
    go. An empty table stays empty.
    """
    model = language.fit(docs, where=fold("doc_id", 4) != 2)
    told = language.predict(docs, model, prefix="__")
    return told.where((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SHARE)).select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts: the one with the largest id.

    The verdict belongs to id and text, so another text under the same id has its own. A group in which no row has an id
    keeps one of them; of rows that repeat id and text one stays. A null text counts as the empty one.
    """
    judged = exact_dedup.exact_duplicates(docs).where("kept OR (doc_id IS NULL AND keep_id IS NULL)")
    kept = stage(judged.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")), "kept-texts")
    named = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))

    def among(keys: DataFrame) -> DataFrame:
        return named.join(keys, named.doc_id.eqNullSafe(keys.doc_id) & (named["__sha"] == keys.text_sha256), "left_semi")

    once, repeated = among(kept.where("n = 1")), kept.where("n > 1")
    if not repeated.isEmpty():
        once = once.union(among(repeated).dropDuplicates(["doc_id", "__sha"]))
    return once.select(docs.columns)


def _own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id``: the id where one row alone has it; for null and repeated ids a hash of id and text."""
    repeated = stage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "repeated-ids")
    own = F.col("doc_id").isNotNull()
    if not repeated.isEmpty():
        docs = docs.join(repeated, "doc_id", "left")
        own &= F.col("__n").isNull()
    made = F.lit(STAND_INS) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    return docs.withColumn("__id", F.when(own, F.col("doc_id").cast("bigint")).otherwise(made))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id.

    Rows with a null id, and different texts under one id, are documents of their own. They come after all others, so
    a class keeps one of them only if it has no row with an id of its own. Rows equal in id and text, which the stage
    before leaves none of, share a verdict. Texts without words form one class.
    """
    named = _own_ids(docs)
    kept = near_dedup.near_duplicates(named.select("__id", "text"), id_column="__id").where("kept")
    return named.join(kept.select("__id"), "__id", "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: rates below 1 leave some out, rates above 1 repeat some.

    The rate is that of the text; which documents of a fractional rate go is decided by a hash of the id. Null texts count
    as empty. An empty table stays empty.
    """
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN_SQL), WEIGHTS, anchor=ANCHOR)
    repeated = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return mixed.where("__copies > 0").select(*docs.columns, repeated).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents, one row per copy; a null text has no tokens."""
    return bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]

# Learned models and tokenizers are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
