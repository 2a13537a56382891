"""Exact length histogram: how many documents have how many tokens, with suffix sums for every context limit."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from raretide.llm.common import small_batches, texts

# Lengths per block of the two-level suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text; a null text has 0 tokens. One map, no shuffle."""

    def run(batches):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in small_batches(batches):
            n = [len(encoding.encode_ordinary(t)) for t in texts(batch, text_column)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), pa.array(n, pa.int64())],
                                             [id_column, "n_tokens"])

    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame, length_column: str = "n_tokens") -> DataFrame:
    """One row per occurring length, with the sums that answer every context limit.

    ``n_docs`` documents have exactly ``n_tokens`` tokens. ``docs_at_least`` and ``tokens_at_least`` are suffix sums
    over this length and all longer ones, ``docs_up_to`` counts this length and all shorter ones, and
    ``truncated_tokens`` is what is left of all documents when each is cut to ``n_tokens`` tokens.

    Rows with a null length are not counted; an empty table gives no rows. Documents are counted before anything is
    shuffled, so a length shared by a third of all documents is one row per task. The suffix sums run within blocks
    of lengths and over the block totals, so no task sees more than one block or one row per block.
    """
    counts = (
        lengths.select(F.col(length_column).cast("long").alias("n_tokens")).where(F.col("n_tokens").isNotNull())
        .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    )
    totals = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.coalesce(F.sum("block_docs").over(earlier), F.lit(0)).alias("earlier_docs"),
        F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("earlier_tokens"),
    )
    suffix = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    prefix = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    docs_at_least = F.sum("n_docs").over(suffix) + F.col("later_docs")
    shorter_tokens = F.sum("tokens").over(prefix) + F.col("earlier_tokens") - F.col("tokens")
    return counts.join(totals, "block").select(
        "n_tokens", "n_docs",
        docs_at_least.alias("docs_at_least"),
        (F.sum("tokens").over(suffix) + F.col("later_tokens")).alias("tokens_at_least"),
        (F.sum("n_docs").over(prefix) + F.col("earlier_docs")).alias("docs_up_to"),
        (shorter_tokens + F.col("n_tokens") * docs_at_least).alias("truncated_tokens"),
    )


def totals_at(histogram: DataFrame, limit: int) -> DataFrame:
    """Answers for one context limit out of the histogram alone: documents, tokens, tokens after the cut, documents cut."""
    n, docs = F.col("n_tokens"), F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(docs), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(n * docs), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * docs), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(n > limit, docs)), F.lit(0)).alias("docs_cut"),
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents does not exceed; null for no documents."""
    total = F.col("docs_up_to") + F.col("docs_at_least") - F.col("n_docs")  # the same on every row
    return histogram.where(F.col("docs_up_to") >= F.lit(q) * total).agg(F.min("n_tokens").alias("n_tokens"))
