"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

The classifier is fitted on a bounded sample of labelled rows and scores every whole text in one map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raretide.llm.common import byte_windows, gram_buckets, labelled_sample, letter_bytes, small_batches, texts

ORDERS, BITS = (3, 5), 19
# Labelled rows used for fitting, at most: those with the smallest hash of the id.
FIT_ROWS = 20_000
# An n-gram is used when its log-count ratio is at least this, and this many standard errors from zero.
MIN_RATIO, MIN_DEVIATIONS = 0.7, 3.5
ROUNDS, STEP, RIDGE = 200, 0.3, 1e-3


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    weights: np.ndarray  # per bucket: log-count ratio times coefficient; 0 where the n-gram is not used


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of the text, repeats included."""
    data = letter_bytes(text)
    windows = byte_windows(data)
    return np.concatenate([gram_buckets(windows[: max(0, len(data) - k + 1)], k, BITS) for k in ORDERS])


def features(text: str, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used buckets that occur in the text, and for each ln(1 + occurrences)."""
    found = grams(text)
    buckets, n = np.unique(found[used[found]], return_counts=True)
    return buckets, np.log1p(n)


def ratio_table(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Occurrences per bucket in rows labelled 1 and 0, and the numbers of such rows."""
    schema = pa.schema([("bucket", pa.int32()), ("ones", pa.int64()), ("zeros", pa.int64())])

    def run(batches):
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in small_batches(batches):
            for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                side = counts[0 if label else 1]
                np.add.at(side, grams(text), 1)
                side[-1] += 1  # rows
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], schema=schema)

    sums = sample.mapInArrow(run, "bucket int, ones bigint, zeros bigint").groupBy("bucket").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()
    table = np.zeros((2, (1 << BITS) + 1), np.int64)
    bucket = sums.column("bucket").to_numpy()
    table[0, bucket], table[1, bucket] = sums.column("ones").to_numpy(), sums.column("zeros").to_numpy()
    return table[0, :-1], table[1, :-1], int(table[0, -1]), int(table[1, -1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", where: Column | None = None, rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows (``where`` is a condition on ``__id``, the id).

    Log-count ratios are summed by Spark; the driver gets two counts per bucket and, for the bounded sample, the used
    n-grams of each row, and runs the gradient steps. Without rows of both labels the score is a constant: the
    smoothed share of ones.
    """
    sample = labelled_sample(docs, labels, F.col(label_column).cast("int"), id_column, text_column, where, rows)
    p, q, ones, zeros = ratio_table(sample)
    intercept = float(np.log((ones + 1) / (zeros + 1)))
    ratio = np.log((p + 0.5) / (p.sum() + 0.5)) - np.log((q + 0.5) / (q.sum() + 0.5))
    used = (np.abs(ratio) >= MIN_RATIO) & (np.abs(ratio) >= MIN_DEVIATIONS * np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)))
    if not ones or not zeros or not used.any():
        return ToxicityModel(intercept, np.zeros(1 << BITS))

    def run(batches):
        for batch in small_batches(batches):
            found = [features(t, used) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.float64()))], ["label", "buckets", "values"])

    rows_read = sample.mapInArrow(run, "label int, buckets array<int>, values array<double>").toArrow()
    y = (rows_read.column("label").to_numpy() > 0).astype(float)
    lists = rows_read.column("buckets").combine_chunks()
    index = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    value, size = ratio[index] * rows_read.column("values").combine_chunks().flatten().to_numpy(), 1 << BITS
    w, b, seen, seen_b = np.zeros(size), intercept, np.full(size, 1e-8), 1e-8
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[index], len(y)) + b, -500, 500))) - y
        slope = np.bincount(index, error[row] * value, size) + RIDGE * w
        seen += slope * slope
        w -= STEP * slope / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= STEP * error.sum() / np.sqrt(seen_b)
    return ToxicityModel(float(b), np.where(used, w * ratio, 0.0))


def predict(docs: DataFrame, model: ToxicityModel, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) behind them.

    A null text is scored as the empty one, which has no n-grams: the intercept alone. Rows are neither dropped nor
    merged; existing columns named ``score`` or ``predicted`` are replaced.
    """
    weights, intercept, used = model.weights.astype(np.float32), model.intercept, model.weights != 0

    def run(column: pa.Array) -> pa.Array:
        found = (features(t or "", used) for t in column.to_pylist())
        z = np.array([intercept + float(weights[buckets] @ value) for buckets, value in found], float)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

    scored = docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text_column)))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
