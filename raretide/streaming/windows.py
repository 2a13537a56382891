"""Window totals and distinct-count sketches of a transaction stream: batch aggregates with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raretide.functions.scalars import parse_window
from raretide.operators.windows import WINDOW


def fixed_minutes(window: str) -> int:
    unit, n = parse_window(window)
    if unit != "minutes":
        raise ValueError(f"a streaming window needs a fixed length, not {window!r}")
    return n


def watermarked(df: DataFrame, lateness: str, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def by_window(df: DataFrame, column: str, window: str, aggregates: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``aggregates`` per window. The group is the window itself, which the watermark ends, and not its start alone."""
    found = df.groupBy(F.window(column, f"{fixed_minutes(window)} minutes").alias("_window"), *by).agg(*aggregates)
    return found.select(F.col("_window.start").alias(WINDOW), *[c for c in found.columns if c != "_window"])


def stream_window_totals(
    df: DataFrame, window: str = "360m", lateness: str = "1 hour", column: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """transactions, frauds and total_amount per tumbling window (and value of ``by``) of a streaming (or batch) table.

    State is one row per open window; a window is final once the watermark has passed its end. A zone-free
    event time becomes an instant in the session zone, which watermarks need: keep that zone at UTC.
    """
    aggregates = [F.count("amount").alias("transactions"), F.sum("target").alias("frauds"), F.sum("amount").alias("total_amount")]
    return by_window(watermarked(df, lateness, column), column, window, aggregates, by)


def stream_key_sketches(
    df: DataFrame, keys: Sequence[str], window: str = "360m", lateness: str = "1 hour", column: str = "date", bits: int = 12
) -> DataFrame:
    """One HyperLogLog sketch per window and key column, as ``sketch_<key>``, with ``null_<key>`` (1 if a null occurred).

    The state of an open window is at most 2^``bits`` bytes a key, however many rows arrive. The relative standard error is
    1.04 / sqrt(2^``bits``), 1.6 % by default. Write the windows out to merge them later with :func:`sketched_counts`.
    """
    aggregates = []
    for k in keys:
        # whole numbers share one type, so that sketches of int and bigint columns can be merged
        key = F.col(k).cast("bigint") if dict(df.dtypes)[k] in ("tinyint", "smallint", "int", "bigint") else F.col(k).cast("string")
        aggregates += [F.hll_sketch_agg(key, bits).alias(f"sketch_{k}"), F.max(F.col(k).isNull().cast("int")).alias(f"null_{k}")]
    return by_window(watermarked(df, lateness, column), column, window, aggregates)


def sketched_counts(sketches: DataFrame, keys: Sequence[str], window: str) -> DataFrame:
    """Estimated ``unique_<key>`` per window of a multiple of the sketches' own length, a null counting as one value."""
    estimates = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{k}")) + F.max(f"null_{k}") for k in keys]
    return by_window(sketches, WINDOW, window, [e.alias(f"unique_{k}") for e, k in zip(estimates, keys)])
