"""Tumbling-window aggregates of transactions. Every feature of a window comes from one group-by."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raretide.functions import scalars as S

# Column scales, the other numeric columns, and the window sizes of the count study.
SCALE_FACTORS = {
    "amount": 1_000,
    "per_capita_income": 1_000,
    "total_debt": 10_000,
    "credit_score": 100,
    "credit_limit": 10_000,
}
UNSCALED_COLUMNS = ("current_age", "num_credit_cards")
WINDOW_MINUTES = (15, 30, 60, 90, 120, 180, 240, 300, 360, 420, 480, 540, 600, 660, 720, 1440)

WINDOW = "date_window"


def add_window(df: DataFrame, window: str, column: str = "date") -> DataFrame:
    return df.withColumn(WINDOW, S.truncate(column, window))


def column_statistics(column: str, divide_by: float = 1.0, mean_name: str = "mean") -> list[Column]:
    c, k = F.col(column), F.lit(float(divide_by))
    return [
        (F.min(c) / k).alias(f"min_{column}"),
        (F.avg(c) / k).alias(f"{mean_name}_{column}"),
        (F.max(c) / k).alias(f"max_{column}"),
    ]


def window_totals(df: DataFrame, window: str = "360m", statistics: Iterable[str] = ()) -> DataFrame:
    """transactions (non-null amounts), frauds, total_amount, and min/mean/max of ``statistics``."""
    aggregates = [
        F.count("amount").alias("transactions"),
        F.sum("target").alias("frauds"),
        F.sum("amount").alias("total_amount"),
    ]
    for c in statistics:
        aggregates += column_statistics(c)
    return add_window(df, window).groupBy(WINDOW).agg(*aggregates)


def fraud_count_distribution(df: DataFrame, minutes: Sequence[int] = WINDOW_MINUTES) -> DataFrame:
    """For each window size, how many windows have 1, 2, ... frauds.

    Rows are summed once at the greatest common divisor of the sizes (all windows start at the epoch, so
    they nest), and only those few rows are copied once per size.
    """
    base = math.gcd(*minutes)
    fine = df.groupBy(S.truncate("date", f"{base}m").alias("t")).agg(F.sum("target").alias("frauds"))
    sized = fine.select(F.explode(F.array(*[F.lit(m) for m in minutes])).alias("minutes"), S.epoch_minute("t").alias("m"), "frauds")
    slot = (F.col("m") - F.pmod(F.col("m"), F.col("minutes"))).alias("slot")
    totals = sized.groupBy("minutes", slot).agg(F.sum("frauds").alias("total_frauds"))
    return totals.where(F.col("total_frauds") > 0).groupBy("minutes", "total_frauds").agg(
        F.count(F.lit(1)).alias("windows")
    )


def distinct_with_null(column: str) -> Column:
    """Number of distinct values, a null counting as one value."""
    has_null = F.max(F.when(F.col(column).isNull(), 1).otherwise(0))
    return F.count_distinct(F.col(column)) + has_null


def distinct_per_window(df: DataFrame) -> DataFrame:
    """unique_clients and unique_merchants per window.

    A group-by of its own: distinct counts make Spark copy each row once per counted column and carry every
    other aggregate of the same group-by through the shuffle of the distinct values.
    """
    return df.groupBy(WINDOW).agg(
        distinct_with_null("client_id").alias("unique_clients"),
        distinct_with_null("merchant_id").alias("unique_merchants"),
    )


def base_aggregates(columns: Sequence[str], with_statistics: bool) -> list[Column]:
    aggregates = [
        F.sum("target").alias("frauds"),
        F.count("target").alias("transactions"),
        F.sum("amount").alias("total_amount"),
    ]
    if with_statistics:
        scales: Mapping[str, float] = SCALE_FACTORS | {c: 1 for c in UNSCALED_COLUMNS}
        for c, k in scales.items():
            if c in columns:
                aggregates += column_statistics(c, k)
    return aggregates


def group_base(df: DataFrame, with_statistics: bool, extra: Sequence[Column] = ()) -> DataFrame:
    sums = df.groupBy(WINDOW).agg(*base_aggregates(df.columns, with_statistics), *extra)
    return sums.join(distinct_per_window(df), WINDOW)


def finish_base(grouped: DataFrame, with_statistics: bool, extra: Sequence[str] = ()) -> DataFrame:
    """Ratios per client and merchant; the raw totals go, and windows with a null base feature go."""
    done = grouped.withColumns(
        {
            "transaction_per_client": F.col("transactions") / F.col("unique_clients"),
            "transaction_per_merchant": F.col("transactions") / F.col("unique_merchants"),
        }
    )
    dropped = ["transactions", "total_amount", "unique_clients", "unique_merchants"]
    if with_statistics:
        dropped += ["min_amount", "max_amount"]
    done = done.drop(*dropped)
    base = [c for c in done.columns if c not in extra]
    return done.dropna("any", subset=base).select(*base, *extra)


def base_features(df: DataFrame, with_statistics: bool = False) -> DataFrame:
    """``df`` carries ``date_window``; one row per window comes out."""
    return finish_base(group_base(df, with_statistics), with_statistics)
