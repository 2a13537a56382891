"""Temporal split: unlabelled rows, rows up to a fraud-date quantile, rows after it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from raretide.operators.quantiles import exact_quantiles

EPOCH = datetime(1970, 1, 1)
NO_TARGET, TRAIN_TEST, VALIDATION = "notarget", "train_test", "validation"


def cut_date(df: DataFrame, q: float = 0.8, positive: str = "Yes") -> datetime:
    """The ``q`` quantile, linearly interpolated, of the dates of positive rows, to the microsecond.

    The date parts are read off the zone-free timestamp, so the session time zone has no influence.
    """
    days = F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86_400 + F.hour("date") * 3_600 + F.minute("date") * 60
    us = seconds * 1_000_000 + (F.extract(F.lit("second"), F.col("date")) * 1_000_000).cast("bigint")
    dates = df.where(F.col("target") == positive).select(us.alias("us"))
    value = exact_quantiles(dates, {"us": [q]})["us"][0]
    if value is None:
        raise ValueError(f"no row has target {positive!r}, so there is no cut date")
    return EPOCH + timedelta(microseconds=int(value))


def with_split(df: DataFrame, cut: datetime) -> DataFrame:
    split = (
        F.when(F.col("target").isNull(), NO_TARGET)
        .when(F.col("date") > F.lit(cut).cast("timestamp_ntz"), VALIDATION)
        .otherwise(TRAIN_TEST)
    )
    return df.withColumn("split", split)


def in_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def join_dimensions(df: DataFrame, users: DataFrame, cards: DataFrame, hot=(), salts: int | None = None) -> DataFrame:
    """Users on ``client_id``, then cards on (``card_id``, ``client_id``), both left."""
    from raretide.operators.joins import left_join_spread

    with_users = left_join_spread(df, users, ["client_id"], "client_id", hot, "id", salts)
    return left_join_spread(with_users, cards, ["card_id", "client_id"], "client_id", hot, "id", salts)
