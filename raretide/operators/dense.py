"""Features on a gap-free time spine: one row per bucket from the first to the last transaction."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from raretide.functions.calendar import is_us_federal_holiday
from raretide.functions.scalars import NO_ERROR, parse_window, ratio_zero_as_one, truncate
from raretide.operators.ordered import CHUNK_ROWS, chunk_window, drop_halo, forward_fill, with_halo
from raretide.operators.windows import WINDOW

ROLLING_ROWS = 24 * 7
INDEX = "_i"

EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Spine:
    """First bucket, bucket length and number of buckets, and where the three row sets end."""

    start: datetime
    minutes: int
    rows: int
    last: datetime  # bucket of the last transaction
    last_chip: datetime | None = None
    last_error: datetime | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        """Built with ``range``, so a long spine is made by many tasks."""
        step = F.make_dt_interval(mins=(F.col("id") * self.minutes).cast("int"))
        return spark.range(self.rows).select(
            F.col("id").alias(INDEX), (F.lit(self.start).cast("timestamp_ntz") + step).alias(WINDOW)
        )


def _floor(t: datetime, minutes: int) -> datetime:
    return t - (t - EPOCH) % timedelta(minutes=minutes)


def time_spine(df: DataFrame, freq: str = "1H", with_flags: bool = False) -> Spine:
    """Buckets from the bucket of the first date to the hour at or after the last date.

    ``with_flags``: ``df`` is recoded for the series; also find the last chip and the last error transaction.
    """
    unit, minutes = parse_window(freq)
    if unit != "minutes":
        raise ValueError(f"a time spine needs a fixed bucket length, not {freq!r}")
    date = F.col("date").cast("timestamp_ntz")
    pick = {"first": F.min(date), "last": F.max(date)}
    if with_flags:
        pick["chip"] = F.max(F.when(F.col("use_chip") == 1, date))
        pick["error"] = F.max(F.when(F.col("errors") != NO_ERROR, date))
    ends = df.agg(*[c.alias(n) for n, c in pick.items()]).first().asDict()
    if ends["first"] is None:
        raise ValueError("no dates, so there is no time spine")
    start = _floor(ends["first"], minutes)
    stop = _floor(ends["last"], 60)
    if stop != ends["last"]:
        stop += timedelta(hours=1)
    rows = (stop - start) // timedelta(minutes=minutes) + 1

    def bucket(t):
        return None if t is None else _floor(t, minutes)

    return Spine(start, minutes, rows, _floor(ends["last"], minutes), bucket(ends.get("chip")), bucket(ends.get("error")))


def bucket_aggregates(df: DataFrame, freq: str) -> DataFrame:
    """Every per-bucket aggregate: sums in one group-by, distinct counts in one, and the entropy, which needs
    counts per merchant first, in one. All three end up partitioned by bucket, so joining them moves nothing.
    """
    rows = df.withColumn(WINDOW, truncate("date", freq))
    sums = rows.groupBy(WINDOW).agg(
        F.count("id").alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_txn_value"),
        F.count(F.when(F.col("use_chip") == 1, F.col("id"))).alias("chips"),
        F.count(F.when(F.col("errors") != NO_ERROR, F.col("id"))).alias("bad"),
        (F.stddev_pop("latitude") + F.stddev_pop("longitude")).alias("dispersion"),
        F.avg("credit_score").alias("avg_credit_score"),
        F.count(F.when(F.col("target") == 1, F.col("id"))).alias("frauds"),
    )
    distinct = rows.groupBy(WINDOW).agg(
        F.count_distinct("client_id").alias("unique_clients"),
        F.count_distinct("card_id").alias("unique_cards"),
    )
    return sums.join(distinct, WINDOW).join(merchant_entropy(rows), WINDOW, "left")


def merchant_entropy(rows: DataFrame) -> DataFrame:
    """Natural-log entropy of the merchant counts of a window: ln N - sum(c ln c) / N."""
    counts = rows.where(F.col("merchant_id").isNotNull()).groupBy(WINDOW, "merchant_id").agg(F.count("id").alias("c"))
    c = F.col("c")
    parts = counts.groupBy(WINDOW).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0)).alias("s"),
        F.count(F.lit(1)).alias("merchants"),
    )
    entropy = F.when(F.col("merchants") <= 1, 0.0).otherwise(F.ln("n") - F.try_divide(F.col("s"), F.col("n")))
    return parts.select(WINDOW, entropy.alias("merchant_entropy"))


def on_spine(spine: Spine, aggregates: DataFrame, window_size_seconds: int = 3600) -> DataFrame:
    """Spine left join aggregates. Buckets up to the last transaction count as 0, later ones stay null."""
    joined = spine.frame(aggregates.sparkSession).join(aggregates, WINDOW, "left")
    covered = F.col(WINDOW) <= F.lit(spine.last).cast("timestamp_ntz")

    def zero(name: str, value=0) -> Column:
        return F.when(covered, F.coalesce(F.col(name), F.lit(value)))

    def share(part: str, last: datetime | None) -> Column:
        if last is None:
            return F.lit(None).cast("double")
        within = F.col(WINDOW) <= F.lit(last).cast("timestamp_ntz")
        return F.when(within, F.try_divide(F.col(part), F.col("n")))

    total = zero("n")
    clients, cards = zero("unique_clients"), zero("unique_cards")
    return joined.select(
        INDEX,
        WINDOW,
        total.alias("total_transactions"),
        zero("total_amount", 0.0).alias("total_amount"),
        share("chips", spine.last_chip).alias("chip_ratio"),
        (total / window_size_seconds).alias("txn_velocity"),
        "avg_txn_value",
        F.when(covered, F.when(F.coalesce("rows", F.lit(0)) <= 1, 0.0).otherwise(F.col("dispersion"))).alias(
            "geo_dispersion"
        ),
        "merchant_entropy",
        "avg_credit_score",
        share("bad", spine.last_error).alias("error_ratio"),
        *seasonal(WINDOW),
        clients.alias("unique_clients"),
        cards.alias("unique_cards"),
        ratio_zero_as_one(cards, clients).alias("cards_per_client"),
        F.coalesce("frauds", F.lit(0)).alias("frauds"),
    )


def seasonal(column: str) -> list[Column]:
    return [
        F.expr(f"hour({column}) AS hour_of_day"),
        F.expr(f"weekday({column}) AS day_of_week"),
        F.expr(f"if(weekday({column}) IN (5, 6), 1, 0) AS is_weekend"),
        F.when(is_us_federal_holiday(column), 1).otherwise(0).alias("is_holiday"),
    ]


def relative_change(now: Column, before: Column) -> Column:
    """now / before - 1; from 0 it is signed infinity, and 0 to 0 is null."""
    from_zero = F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf")))
    return F.when(before == 0, from_zero).otherwise(F.try_divide(now, before) - 1)


def change_features(df: DataFrame, rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """txn_volume_change, avg_value_change (gaps padded first) and velocity_alert over 168 rows."""
    padded = forward_fill(
        df.withColumns({"_total": F.col("total_transactions"), "_value": F.col("avg_txn_value")}),
        ["_total", "_value"], INDEX, rows, chunk_rows,
    )
    w = chunk_window(INDEX)
    frame = w.rowsBetween(-(ROLLING_ROWS - 1), Window.currentRow)
    total = F.col("total_transactions")
    excess = total - F.avg(total).over(frame)
    alert = excess > 2 * F.stddev_samp(total).over(frame)
    added = with_halo(padded, INDEX, ROLLING_ROWS, chunk_rows).withColumns(
        {
            "txn_volume_change": relative_change(F.col("_total"), F.lag("_total").over(w)),
            "avg_value_change": relative_change(F.col("_value"), F.lag("_value").over(w)),
            "velocity_alert": F.when(alert, 1).otherwise(0),
        }
    )
    return drop_halo(added).drop("_total", "_value")


# The order of the feature columns.
FEATURES = (
    "total_transactions", "total_amount", "chip_ratio", "txn_velocity", "avg_txn_value", "geo_dispersion",
    "merchant_entropy", "avg_credit_score", "error_ratio", "hour_of_day", "day_of_week", "is_weekend",
    "is_holiday", "txn_volume_change", "avg_value_change", "velocity_alert", "unique_clients",
    "unique_cards", "cards_per_client", "frauds",
)


def finish(df: DataFrame, rows: int, chunk_rows: int = CHUNK_ROWS, inf_as_null: bool = False) -> DataFrame:
    """Forward fill, then 0. Infinite changes stay unless ``inf_as_null``."""
    if inf_as_null:
        for c in ("txn_volume_change", "avg_value_change"):
            df = df.withColumn(c, F.when(F.abs(c) < float("inf"), F.col(c)))
    filled = forward_fill(df, FEATURES, INDEX, rows, chunk_rows)
    return filled.selectExpr(WINDOW, *[f"coalesce({c}, 0) AS {c}" for c in FEATURES])
