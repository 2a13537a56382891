"""Raw files to one wide, split table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from raretide.operators import clean, split
from raretide.operators.joins import HOT_ROWS, broadcast_if_small, hot_keys
from raretide.sources import files


@dataclass(frozen=True)
class RawInputs:
    transactions: DataFrame
    mcc_codes: DataFrame
    users: DataFrame
    cards: DataFrame
    labels: DataFrame


def read_inputs(spark: SparkSession, folder: str) -> RawInputs:
    """The five files under their usual names."""
    return RawInputs(
        files.read_csv(spark, f"{folder}/transactions_data.csv", files.TRANSACTIONS_SCHEMA),
        files.read_json_map(spark, f"{folder}/mcc_codes.json"),
        files.read_csv(spark, f"{folder}/users_data.csv", files.USERS_SCHEMA, {"id": "client_id"}),
        files.read_csv(spark, f"{folder}/cards_data.csv", files.CARDS_SCHEMA, {"id": "card_id"}),
        files.read_label_object(spark, f"{folder}/train_fraud_labels.json"),
    )


def enrich(raw: RawInputs) -> DataFrame:
    """Typed transactions with merchant-category description and label; both joins keep every transaction."""
    codes = broadcast_if_small(raw.mcc_codes)
    joined = raw.transactions.join(codes, "mcc", "left").join(raw.labels, "id", "left")
    return clean.type_transactions(joined)


def fraud_cut(raw: RawInputs, q: float = 0.8):
    """The cut date, from two columns of the fraud rows only."""
    frauds = raw.labels.where(F.col("target") == "Yes")
    dates = raw.transactions.select("id", F.col("date").cast("timestamp_ntz").alias("date"))
    return split.cut_date(dates.join(frauds, "id"), q)


def wide_rows(raw: RawInputs, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Transactions with labels, users and cards. Clients with very many rows are spread over the join tasks.

    A hot card belongs to a hot client, so one list serves both joins.
    """
    hot = hot_keys(raw.transactions, "client_id", hot_rows)
    return split.join_dimensions(enrich(raw), clean.type_users(raw.users), clean.type_cards(raw.cards), hot)


def split_table(raw: RawInputs, q: float = 0.8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every transaction once, with its ``split``: notarget, train_test or validation."""
    return split.with_split(wide_rows(raw, hot_rows), fraud_cut(raw, q))


def write_splits(raw: RawInputs, path: str, q: float = 0.8) -> None:
    files.write_splits(split_table(raw, q), path)
