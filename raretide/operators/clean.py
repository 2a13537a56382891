"""Typing, renaming and derived columns of the transaction rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from raretide.functions import scalars as S

USER_MONEY = ("per_capita_income", "yearly_income", "total_debt")
REQUIRED_COLUMNS = ("date", "target", "client_id", "merchant_id", "amount")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[S.clean_name(c) for c in df.columns])


def require_columns(df: DataFrame, columns: Iterable[str] = REQUIRED_COLUMNS) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")


def type_transactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "date": F.col("date").cast("timestamp_ntz"),
            "amount": S.money("amount"),
            "mcc": F.col("mcc").cast("string"),
        }
    )


def type_users(df: DataFrame) -> DataFrame:
    return df.withColumns({c: S.money(c) for c in USER_MONEY})


def type_cards(df: DataFrame) -> DataFrame:
    return df.withColumn("credit_limit", S.money("credit_limit"))


def keep_non_negative(df: DataFrame, column: str = "amount") -> DataFrame:
    return df.where(F.col(column) >= 0)


def add_categories(df: DataFrame) -> DataFrame:
    """online_sales, city, country and card_has_chip in place of the raw city, state and chip columns."""
    return df.withColumns(
        {
            "online_sales": S.online_sales("merchant_city"),
            "city": S.sale_city("merchant_city"),
            "country": S.sale_country("merchant_state"),
            "card_has_chip": S.chip_flag("has_chip"),
        }
    ).drop("merchant_state", "merchant_city", "has_chip")


def binary_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", S.is_yes("target"))


def clean_transactions(df: DataFrame) -> DataFrame:
    """Wide split rows to the rows every feature builder takes."""
    return binary_target(add_categories(keep_non_negative(df)))


def recode_for_series(df: DataFrame) -> DataFrame:
    """Numeric flags and filled nulls for the dense time series; values outside a map become null."""
    return df.withColumns(
        {
            "use_chip": S.recode("use_chip", S.USE_CHIP),
            "online_sales": S.recode("online_sales", S.YES_NO),
            "card_has_chip": S.recode("card_has_chip", S.YES_NO),
            "zip": F.coalesce("zip", F.lit(0.0)),
            "errors": F.coalesce("errors", F.lit(S.NO_ERROR)),
        }
    )


def rescale(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(k)) for c, k in factors.items() if c in df.columns})
