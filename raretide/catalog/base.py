"""Registered queries: a Spark plan and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from raretide.operators import clean, windows as W
from raretide.plans.ingest import RawInputs, wide_rows
from raretide.session import stage
from raretide.sources.tables import RAW_SQL, raw_table

# Results are compared after rounding. The nudge keeps exact halves (sums of cents over 2^k rows) from going
# up in one engine and down in the other when their sums differ in the last bit.
DIGITS, NUDGE = 6, 1e-10


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    """Register a plan; its floating results are rounded, as those of the SQL are."""

    def add(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, lambda spark, d: rounded(plan(spark, d)), sql and oracle(sql))
        return plan

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        *[f"round(`{c}` + {NUDGE!r}D, {DIGITS}) + 0D AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes]
    )


# -- Spark side of the shared tables ---------------------------------------------------------------------------

def raw_inputs(spark: SparkSession, d: str) -> RawInputs:
    t = {name: raw_table(spark, d, name) for name in RAW_SQL}
    return RawInputs(t["transactions_raw"], t["mcc_codes"], t["users"], t["cards"], t["fraud_labels"])


def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    return wide_rows(raw_inputs(spark, d)).where(F.col("target").isNotNull())


def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_transactions(labelled_rows(spark, d))


def staged_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Clean rows written once, for plans that read them several times: all columns, or only those that are named."""
    rows = clean_rows(spark, d)
    return stage(rows.select(*columns) if columns else rows, "clean-rows")


MODEL_FEATURES = ("transactions", "mean_amount", "online_share", "error_share")


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per hour with transactions: the fraud count and four regressors."""
    rows = W.add_window(clean_rows(spark, d), "60m")
    online = F.when(F.col("online_sales") == "Yes", 1.0).otherwise(0.0)
    error = F.when(F.col("errors").isNotNull(), 1.0).otherwise(0.0)
    return rows.groupBy(W.WINDOW).agg(
        F.sum("target").alias("frauds"),
        (F.count(F.lit(1)) / 10.0).alias("transactions"),
        (F.avg("amount") / 100.0).alias("mean_amount"),
        F.avg(online).alias("online_share"),
        F.avg(error).alias("error_share"),
    )


def staged_model_rows(spark: SparkSession, d: str) -> DataFrame:
    return stage(model_rows(spark, d).coalesce(8), "model-rows")


# -- SQL side --------------------------------------------------------------------------------------------------

_RAW = ",\n".join(f"{n} AS ({s.format(events='events', customer='customer')})" for n, s in RAW_SQL.items())

SHARED_SQL = f"""
{_RAW},
typed AS (SELECT * REPLACE (CAST(replace(amount, '$', '') AS DOUBLE) AS amount) FROM transactions_raw),
typed_users AS (SELECT * REPLACE (
    CAST(replace(per_capita_income, '$', '') AS DOUBLE) AS per_capita_income,
    CAST(replace(yearly_income, '$', '') AS DOUBLE) AS yearly_income,
    CAST(replace(total_debt, '$', '') AS DOUBLE) AS total_debt) FROM users),
typed_cards AS (SELECT * REPLACE (CAST(replace(credit_limit, '$', '') AS DOUBLE) AS credit_limit) FROM cards),
enriched AS (
  SELECT t.* REPLACE (CAST(t.mcc AS VARCHAR) AS mcc), m.description, l.target
  FROM typed t LEFT JOIN mcc_codes m ON t.mcc = m.mcc LEFT JOIN fraud_labels l ON t.id = l.id),
cut AS (SELECT CAST(floor(quantile_cont(epoch_us(date), 0.8)) AS BIGINT) AS us FROM enriched WHERE target = 'Yes'),
wide AS (
  SELECT e.*, u.* EXCLUDE (client_id), c.has_chip, c.credit_limit,
    CASE WHEN e.target IS NULL THEN 'notarget' WHEN epoch_us(e.date) > (SELECT us FROM cut) THEN 'validation'
         ELSE 'train_test' END AS split
  FROM enriched e LEFT JOIN typed_users u ON e.client_id = u.client_id
  LEFT JOIN typed_cards c ON e.card_id = c.card_id AND e.client_id = c.client_id),
labelled AS (SELECT * EXCLUDE (split) FROM wide WHERE target IS NOT NULL),
clean AS (
  SELECT * EXCLUDE (merchant_city, merchant_state, has_chip)
      REPLACE (CASE WHEN target = 'Yes' THEN 1 ELSE 0 END AS target),
    CASE WHEN lower(merchant_city) = 'online' THEN 'Yes' ELSE 'No' END AS online_sales,
    CASE WHEN lower(merchant_city) = 'online' THEN 'Online' ELSE merchant_city END AS city,
    coalesce(CASE WHEN length(merchant_state) = 2 THEN 'United States' ELSE merchant_state END, 'Online') AS country,
    CASE WHEN lower(has_chip) = 'yes' THEN 'Yes' ELSE 'No' END AS card_has_chip
  FROM labelled WHERE amount >= 0),
w360 AS (SELECT *, make_timestamp(epoch_us(date) // 21600000000 * 21600000000) AS date_window FROM clean),
model_rows AS (
  SELECT date_trunc('hour', date) AS date_window, CAST(sum(target) AS BIGINT) AS frauds,
    count(*) / 10.0 AS transactions, avg(amount) / 100.0 AS mean_amount,
    avg(CASE WHEN online_sales = 'Yes' THEN 1.0 ELSE 0.0 END) AS online_share,
    avg(CASE WHEN errors IS NOT NULL THEN 1.0 ELSE 0.0 END) AS error_share
  FROM clean GROUP BY 1)
"""


def oracle(sql: str) -> str:
    """``sql`` over the shared tables. A leading ``WITH`` of its own continues the list of tables."""
    body = sql.strip()
    joiner = ",\n" + body[4:] if body.split(None, 1)[0].upper() == "WITH" else "\n" + body
    return f"WITH RECURSIVE {SHARED_SQL.strip()}{joiner}"


def r(expression: str, name: str | None = None) -> str:
    """Rounding as :func:`rounded` does it."""
    return f"round({expression} + {NUDGE}, {DIGITS}) + 0.0 AS {name or expression}"
