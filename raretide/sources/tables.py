"""The raw inputs, derived from the shared ``events`` and ``customer`` tables.

The text of each query is plain SQL that Spark and DuckDB both run; ``{events}`` and ``{customer}``
are filled with the table to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRANSACTIONS_RAW = """
SELECT event_id AS id, ts AS date, user_id AS client_id, user_id * 3 + k % 3 AS card_id,
  concat('$', CAST(CASE WHEN k % 20 = 0 THEN -value ELSE value END AS STRING)) AS amount,
  CASE k % 4 WHEN 0 THEN 'Chip Transaction' WHEN 1 THEN 'Swipe Transaction'
             WHEN 2 THEN 'Online' ELSE 'Online Transaction' END AS use_chip,
  k AS merchant_id,
  CASE WHEN k % 5 = 0 THEN 'ONLINE' ELSE concat('City', CAST(k % 23 AS STRING)) END AS merchant_city,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 < 4 THEN substring('CATXNY', 2 * (k % 5) - 1, 2)
       ELSE concat('Country', CAST(k % 7 AS STRING)) END AS merchant_state,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(10000 + k AS DOUBLE) END AS zip,
  5000 + k % 12 AS mcc,
  CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'Bad PIN' END AS errors
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e
"""

FRAUD_LABELS = """
SELECT event_id AS id,
  CASE WHEN event_type = 'error' AND CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 30
            AND extract(hour FROM ts) >= 12 THEN 'Yes' ELSE 'No' END AS target
FROM {events} WHERE event_id % 11 <> 0
"""

MCC_CODES = """
SELECT DISTINCT 5000 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12 AS mcc,
  concat('MCC group ', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12 AS STRING)) AS description
FROM {events} WHERE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12 < 11
"""

USERS = """
SELECT c_custkey AS client_id, 18 + c_custkey % 60 AS current_age,
  CAST(25 + c_custkey % 20 AS DOUBLE) AS latitude, CAST(-120 + c_custkey % 45 AS DOUBLE) AS longitude,
  concat('$', CAST(20000 + c_custkey % 300 * 100 AS STRING)) AS per_capita_income,
  concat('$', CAST(40000 + c_custkey % 300 * 210 AS STRING)) AS yearly_income,
  concat('$', CAST(c_custkey % 97 * 1500 AS STRING)) AS total_debt,
  500 + c_custkey * 7 % 350 AS credit_score, 1 + c_custkey % 8 AS num_credit_cards
FROM {customer}
"""

CARDS = """
SELECT c_custkey * 3 + i AS card_id, c_custkey AS client_id,
  CASE WHEN (c_custkey + i) % 3 = 0 THEN 'NO' ELSE 'YES' END AS has_chip,
  concat('$', CAST(1000 + c_custkey % 40 * 500 + i * 250 AS STRING)) AS credit_limit
FROM {customer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i UNION ALL SELECT 2 AS i) t
"""

RAW_SQL = {
    "transactions_raw": TRANSACTIONS_RAW,
    "fraud_labels": FRAUD_LABELS,
    "mcc_codes": MCC_CODES,
    "users": USERS,
    "cards": CARDS,
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RAW_SQL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "customer") if f"{{{t}}}" in sql}
    return spark.sql(sql, **frames)
