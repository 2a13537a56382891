"""Readers and writers for the five input files and the derived tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TRANSACTIONS_SCHEMA = (
    "id bigint, date timestamp_ntz, client_id bigint, card_id bigint, amount string, use_chip string, "
    "merchant_id int, merchant_city string, merchant_state string, zip double, mcc int, errors string"
)
CARDS_SCHEMA = "card_id bigint, client_id bigint, has_chip string, credit_limit string"
USERS_SCHEMA = (
    "client_id bigint, current_age bigint, latitude double, longitude double, per_capita_income string, "
    "yearly_income string, total_debt string, credit_score bigint, num_credit_cards bigint"
)


def read_csv(spark: SparkSession, path: str, schema: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header, its declared columns typed, without an inference pass over the file.

    Columns are matched by name, in whatever order the file has them; ``names`` maps a column of the file to its
    name in ``schema`` (a dimension's ``id`` to its key). Declared columns come first, in declared order; others
    follow as text. A declared column that the header lacks is an error; a value that is not of its type is null.
    """
    text = spark.read.csv(path, header=True)  # the header alone is read here; all columns are text
    names = names or {}
    found = {names.get(c, c): c for c in text.columns}
    declared = StructType.fromDDL(schema)
    if missing := [f.name for f in declared if f.name not in found]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    typed = [F.col(f"`{found[f.name]}`").try_cast(f.dataType).alias(f.name) for f in declared]
    others = [F.col(f"`{c}`").alias(name) for name, c in found.items() if name not in declared.names]
    return text.select(*typed, *others)


def read_json_map(spark: SparkSession, path: str, key: str = "mcc", value: str = "description") -> DataFrame:
    """One JSON object ``{"5411": "Grocery"}`` to rows.

    The object is one value, so it is parsed in one task. Merchant codes have four digits: such a file
    has at most 10,000 entries. For large objects see :func:`read_label_object`.
    """
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return entries.select(F.col("k").cast("int").alias(key), F.col("v").alias(value))


def read_label_object(spark: SparkSession, path: str) -> DataFrame:
    """``{"target": {"10": "No", ...}}`` to (id, target).

    The file grows with the transactions. It is one line, so it is split at commas instead of at line
    ends: Spark then reads it in blocks, in parallel, and no task ever holds the whole object. Ids are
    integers and labels are words, so no key or value contains a comma.
    """
    entry = r'"(-?\d+)"\s*:\s*(?:"([^"]*)"|null)'
    text = spark.read.option("lineSep", ",").text(path)
    found = text.where(F.col("value").rlike(entry)).select(
        F.regexp_extract("value", entry, 1).cast("bigint").alias("id"),
        F.nullif(F.regexp_extract("value", entry, 2), F.lit("")).alias("target"),
    )
    return found


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same labels as JSON lines, one ``{"id": 10, "target": "No"}`` per line."""
    return spark.read.schema("id bigint, target string").json(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One table, one folder per split. Reading one split prunes the other folders."""
    write_parquet(df, path, partition_by="split")
