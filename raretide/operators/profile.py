"""Small reports about a table: peek, nulls, shape, summary statistics, value counts, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from raretide.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def peek(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, non-null count. One aggregate, then an unpivot."""
    names = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"),
                 F.col(f"c{i}").alias("non_null"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each numeric column, one row per column."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, {c: QUARTILES for c in columns}, **options)
    aggregates = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                *[F.lit(v).cast("double").alias(n) for n, v in zip(("q25", "q50", "q75"), quartiles[c])],
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*aggregates).alias("a")).select(F.inline("a"))


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts divided by the number of non-null values."""
    counts = value_counts(df, column)
    return counts.select(column, (F.col("count") / df.agg(F.count(column)).scalar()).alias("share"))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of the key: the same rows on any number of partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def labels_of(sample: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    return sample.select(key).join(labels.select(key, label), key)
