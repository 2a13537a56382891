"""Prediction from a coefficient table, and small model-matrix helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raretide.functions.probability import logistic
from raretide.functions.scalars import one_row
from raretide.operators.regress import CONST

DISPERSION = "alpha"


def standard_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = one_row(df.selectExpr(*[f"struct(avg({c}) AS m, stddev_pop({c}) AS d) AS {c}" for c in columns]))
    scaled = {
        c: F.expr(f"coalesce(try_divide({c} - _s.{c}.m, _s.{c}.d), if({c} IS NULL, NULL, 0D))") for c in columns
    }
    return df.withColumn("_s", stats).withColumns(scaled).drop("_s")


def log1p_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns})


def drop_columns_with_nulls(df: DataFrame) -> DataFrame:
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for c, n in zip(df.columns, nulls) if n])


def payload(coefficients: Sequence[Mapping], columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Regressors of the count and the classification part that are columns of the table.

    ``coefficients``: rows of a coefficient table. Constant and dispersion are parameters, not columns.
    """
    def of(component: str) -> list[str]:
        return [
            r["feature"] for r in coefficients
            if r["component"] == component and r["feature"] not in (CONST, DISPERSION) and r["feature"] in columns
        ]

    return of("count"), of("classification")


def _linear(coefficients: Sequence[Mapping], component: str, columns: Sequence[str]) -> Column:
    known = {r["feature"]: float(r["coefficients"]) for r in coefficients if r["component"] == component}
    out = F.lit(known.get(CONST, 0.0))
    for name in columns:
        out = out + F.lit(known[name]) * F.col(f"`{name}`")
    return out


def predict_from_coefficients(df: DataFrame, coefficients: Sequence[Mapping], name: str = "prediction") -> DataFrame:
    """Expected count (1 - pi) mu and its half-even rounding, from the rows of a coefficient table.

    The rounding is null where it is beyond 64 bits; the expected count itself is given there too.
    """
    exog, inf = payload(coefficients, df.columns)
    mean = F.exp(_linear(coefficients, "count", exog))
    if any(r["component"] == "classification" for r in coefficients):
        mean = (1 - logistic(_linear(coefficients, "classification", inf))) * mean
    return df.withColumn(name, mean).withColumn(f"{name}_rounded", F.bround(name, 0).try_cast("bigint"))
