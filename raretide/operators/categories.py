"""Risk clusters of a category and the share of each cluster per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raretide.functions.scalars import capped_ratio
from raretide.operators.partition import optimal_centres
from raretide.operators.windows import WINDOW

CATEGORIES = ("city", "country", "description")
N_CLUSTERS = 3


def risk_ratio(positives: Column, rows: Column) -> Column:
    """Percent positive over percent negative, at most 100."""
    return capped_ratio(100 * positives / rows, 100 * (rows - positives) / rows)


def category_risk(df: DataFrame, category: str, target: str = "target") -> DataFrame:
    rows, positives = F.count(F.lit(1)), F.sum(target)
    return df.groupBy(category).agg(
        (100 * positives / rows).alias(f"percent_{target}"),
        (100 * (rows - positives) / rows).alias(f"percent_no_{target}"),
        risk_ratio(positives, rows).alias("ab"),
    )


def min_max_scaled(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Scaled to [0, 1]; a constant column becomes 0. The extremes are one row (per ``by`` group)."""
    ends = df.groupBy(*by).agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("_ends"))
    joined = df.join(ends, list(by)) if by else df.withColumn("_ends", ends.scalar())
    low, high = F.col("_ends.lo"), F.col("_ends.hi")
    scaled = F.coalesce(F.try_divide(F.col(column) - low, high - low), F.lit(0.0))
    return joined.withColumn(name, scaled).drop("_ends")


def one_hot(df: DataFrame, column: str, levels: int, drop_first: bool = False) -> DataFrame:
    """A 0/1 column per level 0 ... levels-1 in place of ``column``."""
    flags = {f"{column}_{k}": F.when(F.col(column) == k, 1).otherwise(0) for k in range(int(drop_first), levels)}
    return df.withColumns(flags).drop(column)


def cluster_centres(points: DataFrame, groups: int, k: int = N_CLUSTERS) -> list[list[float]]:
    """Ascending k-means centres per group of ``points`` (group, value, weight): the optimum, so no starts are drawn."""
    return optimal_centres(points, groups, k)


def nearest_centre(value: Column, centres: Sequence[float]) -> Column:
    """Index of the nearest of the ascending centres: the number of midpoints below the value."""
    out = F.lit(0)
    for a, b in zip(centres, centres[1:]):
        out = out + F.when(value > F.lit((a + b) / 2), 1).otherwise(0)
    return out


def category_cells(df: DataFrame, categories: Sequence[str], target: str = "target") -> DataFrame:
    """Rows and positives per (window, category column, value).

    One scan serves every category: each row is unpivoted and summed before the shuffle, so a value that
    holds most of the rows is still one row per window afterwards.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in categories])
    return (
        df.select(WINDOW, target, F.inline(pairs))
        .groupBy(WINDOW, "category", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("positives"))
    )


def risk_of_cells(cells: DataFrame) -> DataFrame:
    sums = cells.groupBy("category", "value").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    return sums.select("category", "value", risk_ratio(F.col("positives"), F.col("n")).alias("ab"))


def assign_clusters(risk: DataFrame, categories: Sequence[str], k: int = N_CLUSTERS) -> DataFrame:
    """category, value, cluster: cluster 0 has the lowest risk. Each category is scaled on its own."""
    scaled = min_max_scaled(risk, "ab", "scaled", by=("category",))
    group = F.array_position(F.array(*map(F.lit, categories)), F.col("category")) - 1
    points = scaled.groupBy(group.alias("group"), F.col("scaled").alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    centres = cluster_centres(points, len(categories), k)
    cluster = None
    for c, found in zip(categories, centres):
        at = nearest_centre(F.col("scaled"), found)
        cluster = F.when(F.col("category") == c, at) if cluster is None else cluster.when(F.col("category") == c, at)
    return scaled.select("category", "value", cluster.alias("cluster"))


def cluster_target_fields(
    df: DataFrame, category: str, target: str = "target", n_clusters: int = N_CLUSTERS, drop_first: bool = False
) -> DataFrame:
    """Category value and its one-hot cluster columns ``{target}_{category}_{k}``."""
    scaled = min_max_scaled(category_risk(df, category, target), "ab", "scaled")
    points = scaled.groupBy(F.lit(0).alias("group"), F.col("scaled").alias("value")).agg(
        F.count(F.lit(1)).alias("weight")
    )
    centres = cluster_centres(points, 1, n_clusters)[0]
    name = f"{target}_{category}"
    labelled = scaled.select(category, nearest_centre(F.col("scaled"), centres).alias(name))
    return one_hot(labelled, name, n_clusters, drop_first)


def cluster_mix(
    cells: DataFrame, clusters: DataFrame, categories: Sequence[str], k: int = N_CLUSTERS, target: str = "target"
) -> DataFrame:
    """Share of each cluster among the rows of a window whose category is known.

    A null category has a risk but never matches a join key, so it is in no share; a window without any
    known category gets null.
    """
    joined = cells.join(clusters, ["category", "value"], "left")
    shares = []
    for c in categories:
        total = f"sum(n) FILTER (WHERE category = '{c}' AND cluster IS NOT NULL)"
        for i in range(k):
            part = f"coalesce(sum(n) FILTER (WHERE category = '{c}' AND cluster = {i}), 0)"
            shares.append(F.expr(f"{part} / {total} AS {target}_{c}_{i}"))
    return joined.groupBy(WINDOW).agg(*shares)
