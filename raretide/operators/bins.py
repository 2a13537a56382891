"""Equal-width and quantile bins of numeric columns, and their shares per window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raretide.functions.scalars import one_row
from raretide.operators.quantiles import exact_quantiles
from raretide.operators.windows import SCALE_FACTORS, UNSCALED_COLUMNS

BINNED_COLUMNS = (
    "amount", "per_capita_income", "total_debt", "credit_score", "credit_limit", "current_age", "num_credit_cards",
)
MIN_BINS, MAX_BINS = 1, 5
# Above this estimate the exact number of distinct values cannot change the number of bins.
MANY_VALUES = 4 * 10 * MAX_BINS
SAME_EDGE = 1e-8


def bin_count(distinct: int, min_bins: int = MIN_BINS, max_bins: int = MAX_BINS) -> int:
    return min(max(min_bins, min(distinct // 10, max_bins)), distinct)


@dataclass(frozen=True)
class Bins:
    """Bins of one column. ``edges`` and the statistics are in scaled units (value / scale)."""

    column: str
    edges: tuple[float, ...]
    n_bins: int
    strategy: str
    scale: float
    low: float
    high: float
    median: float

    @property
    def size(self) -> int:
        return len(self.edges) - 1

    def scaled(self, value: Column | None = None) -> Column:
        """Value in scaled units; null counts as the median."""
        return F.coalesce((F.col(self.column) if value is None else value) / F.lit(self.scale), F.lit(self.median))

    def bin_of(self, value: Column | None = None) -> Column:
        """Number of inner edges at or below the value, so the last bin holds its upper end."""
        out = F.lit(0)
        for edge in self.edges[1:-1]:
            out = out + F.when(self.scaled(value) >= F.lit(edge), 1).otherwise(0)
        return out

    def shares(self) -> list[Column]:
        """Share of each bin among the rows of a group: differences of the counts at or above each edge."""
        x = f"coalesce({self.column} / {self.scale!r}D, {self.median!r}D)"
        at_or_above = ["count(1)", *[f"count_if({x} >= {e!r}D)" for e in self.edges[1:-1]], "0"]
        return [F.expr(f"({a} - {b}) / count(1)") for a, b in zip(at_or_above, at_or_above[1:])]

    def lookup(self, value: Column) -> Column:
        """Bin of any value in original units; outside the edges, below as well as above, is the last bin."""
        x = self.scaled(value)
        outside = (x < F.lit(self.edges[0])) | (x > F.lit(self.edges[-1]))
        return F.when(outside, self.size - 1).otherwise(self.bin_of(value))

    def intervals(self, original: bool = False) -> list[dict]:
        k = self.scale if original else 1.0
        return [
            {
                "bin_id": i,
                "lower_bound": self.edges[i] * k,
                "upper_bound": self.edges[i + 1] * k,
                "is_left_inclusive": True,
                "is_right_inclusive": i == self.size - 1,
            }
            for i in range(self.size)
        ]


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """sum, min, median, max and exact distinct count of each column, one row per column."""
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.sum(F.col(c).cast("double")).alias("sum"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.lit(medians[c][0]).cast("double").alias("median"),
            F.max(F.col(c).cast("double")).alias("max"),
            F.count_distinct(c).alias("distinct_values"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def plan_bins(
    df: DataFrame, strategy: str = "uniform", columns: Sequence[str] = BINNED_COLUMNS,
    scales: Mapping[str, float] = SCALE_FACTORS,
) -> dict[str, Bins]:
    """Bins of every column that has enough distinct values (at least 20, by the count rule).

    The number of distinct values only matters up to 50, so columns with many are told apart by a sketch
    and only the others are counted exactly.
    """
    if strategy not in ("uniform", "quantile"):
        raise ValueError(f"strategy must be 'uniform' or 'quantile', not {strategy!r}")
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return {}
    aggregates = ["count(1) as rows"]
    for c in columns:
        x = f"cast({c} as double)"
        aggregates += [f"min({x}) as min_{c}", f"max({x}) as max_{c}", f"count({x}) as n_{c}",
                       f"approx_count_distinct({x}, 0.03) as d_{c}"]
    stats = df.selectExpr(*aggregates).first().asDict()
    few = [c for c in columns if stats[f"d_{c}"] < MANY_VALUES]
    if few:
        stats |= df.agg(*[F.count_distinct(F.col(c).cast("double")).alias(f"d_{c}") for c in few]).first().asDict()
    chosen = {}
    for c in columns:
        distinct = stats[f"d_{c}"]
        if distinct >= 2 and bin_count(distinct) >= 2:
            chosen[c] = bin_count(distinct)
    counts = {c: stats[f"n_{c}"] for c in chosen}
    medians = exact_quantiles(df, {c: [0.5] for c in chosen}, counts=counts) if chosen else {}
    edges = {}
    if strategy == "quantile" and chosen:
        filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0])).alias(c) for c in chosen])
        steps = {c: [i / n for i in range(n + 1)] for c, n in chosen.items()}
        edges = exact_quantiles(filled, steps, counts=dict.fromkeys(chosen, stats["rows"]))

    out = {}
    for c, n in chosen.items():
        k = float(scales.get(c, 1.0))
        low, high = stats[f"min_{c}"] / k, stats[f"max_{c}"] / k
        if strategy == "uniform":
            step = (high - low) / n
            points = [low + i * step for i in range(n)] + [high]
        else:
            points = []
            for e in edges[c]:
                if not points or e / k - points[-1] > SAME_EDGE:
                    points.append(e / k)
        out[c] = Bins(c, tuple(points), n, strategy, k, low, high, medians[c][0] / k)
    return out


def bin_column_name(column: str, bin_id: int) -> str:
    return f"{column}_{column}_discretized_{bin_id}"


def bin_shares(bins: Mapping[str, Bins]) -> list[Column]:
    """One column per bin, seen or not, for every binned column."""
    return [share.alias(bin_column_name(c, i)) for c, b in bins.items() for i, share in enumerate(b.shares())]


INTERVAL_SCHEMA = (
    "column string, bin_id int, lower_bound double, upper_bound double, is_left_inclusive boolean, "
    "is_right_inclusive boolean, n_bins int, strategy string, scale_factor double, min_value double, "
    "max_value double, median_value double"
)


def interval_table(spark: SparkSession, bins: Mapping[str, Bins], original: bool = False) -> DataFrame:
    """The bins as rows, in scaled or original units (a few rows per column)."""
    rows = []
    for c, b in bins.items():
        k = b.scale if original else 1.0
        for i in b.intervals(original):
            rows.append((c, *i.values(), b.n_bins, b.strategy, b.scale, b.low * k, b.high * k, b.median * k))
    return spark.createDataFrame(rows, INTERVAL_SCHEMA)


def histogram_bins(df: DataFrame, column: str, n: int) -> DataFrame:
    """Counts in ``n`` equal-width bins over the range of ``column``, the last one closed; empty bins stay."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / n
    at = one_row(ends.withColumn("step", step))
    place = F.floor(F.try_divide(F.col(column) - at["lo"], at["step"]))
    bin_id = F.least(F.coalesce(place, F.lit(0)), F.lit(n - 1)).cast("int")
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(bin_id.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    bounds = ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"), "lo", step.alias("step"))
    return bounds.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("step")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
