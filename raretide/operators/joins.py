"""Equi-joins of a large fact table with dimensions, safe when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 10_000_000
# Rows with a null key match nothing, so they can be spread as widely as one likes.
NULL_SALTS = 1 << 20
BROADCAST_KEYS = 1_000_000


class HotKeys(list):
    """Frequent key values; ``rows`` has the number of rows of each, ``hot_rows`` the bound they reach."""

    def __init__(self, rows: dict, hot_rows: int):
        super().__init__(rows)
        self.rows, self.hot_rows = rows, hot_rows

    def salts(self, key) -> int:
        """Join partitions for a key, so that each has a quarter of ``hot_rows`` rows."""
        return max(2, -(-4 * self.rows[key] // self.hot_rows))


def hot_keys(fact: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> HotKeys:
    """All key values with at least ``hot_rows`` rows, with their counts.

    The counts are pre-aggregated before the shuffle. There are no more such keys than rows / ``hot_rows``: a
    hundred thousand for 10^12 rows. They only steer how rows are spread, never which rows are joined.
    """
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return HotKeys({row[key]: row["n"] for row in counts.where(F.col("n") >= hot_rows).collect()}, hot_rows)


def left_join_spread(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    hot_column: str,
    hot: HotKeys | Sequence,
    spread_by: str,
    salts: int | None = None,
) -> DataFrame:
    """``fact`` left join ``dim``; rows of a hot key are spread over several join partitions.

    How many depends on the key's number of rows, unless ``salts`` fixes it. Only the dimension rows of hot keys are
    copied. Small dimensions still go to a broadcast join, because the planner checks their size against its
    threshold. Fact rows with a null key match nothing and are spread as well. ``spread_by`` tells rows of one key
    apart.
    """
    if not hot:
        return fact.join(dim, list(keys), "left")
    salt, count = "_salt", "_salts"
    rows = [(k, salts or hot.salts(k)) for k in hot]
    kind = fact.schema[hot_column].dataType.simpleString()
    table = fact.sparkSession.createDataFrame(rows, f"`{hot_column}` {kind}, {count} int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_KEYS else table
    width = F.when(F.col(hot_column).isNull(), NULL_SALTS).otherwise(F.coalesce(count, F.lit(1)))
    left = fact.join(table, hot_column, "left").withColumn(salt, F.pmod(F.xxhash64(spread_by), width).cast("int")).drop(count)
    copies = F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1)
    right = dim.join(table, hot_column, "left").withColumn(salt, F.explode(copies)).drop(count)
    return left.join(right, [*keys, salt], "left").drop(salt)


def seen_in(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Dimension rows whose key occurs in ``fact``; the keys are made distinct before the shuffle."""
    return dim.join(fact.select(key).distinct(), key, "left_semi")


def seen_by_group(dim: DataFrame, fact: DataFrame, group: str, key: str) -> DataFrame:
    """:func:`seen_in` for every value of ``group`` in one pass: dimension rows tagged with the groups they occur in."""
    return dim.join(fact.select(group, key).distinct(), key)


def broadcast_if_small(dim: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only after counting that ``dim`` has at most ``max_rows`` rows (four-digit codes do)."""
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim
