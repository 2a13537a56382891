"""Order-dependent columns (lag, rolling frame, forward fill) without putting a table into one task.

Rows are cut into consecutive chunks of bounded length. A frame that looks a few rows back gets those
rows copied into the next chunk; a fill that looks back without limit gets one carried row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 100_000
CHUNK = "_chunk"
_HALO = "_home"


def with_halo(df: DataFrame, index: str, rows_back: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk``; the last ``rows_back`` rows of a chunk appear in the next one as well.

    ``index`` is a gap-free row number from 0.
    """
    if rows_back >= chunk_rows:
        raise ValueError("a chunk must be longer than the frame")
    home = F.floor(F.col(index) / chunk_rows)
    at_end = F.col(index) % chunk_rows >= chunk_rows - rows_back
    chunks = F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(_HALO, home).withColumn(CHUNK, F.explode(chunks))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(CHUNK) == F.col(_HALO)).drop(CHUNK, _HALO)


def chunk_window(index: str):
    return Window.partitionBy(CHUNK).orderBy(index)


def forward_fill(
    df: DataFrame, columns: Sequence[str], index: str, rows: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Replace nulls by the last earlier value. ``rows`` is the known number of rows of ``df``."""
    chunked = df.withColumn(CHUNK, F.floor(F.col(index) / chunk_rows))
    back = f"PARTITION BY {CHUNK} ORDER BY {index} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    filled = chunked.selectExpr(CHUNK, *kept, *[f"last({c}, true) OVER ({back}) AS {c}" for c in columns])
    if rows <= chunk_rows:
        return filled.drop(CHUNK)
    # one row per chunk: rows / chunk_rows of them, so an unpartitioned frame is small
    ends = chunked.groupBy(CHUNK).agg(*[F.expr(f"max_by({c}, {index}) FILTER (WHERE {c} IS NOT NULL) AS {c}") for c in columns])
    before = f"ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carried = ends.selectExpr(CHUNK, *[f"last({c}, true) OVER ({before}) AS _in_{c}" for c in columns])
    return filled.join(carried, CHUNK, "left").selectExpr(*kept, *[f"coalesce({c}, _in_{c}) AS {c}" for c in columns])


def previous_value(df: DataFrame, value: Column, order: str, chunk: Column, name: str) -> DataFrame:
    """``value`` of the row before in ``order``, null in the first row.

    ``chunk`` grows with ``order`` and bounds the rows sharing one value of it.
    """
    rows = df.withColumn(CHUNK, chunk).withColumn("_value", value)
    inside = rows.withColumn(name, F.lag("_value").over(chunk_window(order)))
    ends = rows.groupBy(CHUNK).agg(F.max_by("_value", order).alias("_last"))
    carried = ends.select(CHUNK, F.lag("_last").over(Window.orderBy(CHUNK)).alias("_carried"))
    first = F.row_number().over(chunk_window(order)) == 1
    return (
        inside.withColumn("_first", first)
        .join(carried, CHUNK, "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name)))
        .drop(CHUNK, "_value", "_first", "_carried")
    )


def previous_frauds(df: DataFrame, window: str = "360m", chunk_windows: int = 10_000) -> DataFrame:
    """1 if the window before (of those present) had a fraud, 0 if not or if there is none."""
    from raretide.functions.scalars import parse_window, truncate

    unit, n = parse_window(window)
    minutes = {"minutes": n, "week": n * 10_080, "month": n * 43_200}[unit]
    chunk = truncate("date_window", f"{minutes * chunk_windows}m")
    flag = F.when(F.col("frauds") > 0, 1).otherwise(0)
    lagged = previous_value(df, flag, "date_window", chunk, "previous_frauds")
    return lagged.withColumn("previous_frauds", F.coalesce("previous_frauds", F.lit(0)))
