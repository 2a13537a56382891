"""Sums of small matrices over the rows of a table.

A task turns its Arrow batches into blocks and emits one row per matrix cell when it is done; Spark adds
the cells. Nothing but these sums leaves the executors, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FEW_PARTITIONS = 16
CELL_SCHEMA = "part int, cell int, value double"
_ARROW_SCHEMA = pa.schema([("part", pa.int32()), ("cell", pa.int32()), ("value", pa.float64())])


def block(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, null as NaN."""
    out = np.empty((batch.num_rows, batch.num_columns))
    for j, column in enumerate(batch.columns):
        out[:, j] = column.to_numpy(zero_copy_only=False)
    return out


def sum_cells(
    df: DataFrame, of_block: Callable[[np.ndarray], Sequence[np.ndarray]], partitions: int | None = None
) -> dict[int, np.ndarray]:
    """``of_block`` maps a block of rows to a list of flat arrays; their sums over all rows come back.

    The columns of ``df`` must be numeric. The result has the size of the arrays, not of the data. When
    ``partitions``, the number of partitions of ``df``, is known to be small, their sums are added up here
    instead of in another shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            if batch.num_rows:
                parts = of_block(block(batch))
                totals = [a.copy() for a in parts] if totals is None else [t + a for t, a in zip(totals, parts)]
        for i, cells in enumerate(totals or ()):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(cells.size, i, dtype=np.int32)),
                    pa.array(np.arange(cells.size, dtype=np.int32)),
                    pa.array(np.asarray(cells, dtype=float)),
                ],
                schema=_ARROW_SCHEMA,
            )

    doubles = df.selectExpr(*[f"cast(`{c}` as double) as `{c}`" for c in df.columns])
    sums = doubles.mapInArrow(task, CELL_SCHEMA)
    if partitions is None or partitions > FEW_PARTITIONS:
        sums = sums.groupBy("part", "cell").agg(F.sum("value").alias("value"))
    table = sums.toArrow()
    part, cell = table["part"].to_numpy(), table["cell"].to_numpy()
    value = table["value"].to_numpy()
    out = {}
    for i in np.unique(part):
        here = part == i
        cells = np.zeros(cell[here].max() + 1)
        np.add.at(cells, cell[here], value[here])
        out[int(i)] = cells
    return out
