"""Lags, relative changes, rolling alerts and forward fill of a stream of finished windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from raretide.operators.dense import ROLLING_ROWS
from raretide.operators.windows import WINDOW
from raretide.streaming.windows import fixed_minutes

# What is known of a series: minute of its last window, whether that had a fraud, its total and (filled) mean value,
# and the totals of the last ROLLING_ROWS windows.
STATE = "slot bigint, flag int, total double, value double, recent array<double>"
ADDED = "previous_frauds int, txn_volume_change double, avg_value_change double, velocity_alert int"


def change(now: float | None, before: float | None) -> float | None:
    """now / before - 1; from 0 it is signed infinity, and 0 to 0 is unknown."""
    if now is None or before is None:
        return None
    if before == 0:
        return math.copysign(math.inf, now) if now else None
    return now / before - 1


class Series:
    """Features of the windows of one series, in order of time."""

    def __init__(self, known: tuple | None):
        self.slot, self.flag, self.total, self.value, recent = known or (None, 0, None, None, [])
        self.recent = list(recent)

    def known(self) -> tuple:
        return self.slot, self.flag, self.total, self.value, self.recent

    def add(self, slot: int, transactions: int, frauds: int, amount: float | None) -> tuple:
        total = float(transactions)
        value = amount / transactions if transactions and amount is not None else self.value
        self.recent = [*self.recent[1 - ROLLING_ROWS:], total] if len(self.recent) >= ROLLING_ROWS else [*self.recent, total]
        spread = np.std(self.recent, ddof=1) if len(self.recent) > 1 else math.nan
        alert = int(total - np.mean(self.recent) > 2 * spread)
        row = (slot, transactions, frauds, value, self.flag, change(total, self.total), change(value, self.value), alert)
        self.slot, self.flag, self.total, self.value = slot, int(frauds > 0), total, value
        return row


def stream_changes(windows: DataFrame, series: str, window: str = "360m", fill_gaps: bool = True) -> DataFrame:
    """previous_frauds, relative changes and velocity_alert of every window of every ``series``, windows in order.

    ``windows`` is a stream over the files to which ``stream_window_totals`` writes its finished windows in append mode
    (Spark keeps no keyed Python state behind an aggregate of the same query): date_window, ``series``, transactions,
    frauds, total_amount. A late row has been counted or dropped by that watermark, and the windows of one trigger follow
    those of the last as long as ``maxFilesPerTrigger`` does not part them. A window without transactions keeps the last mean value;
    with ``fill_gaps`` windows that are absent between two others come out with zeros. The state of a series is one row
    and 168 totals. A null series is a series. One trigger's windows of one series are sorted in one task: as many rows
    as windows end in that trigger, however many transactions they hold.
    """
    minutes = fixed_minutes(window)
    kind = windows.schema[series].dataType.simpleString()
    result = f"`{series}` {kind}, slot bigint, transactions bigint, frauds bigint, avg_txn_value double, {ADDED}"
    columns = ["slot", "transactions", "frauds", "avg_txn_value", *[c.split()[0] for c in ADDED.split(", ")]]

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("slot")
        line, out = Series(state.get if state.exists else None), []
        for slot, n, frauds, amount in zip(rows["slot"], rows["transactions"], rows["frauds"], rows["total_amount"]):
            if fill_gaps and line.slot is not None:
                out += [line.add(gap, 0, 0, None) for gap in range(line.slot + minutes, slot, minutes)]
            out.append(line.add(int(slot), int(n), 0 if pd.isna(frauds) else int(frauds), None if pd.isna(amount) else float(amount)))
        state.update(line.known())
        found = pd.DataFrame(out, columns=columns)
        found.insert(0, series, key[0])
        yield found

    slots = windows.select(series, F.expr(f"unix_seconds({WINDOW}) div 60").alias("slot"), "transactions", "frauds", "total_amount")
    followed = slots.groupBy(series).applyInPandasWithState(follow, result, STATE, "append", GroupStateTimeout.NoTimeout)
    start = F.timestamp_seconds(F.col("slot") * 60).alias(WINDOW)
    return followed.select(series, start, *columns[1:])
