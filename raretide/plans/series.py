"""Dense hourly (or other) feature series of a transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from raretide.operators import dense
from raretide.operators.clean import recode_for_series


class FraudFeatureEngineer:
    """19 features and the fraud count per time bucket, from the first to the last transaction."""

    def __init__(self, freq: str = "1H", chunk_rows: int = dense.CHUNK_ROWS, inf_as_null: bool = False):
        self.freq, self.chunk_rows, self.inf_as_null = freq, chunk_rows, inf_as_null

    def process(self, df: DataFrame) -> DataFrame:
        return recode_for_series(df)

    def create_time_index(self, df: DataFrame) -> dense.Spine:
        return dense.time_spine(df, self.freq, with_flags=True)

    def engineer_features(self, df: DataFrame, window_size_seconds: int = 3600) -> DataFrame:
        rows = self.process(df)
        spine = self.create_time_index(rows)
        base = dense.on_spine(spine, dense.bucket_aggregates(rows, self.freq), window_size_seconds)
        changed = dense.change_features(base, spine.rows, self.chunk_rows)
        return dense.finish(changed, spine.rows, self.chunk_rows, self.inf_as_null)
