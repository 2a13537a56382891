"""Tables stored by the hash of their join key, so that later joins of them move no rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from raretide.session import new_path


def write_bucketed(df: DataFrame, name: str, keys: list[str] | str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as catalogue table ``name`` in ``buckets`` parts by the hash of ``keys``, and read it back.

    The rows are shuffled once, here, with the same hash, so each part is one file. Tables that are joined on ``keys``
    need equal ``buckets``; choose it so that a part of the largest table fits a task (about 2.5 million rows). A key with
    a large share of the rows makes one large part: join such keys with ``left_join_spread`` instead. ``path`` defaults
    to a new folder in the shared one. An existing table of that name is replaced. Rows with a null key share a part; an
    empty table is a table without files.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path or new_path(df.sparkSession, name)).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def write_together(tables: Mapping[str, DataFrame], keys: list[str] | str, buckets: int) -> dict[str, DataFrame]:
    """:func:`write_bucketed` for tables that will be joined on ``keys``.

    Joins on ``keys`` and further columns stay in place as well if the session sets
    ``spark.sql.requireAllClusterKeysForCoPartition`` to false; rows are the same either way.
    """
    return {name: write_bucketed(df, name, keys, buckets) for name, df in tables.items()}
