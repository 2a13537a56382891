import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from raretide.operators import clean, windows as W
from raretide.plans.ingest import enrich
from raretide.catalog.base import raw_inputs
from raretide.streaming.ordered import stream_changes
from raretide.streaming.windows import sketched_counts, stream_key_sketches, stream_window_totals


def test_stream_equals_batch(spark, tmp_path):
    rows = clean.binary_target(enrich(raw_inputs(spark, SMALL)).where("target is not null and amount >= 0"))
    rows.select("date", "amount", "target").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("date timestamp_ntz, amount double, target int").parquet(str(tmp_path / "in"))
    query = (
        stream_window_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    query.stop()
    got = spark.table("totals").withColumn("date_window", F.col("date_window").cast("timestamp_ntz"))
    expected = W.window_totals(rows)
    columns = ["date_window", "transactions", "frauds", F.round("total_amount", 6)]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))


def follow(spark, folder, rows, build, parts, then=None):
    """Rows arrive in ``parts`` files, shuffled within each; ``build`` makes finished windows of the stream, which go to
    files; ``then`` reads those. Every arrival is handled before the next one, so state passes from trigger to trigger."""
    source, sink, size = str(folder / "in"), str(folder / "windows"), -(-len(rows) // parts)
    queries = []
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if not queries:
            windows = build(spark.readStream.schema(SCHEMA).parquet(source))
            log = lambda name: str(folder / f"log-{name}")
            queries = [windows.writeStream.format("parquet").option("checkpointLocation", log("windows")).start(sink)]
            if then is not None:
                queries[0].processAllAvailable()
                out = then(spark.readStream.schema(windows.schema).parquet(sink))
                queries.append(out.writeStream.format("memory").queryName(f"q{id(rows)}").option("checkpointLocation", log("out")).start())
        for query in queries:
            query.processAllAvailable()
    for query in queries:
        query.stop()
    return spark.read.schema(windows.schema).parquet(sink) if then is None else spark.table(f"q{id(rows)}")


def made_rows(hours=420):
    """Two series with gaps, a fraud now and then, a burst, hours whose amounts are all null; then a far row that ends all."""
    rng, first, rows = random.Random(5), datetime(2024, 1, 1), []
    for h in range(hours):
        for shop, every in (("a", 1), ("b", 3), (None, 7)):
            if h % every or h % 50 in (7, 8):
                continue
            for _ in range(40 if h % 97 == 60 else rng.randint(1, 6)):
                amount = None if h % 31 == 0 else rng.randint(1, 900) / 4
                rows.append((first + timedelta(hours=h, minutes=rng.randint(0, 59)), shop, amount, int(rng.random() < 0.05), rng.randint(0, 500)))
    return rows + [(first + timedelta(hours=hours + 300), "end", 1.0, 0, 1)]


SCHEMA = "date timestamp_ntz, shop string, amount double, target int, client bigint"


def test_ordered_features_of_a_stream_equal_a_batch(spark, tmp_path):
    rows = made_rows()
    totals = lambda stream: stream_window_totals(stream, "60m", lateness="100 hours", by=["shop"])
    changes = lambda windows: stream_changes(windows, "shop", "60m")
    got = follow(spark, tmp_path, rows, totals, 5, changes).toPandas()
    frame = pd.DataFrame(rows, columns=["date", "shop", "amount", "target", "client"])
    seen = 0
    for shop in ("a", "b", None):
        own = frame[frame["shop"].isna() if shop is None else frame["shop"] == shop]
        hour = own.groupby(own["date"].dt.floor("60min"))
        table = pd.DataFrame({"n": hour["amount"].count(), "f": hour["target"].sum(), "v": hour["amount"].mean()})
        table = table.reindex(pd.date_range(table.index.min(), table.index.max(), freq="60min"))
        n, f, v = table["n"].fillna(0), table["f"].fillna(0), table["v"].ffill()
        roll = n.rolling(168, min_periods=1)
        expected = pd.DataFrame({
            "transactions": n, "frauds": f, "avg_txn_value": v,
            "previous_frauds": (f > 0).astype(int).shift(1).fillna(0),
            "txn_volume_change": n.pct_change(fill_method=None), "avg_value_change": v.pct_change(fill_method=None),
            "velocity_alert": (n - roll.mean() > 2 * roll.std()).astype(int),
        })
        mine = got[got["shop"].isna() if shop is None else got["shop"] == shop].sort_values("date_window")
        assert list(mine["date_window"]) == list(expected.index)
        np.testing.assert_allclose(mine[expected.columns].to_numpy(float), expected.to_numpy(float), rtol=1e-9)
        seen += len(mine)
    assert seen == len(got) and got["velocity_alert"].sum() > 3


def test_windows_as_they_are_without_filling(spark, tmp_path):
    rows = [r for r in made_rows(60) if r[1] != "a"]
    totals = lambda stream: stream_window_totals(stream, "60m", lateness="100 hours", by=["shop"])
    got = follow(spark, tmp_path, rows, totals, 2, lambda w: stream_changes(w, "shop", "60m", fill_gaps=False))
    hours = {(r[1], r[0].replace(minute=0)) for r in rows if r[1] != "end"}
    assert {(r["shop"], r["date_window"]) for r in got.collect()} == hours and got.count() == len(hours)


def test_sketched_distinct_counts(spark, tmp_path):
    rows = [(d, s, a, t, None if c == 7 else c) for d, s, a, t, c in made_rows(200)]
    sketches = lambda stream: stream_key_sketches(stream, ["client", "shop"], "60m", lateness="200 hours")
    stored = follow(spark, tmp_path, rows, sketches, 3)
    batch = spark.createDataFrame(rows, SCHEMA)
    for window in ("60m", "1440m"):
        exact = W.add_window(batch.where("shop IS NULL OR shop <> 'end'"), window).groupBy("date_window").agg(
            W.distinct_with_null("client").alias("c"), W.distinct_with_null("shop").alias("s"))
        exact = {r["date_window"]: (r["c"], r["s"]) for r in exact.collect()}
        got = {r["date_window"]: (r["unique_client"], r["unique_shop"]) for r in sketched_counts(stored, ["client", "shop"], window).collect()}
        assert got.keys() == exact.keys()
        assert all(abs(got[k][0] - exact[k][0]) <= 1 + 0.05 * exact[k][0] and got[k][1] == exact[k][1] for k in exact)


def test_streaming_windows_have_a_fixed_length(spark):
    with pytest.raises(ValueError):
        stream_key_sketches(spark.createDataFrame([], SCHEMA), ["client"], "1mo")
