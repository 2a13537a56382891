"""Sets of keys as 64-bit words: distinct counts, merging, filters. Bucketed tables."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from raretide.catalog.base import raw_inputs
from raretide.operators import key_sets as K, split
from raretide.operators.joins import seen_in
from raretide.sources import buckets

SCHEMA = "date timestamp_ntz, client_id bigint, shop string, ratio double"
SIZES = (15, 30, 90, 300, 1440)


def rows(n, start=0):
    """Negative, far, repeated and null keys over three weeks from before 1970; some rows without a date."""
    first = datetime(1969, 12, 20)
    out = []
    for i in range(start, start + n):
        date = None if i % 50 == 0 else first + timedelta(minutes=(i * 7919) % 30000)
        client = None if i % 13 == 0 else (-1) ** i * (i * 31 % 200) + (2**62 if i % 17 == 0 else 0)
        shop = None if i % 19 == 0 else f"s{i % 23}" if i % 23 else ""
        out.append((date, client, shop, 0.0 if i % 2 else -0.0))
    return out


def by_hand(data, minutes):
    sets = defaultdict(lambda: (set(), set(), set()))
    for date, *keys in data:
        slot = None if date is None else (date - datetime(1970, 1, 1)) // timedelta(minutes=minutes) * minutes
        for seen, key in zip(sets[slot], keys):
            seen.add(key)
    start = lambda slot: None if slot is None else datetime(1970, 1, 1) + timedelta(minutes=slot)
    return {(minutes, start(slot), *map(len, seen)) for slot, seen in sets.items()}


def test_distinct_counts_of_all_sizes(spark):
    data = rows(3000) + rows(100)
    keys = {"client": "client_id", "shop": "shop", "ratio": "ratio"}
    state = K.key_state(spark.createDataFrame(data, SCHEMA).repartition(5), keys)
    got = [tuple(r) for r in K.distinct_counts(state, list(keys), SIZES).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set().union(*[by_hand(data, m) for m in SIZES])


def test_merged_states_equal_the_state_of_all_rows(spark):
    old, new = rows(900), rows(900, start=600)
    frames = [spark.createDataFrame(part, SCHEMA) for part in (old, new, [])]
    merged = K.merge_states(*[K.key_state(f, ["client_id", "shop"]) for f in frames])
    whole = K.key_state(spark.createDataFrame(old + new, SCHEMA), ["client_id", "shop"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_no_expand_and_one_move_of_the_state(spark):
    state = K.key_state(spark.createDataFrame(rows(100), SCHEMA), ["client_id", "shop"])
    plan = K.distinct_counts(state, ["client_id", "shop"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan
    # rows to fine windows, the state to its words, counts to windows
    assert plan.count("Exchange hashpartitioning") == 3


def test_odd_keys(spark):
    nested = spark.createDataFrame([(datetime(2024, 1, 1), [1])], "date timestamp_ntz, tags array<int>")
    with pytest.raises(ValueError):
        K.key_state(nested, ["tags"])
    empty = spark.createDataFrame([], SCHEMA)
    assert K.distinct_counts(K.key_state(empty, ["client_id"]), ["client_id"]).count() == 0


@pytest.mark.parametrize("key", ["client_id", "shop"])
@pytest.mark.parametrize("max_words", [K.FILTER_WORDS, 0])
def test_filtered_semi_join(spark, key, max_words):
    dim = spark.createDataFrame(rows(1500), SCHEMA).withColumn("__word", F.lit(1)).withColumn("__bits", F.lit(2))
    fact = spark.createDataFrame(rows(40, start=3), SCHEMA)
    expected = sorted(map(str, seen_in(dim, fact, key).select(*dim.columns).collect()))
    got = K.seen_in_filtered(dim, fact, key, max_words)
    assert sorted(map(str, got.select(*dim.columns).collect())) == expected and expected
    empty = fact.limit(0)
    assert K.seen_in_filtered(dim, empty, key, max_words).count() == 0


def test_hashed_filter_loses_no_member_and_passes_few_strangers(spark):
    member = spark.range(4000).select(F.concat(F.lit("m"), "id").alias("k"))
    stranger = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("k"))
    f = K.KeyFilter(member, "k")
    assert not f.exact and f.passing(member, "k").count() == 4000
    assert f.passing(stranger, "k").count() < 600


def test_filter_comes_before_the_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fact, small = spark.range(100000).withColumnRenamed("id", "k"), spark.range(0, 100000, 997).withColumnRenamed("id", "k")
        semi = K.seen_in_filtered(fact, small, "k")
        joined = K.join_filtered(fact, small, "k")
        assert "hashpartitioning" not in semi._jdf.queryExecution().executedPlan().toString()
        assert semi.count() == joined.count() == small.count()
        joined.collect()
        assert moved(joined) <= 2 * small.count()
        plain = fact.join(small, "k")
        plain.collect()
        assert moved(plain) > 100000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(df):
    """Rows written by the shuffles of an executed plan."""
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_bucketed_joins_move_nothing(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    raw = raw_inputs(spark, SMALL)
    frames = {"b_transactions": raw.transactions, "b_users": raw.users, "b_cards": raw.cards}
    stored = buckets.write_together(frames, "client_id", 8)
    labelled = buckets.write_together({"b_rows": raw.transactions, "b_labels": raw.labels}, "id", 8)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for got, plain in (
            (split.join_dimensions(*stored.values()), split.join_dimensions(*frames.values())),
            (labelled["b_rows"].join(labelled["b_labels"], "id", "left"), raw.transactions.join(raw.labels, "id", "left")),
        ):
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bucketed_nulls_empty_tables_and_replacement(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k bigint, v int")
    buckets.write_bucketed(df, "b_small", "k", 4)
    again = buckets.write_bucketed(df.where("v > 1"), "b_small", ["k"], 4)
    assert sorted(r.v for r in again.collect()) == [2, 3]
    assert buckets.write_bucketed(df.limit(0), "b_none", "k", 4).join(again, "k").count() == 0
