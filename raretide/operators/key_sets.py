"""Sets of keys as words of 64 bits: distinct counts of any window from one stored state, and filters before a shuffle.

A whole-number key is bit ``key mod 64`` of word ``key div 64``. Words are merged by ``bit_or``, a plain hash aggregate:
it runs before and after the shuffle, a sparse set costs one row per key and a dense one a row per 64 keys. Keys of
other types have a row of their own in a state, so their counts are exact too.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raretide.functions.scalars import epoch_minute
from raretide.operators.joins import seen_in
from raretide.operators.windows import WINDOW, WINDOW_MINUTES
from raretide.session import stage

WHOLE = ("tinyint", "smallint", "int", "bigint")
NESTED = ("array", "map", "struct", "variant", "interval")
PLACE = ("key", "word", "text")

# A filter is sent to all executors only up to this many words (16 bytes each).
FILTER_WORDS = 4_000_000
# Words of an inexact filter are sized for this many keys each; a key sets four of the 64 bits.
KEYS_PER_WORD = 4


def _word(key: Column) -> Column:
    return F.shiftright(key.cast("bigint"), 6)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


def _entry(df: DataFrame, column: str, name: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind.startswith(NESTED):
        raise ValueError(f"{column} is of type {kind}; keys must be single values")
    key = F.col(f"`{column}`")
    if kind in WHOLE:
        word, text, bits = _word(key), F.lit(None), F.coalesce(_bit(key), F.lit(1))
    else:
        # adding zero makes -0.0 and 0.0 one value
        key = key + F.lit(0).cast(kind) if kind in ("float", "double") else F.hex(key) if kind == "binary" else key
        word, text, bits = F.lit(None), key, F.lit(1)
    parts = F.lit(name).alias("key"), word.cast("bigint").alias("word"), text.cast("string").alias("text"), bits.cast("bigint").alias("bits")
    return F.struct(*parts)


def key_state(df: DataFrame, keys: Mapping[str, str] | Sequence[str], minutes: int = 15, date: str = "date") -> DataFrame:
    """The sets of keys of every window of ``minutes``: slot (minutes since 1970), key, word, text, bits.

    ``keys`` are columns, or result names to columns. A null key is an element of its own; rows without a date form a
    window without a start; repeated rows change nothing; an empty table gives no rows. All keys come from one scan and
    rows are aggregated before they are shuffled. A written state can be kept: :func:`merge_states` adds that of new rows.
    """
    named = keys if isinstance(keys, Mapping) else {k: k for k in keys}
    minute = epoch_minute(date)
    slot = (minute - F.pmod(minute, F.lit(minutes))).alias("slot")
    entries = F.array(*[_entry(df, column, name) for name, column in named.items()])
    return df.select(slot, F.inline(entries)).groupBy("slot", *PLACE).agg(F.bit_or("bits").alias("bits"))


def merge_states(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The state of all rows together; a key that several states have seen in a window counts once."""
    merged = first
    for other in others:
        merged = merged.unionByName(other)
    return merged.groupBy("slot", *PLACE).agg(F.bit_or("bits").alias("bits"))


def distinct_counts(state: DataFrame, keys: Sequence[str], minutes: Sequence[int] = WINDOW_MINUTES) -> DataFrame:
    """minutes, date_window and ``unique_<key>`` for every window of every size, a null counting as one value.

    Sizes are multiples of the state's own window. The state moves once, by word and by stretches of time in which
    windows of all sizes begin and end; each size is merged where the words lie, and only counts are shuffled again.
    A word has at most one row per fine window of its stretch, however often its keys occur.
    """
    stretch = math.lcm(*minutes)
    begin = (F.col("slot") - F.pmod("slot", F.lit(stretch))).alias("stretch")
    placed = state.select(*PLACE, begin, "slot", "bits").where(F.col("key").isin(*keys)).repartition(*PLACE, "stretch")
    sized = placed.select("*", F.explode(F.array(*[F.lit(m) for m in minutes])).alias("minutes"))
    sized = sized.withColumn("slot", F.col("slot") - F.pmod("slot", "minutes"))
    sets = sized.groupBy(*PLACE, "stretch", "minutes", "slot").agg(F.bit_count(F.bit_or("bits")).alias("n"))
    counts = [F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0)).alias(f"unique_{k}") for k in keys]
    start = F.expr("timestampadd(MINUTE, CAST(slot AS INT), TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias(WINDOW)
    return sets.groupBy("minutes", "slot").agg(*counts).select("minutes", start, *[f"unique_{k}" for k in keys])


class KeyFilter:
    """The keys of a column, small enough to be probed before a shuffle.

    ``words`` has one row per word with a key. ``exact``: whole-number keys; others are hashed to four bits of one word, so
    that a few strangers pass (about one in a hundred) and no member is lost. Nulls are never members. Where more than
    ``max_words`` words would be sent out, ``words`` is None and nothing is filtered.
    """

    def __init__(self, keys: DataFrame, column: str, max_words: int = FILTER_WORDS):
        kind = dict(keys.dtypes)[column]
        self.exact, self.size, self.words = kind in WHOLE, 0, None
        present = keys.select(F.col(f"`{column}`").alias("k")).where("k IS NOT NULL")
        if not self.exact:
            present = stage(present.distinct(), "filter-keys")
            self.size = max(1, -(-present.count() // KEYS_PER_WORD))
            if self.size > max_words:
                return
        pairs = present.select(self._place(F.col("k")).alias("__word"), self._mask(F.col("k")).alias("__bits"))
        words = stage(pairs.groupBy("__word").agg(F.bit_or("__bits").alias("__bits")), "key-filter")
        if words.count() <= max_words:
            self.words = words

    def _place(self, key: Column) -> Column:
        return _word(key) if self.exact else F.pmod(F.xxhash64(key), F.lit(self.size).cast("bigint"))

    def _mask(self, key: Column) -> Column:
        if self.exact:
            return _bit(key)
        mixed = F.xxhash64(F.lit(1), key)
        mask = _bit(mixed)
        for k in (6, 12, 18):
            mask = mask.bitwiseOR(_bit(F.shiftright(mixed, k)))
        return mask

    def passing(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose key may be a member (exact filters: is one), found without a shuffle of ``df``."""
        if self.words is None:
            return df
        if self.exact and dict(df.dtypes)[column] not in WHOLE:
            raise ValueError(f"{column} is not a whole-number column as the filter's keys are")
        key, mask = df[f"`{column}`"], self._mask(df[f"`{column}`"])
        hit = (self._place(key) == self.words["__word"]) & (self.words["__bits"].bitwiseAND(mask) == mask)
        return df.join(F.broadcast(self.words), hit & key.isNotNull(), "left_semi")


def seen_in_filtered(dim: DataFrame, fact: DataFrame, key: str, max_words: int = FILTER_WORDS) -> DataFrame:
    """Dimension rows whose key occurs in ``fact``, as :func:`seen_in` gives them.

    Whole-number keys need no shuffle of the dimension at all; for others only rows that pass are shuffled. Beyond
    ``max_words`` it is the plain semi-join.
    """
    members = KeyFilter(fact, key, max_words)
    kept = members.passing(dim, key)
    return kept if members.exact and members.words is not None else seen_in(kept, fact, key)


def join_filtered(fact: DataFrame, small: DataFrame, key: str, max_words: int = FILTER_WORDS) -> DataFrame:
    """``fact`` inner join ``small``: rows of ``fact`` without a partner go before the shuffle of the join."""
    return KeyFilter(small, key, max_words).passing(fact, key).join(small, key)
