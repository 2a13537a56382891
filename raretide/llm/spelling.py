"""Spelling variants: words of the corpus one edit apart, each led to its more frequent form.

The vocabulary is dealt into shards by the letters that a word shares with its near words: one edit lies in one half
of a word, so the other half is equal. Each shard holds an FM-index of its words, read forwards for equal ends and
backwards for equal beginnings, and answers the queries dealt to it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raretide.llm.common import stage, texts
from raretide.llm.fm_index import FMIndex

# ASCII letters and U+00C0 to U+00FF, in UTF-8.
RUNS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
# One run in so many of a document loses a letter (a fixed value of the task).
NOISE = 97
# A task sends its counts on when it holds so many words.
HELD_WORDS = 300_000
# Words of a shard's index, about; a group of more words with the same letters is dealt over several shards.
SHARD_WORDS = 50_000
# Shortest query of each class -> letters of its beginning and of its end that all its near words share.
CLASSES = {5: (2, 3), 8: (4, 4), 12: (6, 6)}


def _noisy(run: bytes, h: int) -> bytes:
    word = run.decode()
    cut = h % len(word)
    return (word[:cut] + word[cut + 1:]).encode()


def word_counts(batches):
    """(word, n) of a task's documents. Runs of a document that its hash selects lose one code point."""
    held: Counter[bytes] = Counter()

    def batch_of(counts: Counter[bytes]) -> pa.RecordBatch:
        counts = {w: n for w, n in counts.items() if w and n}
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("id").to_pylist(), texts(batch, "text"), strict=True):
            runs = RUNS.findall(text.encode("utf-8", "replace").lower())
            held.update(runs)
            base = zlib.crc32(f"{doc}:".encode())
            selected = [run for run in set(runs) if zlib.crc32(run, base) % NOISE == 0]
            if selected:
                times = Counter(runs)
                for run in selected:
                    held[run] -= times[run]
                    held[_noisy(run, zlib.crc32(run, base))] += times[run]
            if len(held) > HELD_WORDS:
                yield batch_of(held)
                held.clear()
    yield batch_of(held)


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points that occur at least LEAST_COUNT times in all documents."""
    named = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).alias("text"))
    counts = named.mapInArrow(word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def _search_shard(table: pa.Table) -> pa.Table:
    """(word, near, near_n) of the queries of one shard."""
    side, query = table["side"].to_numpy(), table["query"].to_numpy()
    words, counts = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
    out: list[list[np.ndarray]] = [[], [], []]
    for backwards in (True, False):
        mine = side == (0 if backwards else 1)
        at = {w[::-1] if backwards else w: i for i, w in zip(np.flatnonzero(mine & ~query).tolist(), words[mine & ~query])}
        asked = np.flatnonzero(mine & query)
        if not at or not len(asked):
            continue
        index = FMIndex(sorted(at))
        place = np.array([at[w] for w in sorted(at)])
        patterns = [w[::-1] if backwards else w for w in words[asked]]
        halves = np.array([len(w) // 2 if backwards else len(w) - len(w) // 2 for w in patterns])
        q, w = index.one_edit(patterns, halves)
        pairs = np.unique(asked[q] * len(words) + place[w])
        q, w = np.divmod(pairs, len(words))
        for column, value in zip(out, (words[q], words[w], counts[w]), strict=True):
            column.append(value)
    joined = [np.concatenate(c) if c else np.empty(0, object) for c in out]
    return pa.table({"word": pa.array(joined[0], pa.string()), "near": pa.array(joined[1], pa.string()), "near_n": pa.array(joined[2].astype(np.int64), pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) that differ by one inserted, deleted or replaced code point."""
    size = F.char_length("word")
    starts = sorted(CLASSES)

    def affixes(query: bool) -> DataFrame:
        """A row for each half and class: a query is of the class of its length, a word of those of its near words."""
        parts = []
        for k, low in enumerate(starts):
            high = starts[k + 1] - 1 if k + 1 < len(starts) else None
            slack = 0 if query else 1
            of = words.where((size >= low - slack) & (size <= high + slack if high else F.lit(True)))
            for side, letters in enumerate(CLASSES[low]):
                affix = F.substring("word", 1, letters) if side == 0 else F.expr(f"right(word, {letters})")
                parts.append(of.select(F.lit(side).alias("side"), F.lit(low).alias("class"), affix.alias("affix"), "word", "n"))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    keys = ["side", "class", "affix"]
    indexed = affixes(False)
    sizes = stage(indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")), "affix-sizes")
    total = sizes.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    large = sizes.where(F.col("words") > SHARD_WORDS).select(*keys, F.ceil(F.col("words") / SHARD_WORDS).cast("int").alias("slots"))

    def dealt(rows: DataFrame, query: bool) -> DataFrame:
        rows = rows.join(large, keys, "left").na.fill(1, ["slots"])
        slot = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)) if query else F.expr("cast(pmod(xxhash64(word), slots) as int)")
        shard = F.expr(f"cast(pmod(xxhash64(side, class, affix) + slot, {shards}) as int)")
        return rows.select(*keys, "word", "n", slot.alias("slot")).select(shard.alias("shard"), "side", F.lit(query).alias("query"), "word", "n")

    # A shard may get one word for two classes; its index holds it once.
    rows = dealt(indexed, False).distinct().union(dealt(affixes(True), True))
    found = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(_search_shard, "word string, near string, near_n bigint")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word that the forms lead to. Each round doubles the steps taken."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at least twice the
    word's own n; ``root`` is where the forms lead in the end.

    A null text has no words, a null id counts as the empty text in the hash that selects runs. Repeated rows count
    as often as they occur. Words of any length take part whole. Other columns are not read; an empty table gives an
    empty result.
    """
    words = stage(vocabulary(docs, id_column, text_column), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("fits", -F.col("best.k") >= 2 * F.col("n"))
    table = stage(joined.select("word", F.when(F.col("fits"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("fits"), -F.col("best.k")).alias("form_n")), "forms")
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
