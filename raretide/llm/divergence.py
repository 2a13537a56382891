"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language.

Tasks count terms with Arrow kernels (lower-casing, splitting, dictionary encoding, hash grouping), so one row per
task, source and term is shuffled. The summed counts are dealt into columnar shards of terms, and each shard adds up
its part of the divergence between every two sources of the language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from raretide.llm.common import small_batches, stage

# What separates terms: ASCII other than letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
# Longer texts are split by Arrow piece by piece, cut at a separator (characters).
PIECE = 1 << 20
# A task's counts are merged when it holds so many rows, and sent on if half of them are left.
HELD_ROWS = 400_000
# Cells (source, term) of a shard, and numbers in a block of its dense counts.
SHARD_CELLS, BLOCK = 50_000, 1 << 19
_separator = re.compile(SEPARATORS)


def _pieces(text: pa.Array):
    """(row numbers, texts) of a small batch; what is longer than a piece comes in several rows."""
    long = pc.greater(pc.utf8_length(text), PIECE)
    rows = pa.array(np.arange(len(text)))
    if not pc.any(long).as_py():
        yield rows, text
        return
    short = pc.invert(long)
    yield rows.filter(short), text.filter(short)
    for row, value in zip(rows.filter(long).to_pylist(), text.filter(long), strict=True):
        value, start = value.as_py(), 0
        while start < len(value):
            cut = _separator.search(value, start + PIECE)
            end = cut.end() if cut else len(value)
            yield pa.array([row]), pa.array([value[start:end]])
            start = end


def _document_counts(rows: pa.Array, text: pa.Array) -> pa.Table:
    """(row, term, n): occurrences of each term in each row."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATORS)
    terms, owners = pc.list_flatten(lists), rows.take(pc.list_parent_indices(lists))
    words = pc.not_equal(terms, "")
    codes = terms.filter(words).dictionary_encode()
    table = pa.table({"row": owners.filter(words), "code": codes.indices})
    table = table.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"row": table["row"], "term": codes.dictionary.take(table["code"].combine_chunks()), "n": table["count_all"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return table.rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(batches):
    """(lang, source, term, n, docs) of a task's rows. Each (lang, source) also has a row with an empty term and zeros."""
    held, size = [], 0
    for batch in batches:
        for part in small_batches([batch], 1024):
            lang, source, text = (part.column(c) for c in ("lang", "source", "text"))
            counted = [_document_counts(*piece) for piece in _pieces(text)]
            table = pa.concat_tables(counted)
            if len(counted) > 1:  # a long text counts once as a document of its terms
                table = table.group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["row", "term", "n"])
            rows = table["row"].combine_chunks()
            seen = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
            zero = pa.array(np.zeros(len(seen), np.int64))
            held.append(pa.table({"lang": lang.take(rows), "source": source.take(rows), "term": table["term"], "n": table["n"], "docs": pa.array(np.ones(len(rows), np.int64))}))
            held.append(pa.table({"lang": seen["lang"], "source": seen["source"], "term": pa.array([""] * len(seen), pa.string()), "n": zero, "docs": zero}))
            size += len(rows) + len(seen)
            if size > HELD_ROWS:
                held = [_merged(held)]
                size = len(held[0])
                if size > HELD_ROWS // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from _merged(held).to_batches()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), by long division in base 1000: exact for totals below 9 * 10**15."""
    whole = total + 2 * kept
    out, rest = F.lit(1), n + 2
    for place in (SCALE // 1000, 1000, 1):
        scaled = rest * 1000
        out, rest = out + F.call_function("div", scaled, whole) * place, scaled % whole
    return out


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """``share`` of a whole array."""
    whole = total + 2 * kept
    out, rest = np.ones_like(n), n + 2
    for place in (SCALE // 1000, 1000, 1):
        digit, rest = np.divmod(rest * 1000, whole)
        out += digit * place
    return out


def _shard_divergences(table: pa.Table) -> pa.Table:
    """(lang, a, b, value) of one shard for every two sources a < b of the language. Rows without a term tell the
    sources, their totals (``n``) and the number of kept terms of the language (``kept``)."""
    mark = pc.is_null(table["term"])
    marks, cells = table.filter(mark), table.filter(pc.invert(mark))
    order = pc.sort_indices(marks["source"])
    sources, totals = marks["source"].take(order).combine_chunks(), marks["n"].take(order).to_numpy()
    value = np.zeros((len(sources), len(sources)), np.int64)
    if len(cells):
        column = pc.index_in(cells["source"], value_set=sources).to_numpy()
        codes = cells["term"].combine_chunks().dictionary_encode()
        row, n, kept = codes.indices.to_numpy(), cells["n"].to_numpy(), marks["kept"][0].as_py()
        by_row = np.argsort(row, kind="stable")
        row, column, n = row[by_row], column[by_row], n[by_row]
        step = max(1, BLOCK // len(sources))
        for first in range(0, len(codes.dictionary), step):
            a, b = np.searchsorted(row, [first, first + step])
            dense = np.zeros((min(step, len(codes.dictionary) - first), len(sources)), np.int64)
            dense[row[a:b] - first, column[a:b]] = n[a:b]
            p = shares(dense, totals, kept)
            for i in range(len(sources) - 1):
                d, s = p[:, i + 1:] - p[:, i:i + 1], p[:, i + 1:] + p[:, i:i + 1]
                value[i, i + 1:] += (d * d // s).sum(axis=0)
    i, j = np.triu_indices(len(sources), 1)
    lang = marks["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": sources.take(pa.array(i)), "b": sources.take(pa.array(j)), "value": pa.array(value[i, j])})


def source_divergence(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
                      min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Terms are runs of ASCII letters and other characters beyond ASCII, ASCII letters in lower case; a language keeps
    those that occur in at least ``min_docs`` of its rows. With p and q the smoothed shares of a term (``share``) the
    value of a term is floor((p - q)² / (p + q)). Part ``pair`` sums it against each other source of the language
    over all kept terms, part ``term`` lists the ``top`` terms that are more frequent in the source than in the language.

    A null text, language or source counts as the empty one. Empty texts still make their source occur; repeated rows
    count as often as they occur; equal values are ranked by the item in UTF-8 order. A language without kept terms
    has pairs of value 0 and no terms, one with a single source has no pairs. Other columns are not read; an empty
    table gives an empty result. The number of sources of a language is not limited, but its pairs are the result.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
               for c, name in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))]
    counted = docs.select(*columns).mapInArrow(partial_counts, "lang string, source string, term string, n bigint, docs bigint")
    counts = stage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "source-terms")
    totals = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = stage(totals.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "kept-terms")
    cells = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-cells")

    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    languages = languages.join(cells.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_CELLS).cast("int").alias("shards")), "lang")
    groups = counts.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = stage(groups.join(languages, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]).na.fill(1, ["shards"]), "source-groups")

    named = cells.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = named.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    shard = F.expr("cast(pmod(xxhash64(term), shards) as int)")
    rows = cells.join(groups.select("lang", "shards").distinct(), "lang").select("lang", shard.alias("shard"), "source", "term", "n", F.lit(0).cast("long").alias("kept"))
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source",
                          F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "kept")
    parts = rows.unionByName(marks).groupBy("lang", "shard").applyInArrow(_shard_divergences, "lang string, a string, b string, value bigint")
    sums = stage(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "source-pairs")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))

    def ranked(part: str, df: DataFrame) -> DataFrame:
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    return ranked("pair", pairs).union(ranked("term", terms).where(F.col("rank") <= top))
