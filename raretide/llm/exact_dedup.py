"""Exact deduplication by content-defined chunk recipes.

A text is cut where a hash of the last eight bytes hits a mask, so equal passages give equal chunks wherever they
stand. Distinct chunks get verified identifiers: the digest, and a variant number where chunks of one digest differ
in content. Documents are equal when their ordered lists of identifiers are. Each distinct chunk moves once per
map task; after that only digests move, never a long document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from raretide.llm.common import small_batches, stage

MEAN_CHUNK = 1024
SHORTEST, LONGEST = 256, 8192
DIGEST_BYTES = 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cut_points(data: bytes, mean: int = MEAN_CHUNK, shortest: int = SHORTEST, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of ``data``. They depend on content alone; no chunk but the last is below ``shortest``."""
    n = len(data)
    if n <= shortest:
        return [n] if n else []
    padded = np.frombuffer(data, np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[: n - 7].view(), (n - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    hits = np.flatnonzero((words * _FACTOR) >> np.uint64(64 - int(np.log2(mean))) == 0) + 8
    ends, start = [], 0
    for hit in hits.tolist():
        while hit - start > longest:
            start += longest
            ends.append(start)
        if hit - start >= shortest and hit < n:
            ends.append(hit)
            start = hit
    while n - start > longest:
        start += longest
        ends.append(start)
    return [*ends, n] if start < n else ends


def _chunks(batches, id_column, text_column, digest_bytes):
    """(row's id, text, [(digest, content)]) of every row."""
    for batch in small_batches(batches):
        for row, text in zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist(), strict=True):
            data = (text or "").encode("utf-8")
            start, parts = 0, []
            for end in cut_points(data):
                part = data[start:end]
                parts.append((hashlib.sha256(part).digest()[:digest_bytes], part))
                start = end
            yield row, data, parts


def _batched(rows, schema: pa.Schema, size: int = 2000, limit: int = 8 << 20):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= size or weight >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def document_recipes(docs: DataFrame, id_column: str, text_column: str, digest_bytes: int) -> DataFrame:
    """(id, digest of the text, its chunks' digests one after another)."""
    schema = pa.schema([(id_column, pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.binary())])

    def run(batches):
        rows = ((row, hashlib.sha256(data).hexdigest(), b"".join(d for d, _ in parts))
                for row, data, parts in _chunks(batches, id_column, text_column, digest_bytes))
        yield from _batched(rows, schema)

    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(
        run, f"{id_column} bigint, text_sha256 string, recipe binary")


def distinct_chunks(docs: DataFrame, id_column: str, text_column: str, digest_bytes: int) -> DataFrame:
    """Distinct (digest, content). Copies are merged in the map task, so a hot passage moves once per task."""
    schema = pa.schema([("digest", pa.binary()), ("content", pa.binary())])

    def run(batches):
        rows = ((d, part) for _, _, parts in _chunks(batches, id_column, text_column, digest_bytes) for d, part in parts)
        yield from _batched(rows, schema)

    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(
        run, "digest binary, content binary").distinct()


def verified_recipes(docs: DataFrame, id_column: str, text_column: str, digest_bytes: int) -> DataFrame:
    """(id, text_sha256, recipe) where ``recipe`` lists verified identifiers.

    Contents of one digest are compared in full. Where they differ, they are numbered, and the numbers of such
    chunks join the recipes of the documents that hold them; elsewhere the digest itself is the identifier.
    """
    recipes = stage(document_recipes(docs, id_column, text_column, digest_bytes), "recipes")
    chunks = distinct_chunks(docs, id_column, text_column, digest_bytes)
    several = stage(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "chunk-variants")
    if several.isEmpty():
        return recipes
    numbered = chunks.join(several, "digest", "left_semi").select(
        "digest", "content", F.row_number().over(Window.partitionBy("digest").orderBy("content")).alias("variant"))
    schema = pa.schema([(id_column, pa.int64()), ("sha", pa.string()), ("pos", pa.int32()), ("digest", pa.binary()), ("content", pa.binary())])

    def run(batches):
        rows = ((row, hashlib.sha256(data).hexdigest(), i, d, part)
                for row, data, parts in _chunks(batches, id_column, text_column, digest_bytes) for i, (d, part) in enumerate(parts))
        yield from _batched(rows, schema)

    placed = docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(
        run, f"{id_column} bigint, sha string, pos int, digest binary, content binary").join(several, "digest", "left_semi")
    variants = (
        placed.join(numbered, ["digest", "content"]).groupBy(id_column, "sha")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("pos", "variant"))),
                                      lambda x: F.concat_ws(":", x["pos"], x["variant"])), ",").alias("numbers"))
    )
    joined = recipes.join(variants, recipes[id_column].eqNullSafe(variants[id_column]) & (recipes.text_sha256 == variants.sha), "left")
    number = F.coalesce(F.encode("numbers", "UTF-8"), F.lit(b""))
    return joined.select(recipes[id_column], "text_sha256", F.concat("recipe", number).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the UTF-8 text).

    Texts are equal when identical; a null text counts as the empty one, whose recipe is the empty list. The largest
    id of a group stays. Rows with a null id are grouped and counted but never the ones kept unless the whole group
    has no id (then ``keep_id`` is null and none of its rows is kept). Of rows that repeat the kept id, each is
    marked kept; ids are expected to be unique. Other columns are not read; an empty table gives an empty result.

    The group totals are summed before the shuffle. Groups of one need no join; the join of the others is on the
    digest of the identifier list and can be split by Spark where one group holds a large share of the rows.
    """
    recipes = verified_recipes(docs, id_column, text_column, digest_bytes)
    groups = recipes.groupBy("recipe").agg(F.max(id_column).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = stage(groups, "recipe-groups")  # else the join would keep the aggregate's partitions, which cannot be split
    joined = recipes.join(groups.withColumnRenamed("recipe", "r"), F.col("recipe") == F.col("r"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_column)).otherwise(F.col("keep_id"))
    return joined.select(
        id_column, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col(id_column) == keep, F.lit(False)).alias("kept"), "text_sha256",
    )
