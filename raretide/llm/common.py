"""Small helpers of the training-data operators: tables, staged results, folds and hashing in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raretide.session import stage  # noqa: F401  (staged copies live in the shared folder of the session)

# The white space that separates words in every operator of this package.
SPACE = r"\x20\x09-\x0D"
_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(folds)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def small_batches(batches, rows: int = 256):
    """Slices of at most ``rows`` rows, so that what Python derives from a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications and three shifts); a bijection with well spread bits."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


# ASCII letters in lower case, bytes of other characters as they are, everything else a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_bytes(text: str) -> bytes:
    """Lower-case letters of ``text`` in UTF-8 with one space in front and behind; other ASCII is blanked."""
    return b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" "


def byte_windows(data: bytes) -> np.ndarray:
    """For each byte of ``data`` the eight bytes from there on as one number (zeros behind the end)."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    n = len(data)
    return np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()


def gram_buckets(windows: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Buckets (below 2**bits) of the byte n-grams that start at each window."""
    grams = windows & _U64((1 << (8 * order)) - 1) if order < 8 else windows
    return ((grams * _U64(0x9E3779B97F4A7C15) + _U64(order)) * _U64(0xBF58476D1CE4E5B9) >> _U64(64 - bits)).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, id_column: str, text_column: str,
                    where: Column | None, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled rows: those with the smallest hash of the id. ``label`` is an
    expression on ``labels``, ``where`` one on ``__id``. The sample of ids is bounded, so it is sent to the tasks."""
    y = labels.select(F.col(id_column).alias("__id"), label.alias("label")).where("__id is not null and label is not null")
    y = y.groupBy("__id").agg(F.max("label").alias("label"))  # an id that is labelled twice counts once
    if where is not None:
        y = y.where(where)
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    found = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("text"))
    return stage(found.join(F.broadcast(y), "__id").select("text", "label"), "labelled-sample")
