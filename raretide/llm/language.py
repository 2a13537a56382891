"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its byte n-grams comes from one of them. Expectation-maximisation
estimates the proportions from the n-gram likelihoods of the learned languages, and the set of languages is the one
with the best penalised likelihood. The n-gram model is a table of counts summed by Spark over all training rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raretide.llm.common import byte_windows, gram_buckets, letter_bytes, small_batches, stage, texts

ORDER, BITS = 4, 17
SMOOTHING = 0.1
# Neighbouring n-grams overlap, so a text of n of them holds about n / ORDER independent observations.
PENALTY = 0.5
EM_ROUNDS, EM_CHANGE = 60, 1e-4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_probabilities: np.ndarray  # (buckets, languages), float32


# Bytes of a text that are turned into n-grams at once.
SLICE = 1 << 20


def _grams(text: str) -> np.ndarray:
    return _grams_of(letter_bytes(text))


def _grams_of(data: bytes) -> np.ndarray:
    windows = byte_windows(data)[: max(0, len(data) - ORDER + 1)]
    windows = windows[(windows & np.uint64(0xFFFF)) != 0x2020]  # runs of blanks say nothing
    return gram_buckets(windows, ORDER, BITS)


def gram_histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs: at most 2**BITS numbers, however long the text is."""
    data = letter_bytes(text)
    if len(data) <= SLICE:
        return np.unique(_grams_of(data), return_counts=True)
    counts = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(data) - ORDER + 1, SLICE):
        counts += np.bincount(_grams_of(data[start : start + SLICE + ORDER - 1]), minlength=len(counts))
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def _short_text(text: str, table: np.ndarray) -> np.ndarray:
    """One row of log-likelihoods for a text without an n-gram: of its first ORDER - 1 bytes, whatever follows."""
    start = b" " + b" ".join(letter_bytes(text).split())
    start = start.ljust(ORDER - 1)[: ORDER - 1]
    grams = np.concatenate([_grams_of(start + bytes([b])) for b in range(256)])
    return np.log(np.exp(table[grams].astype(np.float64)).sum(axis=0))[None, :]


def gram_counts(docs: DataFrame, text_column: str, label_column: str) -> DataFrame:
    """(label, gram, n): counts over all rows with a text and a label, summed per task before the shuffle."""
    schema = pa.schema([("label", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def flush(held):
        for label, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], schema=schema)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in small_batches(batches):
            for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                if label not in held:
                    if len(held) >= 32:  # a task keeps few tables at once; Spark adds up what it lets go
                        yield from flush(held)
                        held.clear()
                    held[label] = np.zeros(1 << BITS, np.int64)
                np.add.at(held[label], _grams(text), 1)
        yield from flush(held)

    pairs = docs.select(F.col(text_column).alias("text"), F.col(label_column).alias("label")).where("text is not null and label is not null")
    return pairs.mapInArrow(run, "label string, gram int, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_column: str = "text", label_column: str = "lang", where: Column | None = None) -> LanguageModel:
    """Learn one n-gram distribution per label from all rows that ``where`` keeps.

    What reaches the driver is the count table: at most 2**17 numbers per language, whatever the corpus. Null texts
    and null labels teach nothing; with no rows left the model knows no language.
    """
    rows = docs if where is None else docs.where(where)
    counts = gram_counts(rows, text_column, label_column).toArrow()
    labels = np.asarray(counts.column("label").to_pylist(), dtype=object)
    languages = sorted(set(labels.tolist()))
    table = np.full((1 << BITS, len(languages)), SMOOTHING)
    grams, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    for k, language in enumerate(languages):
        own = labels == language
        table[grams[own], k] += n[own]
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixture(ratios: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood; ``ratios`` are (n-grams, languages) likelihoods
    of n-grams that occur ``counts`` times."""
    share, n = np.full(ratios.shape[1], 1.0 / ratios.shape[1]), counts.sum()
    for _ in range(EM_ROUNDS):
        weighted = ratios * share
        new = counts @ (weighted / weighted.sum(axis=1, keepdims=True)) / n
        moved, share = np.abs(new - share).max(), new
        if moved < EM_CHANGE:
            break
    return share, float(counts @ np.log((ratios * share).sum(axis=1)))


def penalty(n: float) -> float:
    """What a further language must add to the log-likelihood of ``n`` n-grams."""
    return PENALTY * np.log(max(n / ORDER, 2.0)) * ORDER


def infer(logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions of all languages in one text, out of the (n-grams, languages) log-likelihoods and their counts.

    Languages join the set one by one, each time the one with the best penalised likelihood. The log-likelihood is
    concave in the proportions: while no language has a mean likelihood ratio above one, none can add anything, and
    all that have one are tried.
    """
    n, k = counts.sum(), logs.shape[1]
    totals = counts @ logs.astype(np.float64)
    chosen = [int(totals.argmax())]
    ratios = np.exp(np.minimum(logs - logs[:, chosen], 60.0).astype(np.float64))
    share, best = np.ones(1), 0.0
    while len(chosen) < k:
        now = (ratios[:, chosen] * share).sum(axis=1)
        gains = counts @ (ratios / now[:, None]) / n
        gains[chosen] = 0.0
        fits = [(mixture(ratios[:, [*chosen, i]], counts), int(i)) for i in np.flatnonzero(gains > 1.0)]
        (new_share, value), i = max(fits, key=lambda f: f[0][1], default=((share, best), -1))
        if i < 0 or value - best <= penalty(n):
            break
        chosen, share, best = [*chosen, i], new_share, value
    out = np.zeros(k)
    out[chosen] = share
    if len(chosen) == 1:  # a single language: how sure it is among the single languages
        weights = np.exp(np.maximum((totals - totals.max()) / ORDER, -700.0))
        out[chosen[0]] = weights[chosen[0]] / weights.sum()
    return out


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` behind them (their names start with ``prefix``).

    ``score`` is the proportion of the predicted language (in a text of one language, its posterior weight); ties go
    to the language that comes first by name. A text that is null or has no letters gets ``und`` and 0, as does every
    text when the model knows no language; a text of a single letter is told by the n-grams that start with it. Rows
    are neither dropped nor merged, so repeated rows and ids come back as they are and an empty table gives none.
    Columns of ``docs`` that have the name of a result are replaced.
    """
    languages, table = model.languages, model.log_probabilities

    def run(column: pa.Array) -> pa.Array:
        best, scores = [], []
        for text in column.to_pylist():
            if not languages or not text or not _LETTER.search(text):
                best.append(UNKNOWN)
                scores.append(0.0)
                continue
            grams, counts = gram_histogram(text)
            shares = infer(table[grams], counts) if len(grams) else infer(_short_text(text, table), np.ones(1))
            k = int(shares.argmax())
            best.append(languages[k])
            scores.append(min(1.0, float(shares[k])))
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    guess = F.arrow_udf(run, "lang_pred string, score double")(F.col(text_column))
    names = [c for c in docs.columns if c not in (prefix + "lang_pred", prefix + "score")]
    wide = docs.withColumn("__guess__", guess)
    return wide.select(*[F.col(f"`{c}`") for c in names], F.col("__guess__.lang_pred").alias(prefix + "lang_pred"),
                       F.col("__guess__.score").alias(prefix + "score"))
