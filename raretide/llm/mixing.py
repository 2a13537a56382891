"""Mixing with soft membership: document rates whose expected domain token totals match targets.

A classifier fitted on labelled rows gives every document a posterior over domains, rounded to a grid. Documents of
one grid cell have the same rate, so the corpus is summed to cells once, and the least-squares problem over all
documents is solved exactly on the cells: projected gradient steps, each of them one Spark aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raretide.llm.common import byte_windows, gram_buckets, labelled_sample, small_batches, stage, texts

ORDER, BITS = 4, 16
FIT_ROWS = 20_000
SMOOTHING = 0.5
# A document counts as at most this many independent n-grams; it keeps posteriors of long texts soft.
EVIDENCE = 64
GRID = 100
# The rates of all cells are sent to every task if the grid has at most this many cells; else they are joined.
BROADCAST_CELLS = 200_000
CELLS_PER_TASK = 50_000
MAX_STEPS, TOLERANCE = 400, 1e-6


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    log_prior: np.ndarray
    log_probabilities: np.ndarray  # (buckets, domains), float32


@dataclass(frozen=True)
class Mixture:
    """Fitted rates: ``steps`` are the gradient steps (a momentum and one number per domain each) from 1 to the rates."""

    domains: list[str]
    steps: list[list[float]]
    targets: list[float]
    totals: list[float] = field(default_factory=list)


def _grams(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    return gram_buckets(byte_windows(data)[: max(0, len(data) - ORDER + 1)], ORDER, BITS)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_column: str = "doc_id",
                text_column: str = "text", rows: int = FIT_ROWS) -> DomainModel:
    """Naive Bayes over byte n-grams from at most ``rows`` labelled rows; the counts are summed by Spark.

    ``domain`` is an expression on the label table; values outside ``domains`` and nulls teach nothing. A domain
    without labelled rows keeps a prior of one smoothed row.
    """
    k = len(domains)
    known = F.when(domain.isin(domains), domain)
    sample = labelled_sample(docs, labels, known, id_column, text_column, None, rows)
    schema = pa.schema([("domain", pa.int32()), ("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros((k, (1 << BITS) + 1), np.int64)
        for batch in small_batches(batches):
            for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                own = counts[domains.index(label)]
                np.add.at(own, _grams(text), 1)
                own[-1] += 1  # rows
        d, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(counts[d, g])], schema=schema)

    sums = sample.mapInArrow(run, "domain int, gram int, n bigint").groupBy("domain", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(((1 << BITS) + 1, k), SMOOTHING)
    table[sums.column("gram").to_numpy(), sums.column("domain").to_numpy()] += sums.column("n").to_numpy()
    prior, grams = table[-1], table[:-1]
    return DomainModel(domains, np.log(prior / prior.sum()), np.log(grams / grams.sum(axis=0)).astype(np.float32))


def posteriors(docs: DataFrame, model: DomainModel, text_column: str = "text") -> DataFrame:
    """``docs`` with ``__mix``: a struct of ``n_tokens`` (words) and ``p`` (the posterior, in grid units that sum to GRID).

    The function is marked as not deterministic, though it is: else Spark moves a later filter on the result in front of it
    and computes every posterior twice, in two Python processes of each task.
    """

    def run(column: pa.Array) -> pa.Array:
        tokens, cells = [], []
        for text in column.to_pylist():
            text = text or ""
            grams = _grams(text)
            score = model.log_prior.copy()
            if len(grams):
                score += model.log_probabilities[grams].mean(axis=0, dtype=np.float64) * min(EVIDENCE, len(grams))
            p = np.exp(score - score.max())
            p = p / p.sum() * GRID
            low = np.floor(p).astype(np.int32)
            low[np.argsort(low - p, kind="stable")[: GRID - int(low.sum())]] += 1  # largest remainders
            tokens.append(len(text.encode("utf-8", "replace").split()))
            cells.append(low.tolist())
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["n_tokens", "p"])

    return docs.withColumn("__mix", F.arrow_udf(run, "n_tokens bigint, p array<int>").asNondeterministic()(F.col(text_column)))


def rates_of(p: Column, steps: list[list[float]]) -> Column:
    """(rate, ahead) of a posterior after all steps, from 1 on.

    Each step is a momentum and a move for each domain: the rate is the last ``ahead`` moved and projected onto rates of
    at least 0, the new ``ahead`` is the rate pushed on by the momentum.
    """
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    if not steps:
        return start
    taken = F.from_json(F.lit(str(steps)), "array<array<double>>")

    def one(state, step):
        moved = F.aggregate(F.zip_with(p, F.slice(step, 2, F.size(p)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        rate = F.greatest(F.lit(0.0), state["ahead"] - moved / GRID)
        return F.struct(rate.alias("rate"), (rate + step[0] * (rate - state["rate"])).alias("ahead"))

    return F.aggregate(taken, start, one)


def fit_rates(cells: DataFrame, targets: list[float], domains: list[str]) -> Mixture:
    """Accelerated projected gradient over ``cells`` (p, tokens): minimise the squared misses of the domain totals,
    each relative to the domain's weight in the corpus.

    Changes of a rate are weighed by the document's tokens, so the gradient of a rate is the posterior times the
    misses. Momentum starts anew whenever the misses grow. Only 2 K sums reach the driver in each round. Rounds end
    when all targets are met to ``TOLERANCE``, when the rates no longer move (targets that cannot be met), or after
    ``MAX_STEPS``.
    """
    k = len(domains)
    p = [F.col("p")[i] / GRID for i in range(k)]
    gram = cells.agg(*[F.coalesce(F.sum(p[i] * p[j] * F.col("tokens")), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    g = np.array([float(x) for x in gram]).reshape(k, k)
    scale = np.where(np.diag(g) > 0, np.diag(g), np.inf)
    eta = 1.0 / max(np.linalg.eigvalsh(g / np.sqrt(np.outer(scale, scale)))[-1], 1e-12)
    want, steps, age, last, still = np.array(targets, float), [], 1, np.inf, 0
    close = TOLERANCE * max(want.sum(), 1.0)
    before = np.full(k, np.inf)
    while True:
        state = cells.select("p", "tokens", rates_of(F.col("p"), steps).alias("s"))
        sums = state.agg(*[F.coalesce(F.sum(F.col(f"s.{x}") * p[i] * F.col("tokens")), F.lit(0.0)).alias(f"{x}{i}") for x in ("rate", "ahead") for i in range(k)]).first()
        totals, ahead = np.array([float(x) for x in sums[:k]]), np.array([float(x) for x in sums[k:]])
        still = still + 1 if np.abs(totals - before).max() <= 1e-2 * close else 0
        if np.abs(totals - want).max() <= close or still > 2 or len(steps) >= MAX_STEPS:
            break
        before = totals
        cost = float(((totals - want) ** 2 / scale).sum())
        age = 1 if cost > last else age + 1
        last = cost
        steps.append([(age - 1) / (age + 2), *(float(x) for x in eta * (ahead - want) / scale)])
    return Mixture(domains, steps, [float(x) for x in want], totals.tolist())


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], id_column: str = "doc_id",
        text_column: str = "text", tokens: float | None = None, anchor: str | None = None, seed: int = 17,
        rows: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` with ``__mix`` (n_tokens, p), ``__rate`` and ``__copies`` behind them.

    ``weights`` gives each domain's share of the wanted tokens; ``tokens`` is their number. By default it is that of
    the input, or with an ``anchor`` domain the number that asks for all of that domain's expected tokens. ``__copies`` is the whole number of times a document enters the mix: its rate, rounded up or down by a
    hash of its id, so that it is right on average and the same in every run. Null texts have no tokens, the prior
    as posterior and the rate of that posterior. Null ids are rounded like any one id. Rows are neither dropped nor
    merged here; an empty table gives an empty result.
    """
    domains = list(weights)
    model = fit_domains(docs, labels, domain, domains, id_column, text_column, rows)
    scored = posteriors(docs.select(F.col(text_column).alias("text")), model, "text").select("__mix.*")
    bound = comb(GRID + len(domains) - 1, len(domains) - 1)  # cells of the grid
    summed = scored.groupBy("p").agg(F.sum("n_tokens").alias("tokens"))
    # Every step reads the cells again: a few files of many cells, not one per shuffle partition.
    cells = stage(summed.repartition(-(-bound // CELLS_PER_TASK)) if bound <= BROADCAST_CELLS else summed, "mix-cells")
    share = sum(weights.values())
    total = tokens
    if total is None:
        held = F.lit(1.0) if anchor is None else F.col("p")[domains.index(anchor)] / GRID * share / weights[anchor]
        total = float(cells.agg(F.coalesce(F.sum(held * F.col("tokens")), F.lit(0.0))).first()[0])
    fitted = fit_rates(cells, [total * weights[d] / share for d in domains], domains)
    rates = cells.select(F.col("p").alias("__p"), rates_of(F.col("p"), fitted.steps)["rate"].alias("__rate"))
    with_mix = posteriors(docs, model, text_column)
    if bound <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    dealt = with_mix.join(rates, with_mix["__mix.p"] == rates["__p"], "left").drop("__p")
    u = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return dealt.withColumn("__copies", F.floor(F.col("__rate") + u).cast("int"))
