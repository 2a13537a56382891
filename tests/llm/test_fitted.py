"""Fitted operators: held-out accuracy, mixtures, targets and odd rows."""

import math
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from raretide.llm import language, mixing, toxicity
from raretide.llm.common import fold, table
from raretide.llm.queries import DOMAIN_SQL, WEIGHTS

ODD = [(900001, None), (900002, ""), (900003, "123 *** !!"), (None, "the of and"), (900005, "the " * 60_000), (900006, "\x00 é")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return table(spark, MEDIUM, "documents").unionByName(odd).withColumns({c: F.lit("x") for c in ("label", "p", "gram", "domain", "__rate2")})


def test_fold(spark):
    rows = spark.range(50).withColumn("f", fold("id", 4)).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_language_accuracy_and_odd_rows(docs):
    model = language.fit(docs, where=fold("doc_id", 4) != 2)
    assert model.languages == ["de", "en", "es", "fr"]
    out = language.predict(docs, model).select("doc_id", "lang", "lang_pred", "score", (fold("doc_id", 4) == 2).alias("held_out")).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    odd = {r.doc_id: r for r in out if r.lang is None}
    assert odd[900001].lang_pred == odd[900002].lang_pred == odd[900003].lang_pred == "und"
    assert odd[900001].score == 0.0 and odd[900005].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out)


def _shares(model, text):
    grams, counts = language.gram_histogram(text)
    return language.infer(model.log_probabilities[grams], counts)


def test_one_letter_and_clashing_names(spark, docs):
    model = language.fit(docs)
    rows = spark.createDataFrame([(1, "a"), (2, "1 I 2"), (3, "é"), (4, "7 _ 7"), (4, "7 _ 7"), (None, "y"), (5, "x" * 9 + " ")], "doc_id bigint, text string")
    out = language.predict(rows.withColumns({"score": F.lit("x"), "lang_pred": F.lit(0)}), model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == 7
    for r in got:
        assert (r.lang_pred, r.score) == ("und", 0.0) if r.text == "7 _ 7" else r.lang_pred in model.languages and 0 < r.score <= 1
    assert language.predict(rows.where("false"), model).collect() == []


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "Die Straße, 12 Häuser  und der Weg. " * 40
    whole = language.gram_histogram(text)
    for size in (5, 64, 1000):
        monkeypatch.setattr(language, "SLICE", size)
        assert all((a == b).all() for a, b in zip(whole, language.gram_histogram(text), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_language_set_is_the_best_of_all_sets(seed):
    """Against the penalised likelihood of every set of languages; up to five of six languages in one text."""
    rng, k = np.random.default_rng(seed), 6
    table = np.log(rng.dirichlet(np.full(300, 0.05), size=k).T + 1e-6)
    drawn = [rng.choice(300, 400, p=np.exp(table[:, i]) / np.exp(table[:, i]).sum()) for i in rng.permutation(k)[: 1 + seed % 5]]
    grams, counts = np.unique(np.concatenate(drawn), return_counts=True)
    logs = table[grams]

    def value(members):
        _, best = language.mixture(np.exp(logs[:, members] - logs[:, [0]]), counts)
        return best - language.penalty(counts.sum()) * (len(members) - 1)

    sets = [list(c) for size in range(1, k + 1) for c in combinations(range(k), size)]
    assert set(np.flatnonzero(language.infer(logs, counts))) == set(max(sets, key=value)) and len(max(sets, key=value)) == len(drawn)


def test_two_languages_in_one_text(spark, docs):
    model = language.fit(docs)
    one = {r.lang: r.text for r in docs.where("length(text) > 8000 and text not rlike '[#|!%]' and lang is not null").dropDuplicates(["lang"]).collect()}
    both = one["en"][:6000] + "\n" + one["fr"][:3000]
    shares = _shares(model, both)
    share = dict(zip(model.languages, shares))
    assert {k for k, v in share.items() if v > 0} == {"en", "fr"}
    assert share["en"] == pytest.approx(2 / 3, abs=0.08) and sum(shares) == pytest.approx(1)
    alone = _shares(model, one["de"])
    assert (alone > 0).sum() == 1


def test_mixture_is_the_likelihood_maximum():
    rng = np.random.default_rng(3)
    ratios = rng.gamma(1.0, size=(400, 2))
    share, value = language.mixture(ratios, np.ones(400))
    grid = [float(np.log(ratios @ np.array([x, 1 - x])).sum()) for x in np.linspace(0, 1, 2001)]
    assert value == pytest.approx(max(grid), abs=1e-2) and share.sum() == pytest.approx(1)


def test_language_without_training_rows(docs):
    model = language.fit(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs.limit(5), model).collect()} == {("und", 0.0)}


def test_toxicity_held_out(spark, docs):
    # labels are few at this size: the same table serves, cut into the folds of the query
    labels = table(spark, MEDIUM, "labels")
    model = toxicity.fit(docs, labels, where=fold("__id", 3) != 1)
    out = toxicity.predict(docs, model).join(labels, "doc_id", "left").select("doc_id", "score", "predicted", "toxic", (fold("doc_id", 3) == 1).alias("h")).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.h and r.toxic is not None]
    assert not any(r.predicted for r in held if r.toxic == 0)
    assert sum(r.predicted for r in held if r.toxic) >= 0.7 * sum(r.toxic for r in held)
    by_id = {r.doc_id: r for r in out}
    assert by_id[900001].score == by_id[900002].score  # null is scored as empty


def test_toxicity_without_labels(docs, spark):
    none = table(spark, MEDIUM, "labels").where("false")
    assert {r.score for r in toxicity.predict(docs.limit(20), toxicity.fit(docs, none)).collect()} == {0.5}


def test_features_count_occurrences():
    every = np.ones(1 << toxicity.BITS, bool)
    once, twice = toxicity.features("idiot", every), toxicity.features("idiot idiot", every)
    assert set(once[0].tolist()) <= set(twice[0].tolist()) and len(set(twice[0].tolist())) == len(twice[0])
    n = dict(zip(twice[0].tolist(), twice[1].tolist()))
    assert all(n[b] == pytest.approx(np.log(3)) for b in once[0].tolist())
    assert toxicity.features("idiot", ~every)[0].size == 0


def test_rates_meet_targets(spark, docs):
    labels = table(spark, MEDIUM, "labels")
    mixed = mixing.mix(docs, labels, F.expr(DOMAIN_SQL), WEIGHTS, tokens=100_000.0).select("doc_id", "text", "__mix.*", "__rate", "__copies").collect()
    assert len(mixed) == docs.count()
    assert all(r["__rate"] >= 0 and sum(r.p) == mixing.GRID and r.n_tokens == len((r.text or "").encode().split()) for r in mixed)
    for k, share in enumerate(WEIGHTS.values()):
        total = sum(r["__rate"] * r.n_tokens * r.p[k] / mixing.GRID for r in mixed)
        assert total == pytest.approx(100_000 * share, rel=1e-3)
    assert all(r["__copies"] in (math.floor(r["__rate"]), math.floor(r["__rate"]) + 1) for r in mixed)


def test_rates_are_the_projected_optimum(spark):
    """Against a dense projected-gradient solve over single documents, with a target that cannot be met."""
    rng = np.random.default_rng(5)
    p = rng.multinomial(mixing.GRID, [0.5, 0.3, 0.2], size=60)
    p = p[p[:, 0] > 0]
    tokens = rng.integers(1, 500, len(p)).astype(float)
    cells = spark.createDataFrame([(x.tolist(), float(n)) for x, n in zip(p, tokens)], "p array<int>, tokens double")
    targets = [float(tokens.sum()), 10.0, 10.0]
    fitted = mixing.fit_rates(cells, targets, ["a", "b", "c"])
    rates = [r.r for r in cells.select(mixing.rates_of(F.col("p"), fitted.steps)["rate"].alias("r")).collect()]
    a = (p / mixing.GRID).T
    scale = np.diag((a * tokens) @ a.T)
    r = np.ones(len(p))
    for _ in range(20_000):
        r = np.maximum(0, r - 0.3 * ((a * tokens) @ r - targets) / scale @ a)
    assert min(rates) >= 0

    def cost(x):
        return float((((a * tokens) @ np.array(x) - targets) ** 2 / scale).sum())

    assert cost(rates) <= cost(r) * 1.02 + 1e-6


def test_mix_of_an_empty_table(spark, docs):
    assert mixing.mix(docs.where("false"), table(spark, MEDIUM, "labels"), F.expr(DOMAIN_SQL), WEIGHTS, anchor="good").collect() == []


def test_a_filter_on_the_copies_computes_no_posterior_twice(spark, docs):
    mixed = mixing.mix(docs, table(spark, MEDIUM, "labels"), F.expr(DOMAIN_SQL), WEIGHTS, tokens=100_000.0)
    plan = mixed.where("__copies > 0").select("doc_id", "__copies")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
