"""Source divergence and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from raretide.llm import divergence, spelling
from raretide.llm.common import table
from raretide.llm.fm_index import FMIndex, suffix_array

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def divergences(rows, min_docs, top):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in sources:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        of = {s: [counts[lang, s][t] for t in kept] for s in sources[lang]}
        whole = [sum(of[s][k] for s in of) for k in range(len(kept))]
        share = lambda c: [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c]
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        q = share(whole)
        for s in of:
            p = share(of[s])
            parts = {"pair": [(sum(map(f, p, share(of[o]))), o) for o in of if o != s],
                     "term": [(f(p[k], q[k]), t) for k, t in enumerate(kept) if of[s][k] and p[k] > q[k]]}
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    words = [w + e for w in ("alpha", "Beta", "ÉTÉ", "x", "naïve", "日本", "Z") for e in ("", "s", "-t", "!", "0q")]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None])) for _ in range(300)]
    rows += [(None, "en", "nothing"), ("", "fr", "x"), ("\x00\t9", "fr", "y"), ("solo", "it", "only")]
    return rows + rows[:20]


def test_divergence_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_CELLS", 20)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    docs = docs.withColumns({c: F.lit("x") for c in ("term", "n", "docs", "shard", "kept", "item", "value")})
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, min_docs=10, top=4).collect())
    assert got == divergences(rows, 10, 4)
    assert divergence.source_divergence(docs.where("false")).collect() == []


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    rows = [("one two " * 700 + "three", "en", "a"), ("two", "en", "b"), ("z" * 5000, "en", "b")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 0)], ["lang", "source", "text"])
    monkeypatch.setattr(divergence, "PIECE", 100)
    counted = {(r["source"], r["term"]): (r["n"], r["docs"]) for b in divergence.partial_counts(iter([batch])) for r in b.to_pylist() if r["term"]}
    assert counted == {("a", "one"): (700, 1), ("a", "two"): (700, 1), ("a", "three"): (1, 1), ("b", "two"): (1, 1), ("b", "z" * 5000): (1, 1)}


def test_shares_are_exact_for_large_counts(spark):
    counts = [0, 1, 10**9, 10**12 + 7, 8 * 10**15]
    total, kept = 8 * 10**15 + 10**12 + 10**9 + 8, 5
    expected = [1 + 10**9 * (n + 2) // (total + 2 * kept) for n in counts]
    assert divergence.shares(np.array(counts), np.int64(total), kept).tolist() == expected
    df = spark.createDataFrame([(n,) for n in counts], "n bigint")
    got = df.select(divergence.share(F.col("n"), F.lit(total).cast("long"), F.lit(kept).cast("long")).alias("p")).collect()
    assert [r.p for r in got] == expected


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    masks = defaultdict(set)  # a word with one code point taken out or blanked
    for w in n:
        for key in [(w, -1), *((w[:i] + w[i + 1:], -1) for i in range(len(w))), *((w[:i] + w[i + 1:], i) for i in range(len(w)))]:
            masks[key].add(w)
    near = defaultdict(set)
    for group in masks.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def check_variants(docs, rows):
    got = sorted((tuple(r) for r in spelling.spelling_variants(docs).collect()), key=str)
    assert got == variants(rows)
    return got


def test_variants_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 60)  # groups of words with equal letters are dealt over several shards
    rng = random.Random(7)
    letters = "abÉz÷"
    base = ["".join(rng.choices(letters, k=rng.randrange(5, 16))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "babab", "ababa"]
    pool = []
    for w in base:
        for _ in range(12):
            k = rng.randrange(len(w))
            pool.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:], w]))
        pool += [w] * rng.randrange(2, 20)
    rows = [(rng.choice([None, i, i, i]), rng.choice(["-", " ", "\n9"]).join(rng.choices(pool, k=60))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, "日本 12"), (4, "long" * 30_000), *rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    docs = docs.withColumns({c: F.lit("x") for c in ("word", "n", "form", "root", "near", "shard", "id")})
    got = check_variants(docs, rows)
    assert sum(r[1] is not None for r in got) > 50 and len({r[2] for r in got if r[1]}) > 10
    assert spelling.spelling_variants(docs.where("false")).collect() == []


def test_variants_of_given_documents(spark):
    docs = table(spark, SMALL, "documents")
    check_variants(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("few_rows", [0, 48])
def test_index_finds_all_words_one_edit_away(monkeypatch, few_rows):
    monkeypatch.setattr("raretide.llm.fm_index.FEW_ROWS", few_rows)
    rng = random.Random(few_rows)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(4, 9))) for _ in range(1500)})
    queries = [*words[::5], "abxba", "zzzzz"]
    index, back = FMIndex(words), FMIndex(sorted(w[::-1] for w in words))
    q, w = index.one_edit(queries, np.array([len(x) - len(x) // 2 for x in queries]))
    found = {(queries[i], words[j]) for i, j in zip(q, w)}
    backward = sorted(w[::-1] for w in words)
    q, w = back.one_edit([x[::-1] for x in queries], np.array([len(x) // 2 for x in queries]))
    found |= {(queries[i], backward[j][::-1]) for i, j in zip(q, w)}
    assert found == {(a, b) for a in queries for b in words if a != b and one_edit(a, b)}


def test_suffix_array_orders_suffixes():
    text = np.array([0, 9, 7, 9, 7, 1, 9, 7, 2])
    assert suffix_array(text).tolist() == sorted(range(9), key=lambda i: text[i:].tolist())
