"""Exact and near duplicates, components, and the pipeline against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import MEDIUM, SMALL
from raretide.llm import components, exact_dedup, near_dedup
from raretide.llm.common import table


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one  two"), (6, "one two three four five"), (None, "one two"), (None, "lonely row")]
    family = words(rng, 220)
    for i in range(60):  # a chain of edits: neighbours are similar, ends are not
        rows.append((100 + i, " ".join(family)))
        family = list(family)
        for _ in range(rng.choice([1, 2, 3, 6])):
            family[rng.randrange(len(family))] = rng.choice("qrs") + str(rng.randrange(10**6))
    rows += [(200 + i, rows[20][1]) for i in range(30)]  # a group of copies
    rows += [(300 + i, " ".join(words(rng, 150))) for i in range(40)]
    long = " ".join(words(rng, 30_000))
    rows += [(400, long), (401, long), (402, long[:-40] + "x"), (403, " ".join(["same"] * 3000)), (404, " ".join(["same"] * 2000))]
    rows += [(500, "é" * 3000), (500, "é" * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    return df.withColumns({c: F.lit("x") for c in ("node", "sig", "keep_id", "recipe", "digest", "kept", "rep", "root", "id")})


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_duplicates(docs, rows, digest_bytes):
    """One-byte digests clash all the time; chunks that clash get identifiers of their own."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    expected = sorted(
        ((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
         for i, t in rows), key=str)
    out = exact_dedup.exact_duplicates(docs, digest_bytes=digest_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == expected
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.keep_id) for r in out)
    assert exact_dedup.exact_duplicates(docs.where("false")).collect() == []


def test_cut_points_depend_on_content():
    data = np.random.default_rng(1).integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert sizes.max() <= exact_dedup.LONGEST and sizes[:-1].min() >= exact_dedup.SHORTEST
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"some new text in front " + data
    again = exact_dedup.cut_points(moved)
    assert len(chunks & {moved[a:b] for a, b in zip([0, *again], again)}) >= len(chunks) - 3
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"ab") == [2]
    assert exact_dedup.cut_points(b"z" * 20_000)[-1] == 20_000


def shingle_set(text):
    w = (text or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = (rows[i][1] or "").split() == (rows[j][1] or "").split()
            if same or a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    return sorted((sorted(c, key=str) for c in classes.values()), key=str)


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates(docs, rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CARRIED", 4)
    out = near_dedup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    classes = defaultdict(list)
    for r in out:
        classes[r.class_id].append(r.doc_id)
    expected = brute_force_classes(rows)
    assert sorted((sorted(c, key=str) for c in classes.values()), key=str) == expected
    for r in out:
        assert r.class_size == len(classes[r.class_id])
        assert r.kept == (r.doc_id is not None and r.doc_id == r.class_id)
    assert near_dedup.near_duplicates(docs.where("false")).collect() == []


def test_pairs_of_a_hot_band_are_listed_by_their_other_bands(spark, monkeypatch):
    """Two texts share a hot band first, where their parts differ, and then bands that nobody else has."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = np.random.default_rng(3)
    sigs = rng.integers(1, 2**32, (34, near_dedup.REGISTERS), dtype=np.uint32)
    sigs[:, :near_dedup.ROWS] = sigs[0, :near_dedup.ROWS]
    sigs[1] = sigs[0]
    sigs[1, near_dedup.ROWS: 2 * near_dedup.ROWS] += 1  # the registers that divide the hot band
    sets = rng.integers(0, 2**64, (34, 300), dtype=np.uint64)
    sets[1] = sets[0]
    rows = [(bytes([i]), s.tobytes(), None, bytes([i]), 300, near_dedup.sketch(sets[i])) for i, s in enumerate(sigs)]
    nodes = spark.createDataFrame(rows, "node binary, sig binary, plain binary, root binary, size int, bits binary")
    buckets = near_dedup.shared_buckets(nodes.select("node", "sig", "plain"))
    got = near_dedup.open_pairs(buckets, nodes).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in got] == [(bytes([0]), bytes([1]))]


def test_all_pairs_of_a_hot_bucket_meet(spark, monkeypatch):
    """Similar texts of one bucket alone, whose further registers differ and which lie many blocks apart."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = np.random.default_rng(5)
    sigs = np.tile(rng.integers(1, 2**32, near_dedup.REGISTERS, dtype=np.uint32), (20, 1))
    sigs[:, near_dedup.ROWS + 1:: near_dedup.ROWS] = rng.integers(1, 2**32, (20, near_dedup.BANDS - 1))  # one register of each other band
    sigs[:, near_dedup.ROWS] = rng.integers(1, 2**32, 20)
    sets = np.tile(rng.integers(0, 2**64, 300, dtype=np.uint64), (20, 1))
    rows = [(bytes([i]), s.tobytes(), None, bytes([i % 19]), 300, near_dedup.sketch(sets[i])) for i, s in enumerate(sigs)]
    nodes = spark.createDataFrame(rows, "node binary, sig binary, plain binary, root binary, size int, bits binary")
    buckets = near_dedup.shared_buckets(nodes.select("node", "sig", "plain"))
    got = sorted((bytes(r.a)[0], bytes(r.b)[0]) for r in near_dedup.open_pairs(buckets, nodes).collect())
    assert got == [(i, j) for i in range(20) for j in range(i + 1, 20) if (i, j) != (0, 19)]


def test_near_duplicates_with_repeated_passages(spark):
    """The same shingles but for the seams; repeats take the probability Jaccard similarity below 0.6."""
    rng = random.Random(7)
    rows = []
    for i in range(0, 60, 2):
        text = words(rng, 200)
        rows += [(i, " ".join(text)), (i + 1, " ".join(text + text[:80] * 99))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_sketches_and_sizes_rule_out_no_similar_pair():
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 200, 5000):
        for share in (0.75, 0.8, 0.85, 0.95, 1.0):
            x = rng.integers(0, 2**64, n, dtype=np.uint64)
            y = np.concatenate([x[: round(n * share)], rng.integers(0, 2**64, rng.integers(0, n // 9 + 1), dtype=np.uint64)])
            if not len(y):
                continue
            both = len(np.intersect1d(x, y))
            bits = np.frombuffer(near_dedup.sketch(x) + near_dedup.sketch(y), np.uint64).reshape(2, -1)
            listed = list(near_dedup._across(bits, np.array([len(x), len(y)]), np.arange(2), None, 0.8))
            if both >= 0.8 * (len(x) + len(y) - both):
                assert listed == [(0, 1)]
            elif n == 200 and both < 0.75 * (len(x) + len(y) - both):
                assert not listed


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(4)
    base = words(rng, 400)
    for share in (0.5, 0.8, 0.95):
        a = base[: int(400 * share)] + words(rng, 400 - int(400 * share))
        weights = [np.unique(near_dedup.shingles(near_dedup.normalised(" ".join(x))), return_counts=True) for x in (base, a)]
        x, y = [dict(zip(h.tolist(), (1 + np.log(n)).tolist())) for h, n in weights]
        exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        s = near_dedup.signatures([near_dedup.shingles(near_dedup.normalised(" ".join(t))) for t in (base, a)])
        assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=4 * (exact * (1 - exact) / near_dedup.REGISTERS) ** 0.5)


def test_shingles_are_equal_when_words_are():
    a = near_dedup.shingles(b"a b c d e f g a b c d e")
    assert len(a) == 8 and a[0] == a[7] and len(set(a.tolist())) == 7
    assert len(near_dedup.shingles(b"a b")) == 1 and len(near_dedup.shingles(b"")) == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)]
    links += [(500, 500), (None, 3), (3, None)] + links[:5]
    df = spark.createDataFrame(links, "a int, b int")
    got = {r.node: r.root for r in components.components(df).collect()}
    root = {x: x for p in links for x in p if x is not None}
    for _ in range(100):
        for a, b in links:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components.components(df.where("false")).collect() == []


def test_pipeline(spark):
    """Each stage on its own input; what the deduplicating stages keep is what brute force keeps."""
    docs = table(spark, MEDIUM, "documents")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, MEDIUM).cache()
    assert told.columns == docs.columns
    assert told.count() >= 0.99 * docs.count()  # the given texts are clean in this respect
    unique = stages["exact_dedup"](spark, told, MEDIUM).cache()
    best = defaultdict(int)
    for r in told.collect():
        best[r.text] = max(best[r.text], r.doc_id)
    assert {(r.doc_id, r.text) for r in unique.collect()} == {(i, t) for t, i in best.items()}
    near = stages["near_dedup"](spark, unique, MEDIUM).cache()
    kept = [r.doc_id for r in near.collect()]
    sample = [(r.doc_id, r.text) for r in unique.collect()]
    assert sorted(kept) == sorted(min(c) for c in brute_force_classes(sample))
    mixed = stages["mixing"](spark, near, MEDIUM)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= set(kept)
    assert stages["byte_bpe"](spark, near.limit(3), MEDIUM).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def odd_documents(spark):
    """Null and repeated ids, null and empty texts, copies and near copies among them, in the columns of documents."""
    rng = random.Random(8)
    long = [words(rng, 80) for _ in range(6)]
    text = [" ".join(w) for w in long]
    near = [" ".join(w[:-1] + ["changed"]) for w in long]
    rows = [
        (1, text[0]), (1, text[1]), (None, text[1]),          # two texts under one id; the copy without id goes
        (None, text[2]), (None, text[2]), (None, near[2]),    # a group without ids keeps one row
        (5, text[3]), (5, text[3]), (4, text[3]),             # equal in id and text: one stays, under the largest id
        (6, text[4]), (6, near[5]), (7, text[5]),             # a rejected text under the id of a kept one
        (8, None), (9, ""), (None, ""), (None, None),
    ]
    columns = table(spark, SMALL, "documents").schema
    found = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return rows, text, near, found.select(*[F.col(f.name) if f.name in ("doc_id", "text") else F.lit(None).cast(f.dataType).alias(f.name) for f in columns])


def test_pipeline_stages_on_odd_documents(spark):
    _, text, near, docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["exact_dedup"](spark, docs, SMALL).cache()
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    got = sorted([(r.doc_id, r.text) for r in unique.collect()], key=rank)
    expected = [(1, text[0]), (1, text[1]), (None, text[2]), (None, near[2]), (5, text[3]), (6, text[4]), (6, near[5]), (7, text[5]), (9, "")]
    assert unique.columns == docs.columns and got == sorted(expected, key=rank)
    near_kept = stages["near_dedup"](spark, unique, SMALL).cache()
    got = [(r.doc_id, r.text) for r in near_kept.collect()]
    assert near_kept.columns == docs.columns
    # the near copy under id 6 goes, the other text of that id stays; of the two without ids one stays
    assert sorted(r for r in got if r[0] is not None) == sorted(
        [(1, text[0]), (1, text[1]), (5, text[3]), (6, text[4]), (7, text[5]), (9, "")])
    assert [t for i, t in got if i is None] in ([text[2]], [near[2]])
    for name in ("exact_dedup", "near_dedup"):
        assert stages[name](spark, docs.limit(0), SMALL).count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0
