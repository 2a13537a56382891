"""The exact set join against brute force, and its keys against the pigeonhole's promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM
from raretide.llm import set_join
from raretide.llm.common import table


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n)]


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\r", " ").replace("\x0b", " ").split(" ")
    w = [x for part in w for x in part.replace("\t", " ").replace("\n", " ").replace("\x0c", " ").split(" ") if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        mine = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        out.append((doc, len(sets[i]), min((m for m in mine if m is not None), default=None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "a b c d e"), (7, "A b c d e f"), (None, "one two"), (None, "lonely row"), (None, None)]
    family = words(rng, 160)
    for i in range(70):  # a chain of edits: neighbours are linked, ends are not
        rows.append((100 + i, " ".join(family)))
        family = list(family)
        for _ in range(rng.choice([1, 2, 3, 6])):
            family[rng.randrange(len(family))] = rng.choice("qrs") + str(rng.randrange(10**6))
    passage = words(rng, 60)
    rows += [(200 + i, " ".join(words(rng, 100) + passage)) for i in range(60)]  # a passage that many share
    rows += [(None, " ".join(words(rng, 90) + passage)) for i in range(20)]
    for i in range(60):  # short texts, many at the very limit
        w = words(rng, rng.randrange(6, 20))
        rows += [(300 + 2 * i, " ".join(w)), (301 + 2 * i, " ".join(w + words(rng, rng.randrange(3))))]
    long = words(rng, 20_000)
    rows += [(600, " ".join(long)), (601, " ".join(long[:-900])), (602, " ".join(["same"] * 3000)), (603, " ".join(["same"] * 9))]
    rows += [(700 + i, rows[30][1]) for i in range(20)] + [(800, "x y"), (800, "z u v w x y z")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    return df.withColumns({c: F.lit("x") for c in ("node", "id", "h", "size", "bits", "root", "component_id", "run", "a", "b")})


@pytest.mark.parametrize("few, block, hot, often", [(8, 1024, 256, 4), (2, 8, 3, 10**9), (3, 16, 1, 3)])
def test_components_match_brute_force(docs, rows, monkeypatch, few, block, hot, often):
    """Small limits send nearly everything through hot keys, shared runs and cells."""
    for name, value in (("FEW", few), ("BLOCK", block), ("HOT", hot), ("OFTEN", often), ("SHARD_KEYS", 5000), ("HELD_KEYS", 4000)):
        monkeypatch.setattr(set_join, name, value)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in set_join.jaccard_components(docs).collect()), key=str)
    assert got == components(rows)


def test_empty_table(docs):
    assert set_join.jaccard_components(docs.where("false")).collect() == []


def test_given_documents(spark):
    docs = table(spark, MEDIUM, "documents").where("doc_id < 300")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in set_join.jaccard_components(docs).collect()), key=str)
    assert got == components(rows)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    tried = 0
    for _ in range(600):
        n = int(rng.choice([4, 5, 6, 7, 8, 9, 15, 16, 33, 64, 127, 128, 129, 300, 600]))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        more = rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate([base[int(rng.integers(0, n // 5 + 1)):], more]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        tried += 1
        frequent = np.sort(base[rng.random(n) < rng.choice([0, 0.3, 0.9])])
        for k in range(len(set_join.ALLOCATIONS)):
            owner, key = set_join.set_keys([a, b], frequent, dict.fromkeys(range(64), k))
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())
    assert tried > 200


def test_one_large_component_and_strangers_make_few_cell_rows(spark, monkeypatch):
    """A run of one component and some strangers: rows moved stay in proportion, all pairs with strangers are met."""
    monkeypatch.setattr(set_join, "BLOCK", 16)
    node = lambda i: i.to_bytes(set_join.DIGEST, "big")
    big, strangers = 400, 5
    rows = [(7, node(i + 1)) for i in range(big + strangers)]
    marks = [(node(i + 1), node(1) if i < big else node(i + 1), 100, bytes(set_join.BITS // 8)) for i in range(big + strangers)]
    members = spark.createDataFrame(rows, "run bigint, node binary")
    marked = spark.createDataFrame(marks, "node binary, root binary, size bigint, bits binary")
    moved = []
    original = type(members).repartition

    def counted(self, *by):
        if by == ("run", "i", "j"):
            moved.append(self.count())
        return original(self, *by)

    monkeypatch.setattr(type(members), "repartition", counted)
    pairs = {(bytes(r.a), bytes(r.b)) for r in set_join.open_pairs(members, marked).collect()}
    assert pairs == {tuple(sorted((node(i + 1), node(j + 1)))) for i in range(big + strangers) for j in range(big, big + strangers) if i < j}
    # The strangers are spread over at most five slots, each of which meets the component once.
    assert moved[0] <= strangers * (big + 26 * strangers) + strangers**2
