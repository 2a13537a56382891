"""Exact join of shingle sets by Jaccard similarity: universe partition and pigeonhole.

Sets of x and y shingles reach a Jaccard similarity of 0.8 only if at most (x + y) / 9 shingles are in one of them
alone. The universe of shingles is hashed into segments, as many as the sizes of a zone need. A shingle that only one
set has spoils one segment, so among enough segments of a set one is equal in both (an *exact* segment yields a gain of
one) or differs by one shingle at most (a *one-deletion* segment of two shingles or more yields a gain of two). A set
takes segments in the common order, leaving out empty ones, until their gain exceeds the differences that are allowed.
What it takes are its keys: a hash of the segment's shingles and, for one-deletion segments, of all but one of them.
Frequent shingles have segments of their own at the end of the order, so passages that many documents share are seldom
keys. Which kind of segments a zone has, and how many, is chosen by the cost of keys and of chance meetings, estimated
on a bounded sample; sample and choice steer the cost alone, never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raretide.llm.common import mix, small_batches, stage, texts
from raretide.llm.components import components
from raretide.llm.near_dedup import BITS, ends, normalised, shingles, sketch

# A link needs 100 * intersection >= 80 * union.
NEEDS, OF = 80, 100
# Bytes of a digest that stands for a set.
DIGEST = 12
# Zone k has the sets of 2**k to 2**(k + 1) - 1 shingles and larger ones that may be linked with those.
FIRST_ZONE = 2
# Kinds of segments: (one deletion allowed, segments per shingle of the smallest set of the zone).
ALLOCATIONS = ((False, 0.6), (False, 0.75), (False, 1.0), (True, 0.34), (True, 0.2))
# Sets of the sample, its frequent shingles at most, and in how many sets of the sample those are.
SAMPLE, FREQUENT, OFTEN = 8192, 1 << 16, 4
# What a candidate pair costs more than a key.
PAIR_COST = 4
# Keys of a shard, about; keys that a task holds; times that a key is in those to be dealt over all shards.
SHARD_KEYS, HELD_KEYS, HOT = 1_000_000, 400_000, 256
# Texts that share a key: up to FEW all pairs are listed at once; BLOCK is the size of a cell for the others.
FEW, BLOCK = 8, 1024
# Of the keys that a text shares with many, the first few; they tell in which of its cells a pair is compared.
FIRST_KEYS = 16
_U = np.uint64


def most_apart(x: int, y: int) -> int:
    """Shingles that only one of two linked sets of these sizes can have."""
    return (OF - NEEDS) * (x + y) // (OF + NEEDS)


def text_shingles(text: str) -> np.ndarray:
    """Hashes of the distinct five-word shingles in increasing order; only A-Z are lower-cased."""
    return np.unique(shingles(normalised(text).lower()))


def set_digest(distinct: np.ndarray) -> bytes | None:
    return hashlib.sha256(distinct.tobytes()).digest()[:DIGEST] if len(distinct) else None


def memberships(size: int):
    """(zone, differences allowed) of a set: its own zone, and the one below if smaller sets there may be linked with it."""
    if size < 1 << FIRST_ZONE:
        return  # equal sets only
    zone = size.bit_length() - 1
    yield zone, most_apart(size, size * OF // NEEDS)
    below = (1 << zone) - 1
    if zone > FIRST_ZONE and size * NEEDS <= below * OF:
        yield zone - 1, most_apart(size, below)


def set_keys(sets: list[np.ndarray], frequent: np.ndarray, plan: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, key) of all keys. ``plan`` has the allocation of each zone (that of index 0 where it has none)."""
    member = [(k, zone, allowed, *ALLOCATIONS[plan.get(zone, 0)]) for k, s in enumerate(sets) for zone, allowed in memberships(len(s))]
    if not member:
        return np.empty(0, np.int64), np.empty(0, _U)
    sizes = np.array([len(sets[m[0]]) for m in member])
    token = np.concatenate([sets[m[0]] for m in member])
    zone, allowed, loose = (np.array([m[i] for m in member]) for i in (1, 2, 3))
    segments = np.maximum(1, np.ceil(np.array([m[4] for m in member]) * 2.0**zone)).astype(np.int64)
    owner = np.repeat(np.arange(len(member)), sizes)
    place = np.searchsorted(frequent, token)
    often = frequent[np.minimum(place, len(frequent) - 1)] == token if len(frequent) else np.zeros(len(token), bool)
    spread = mix(token ^ (zone[owner].astype(_U) * _U(0x9E3779B97F4A7C15)))
    segment = (spread % segments[owner].astype(_U)).astype(np.int64) + often * segments[owner]
    by = np.argsort((owner << 34) + segment, kind="stable")
    owner, segment, spread = owner[by], segment[by], spread[by]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])]))
    count = np.diff(np.append(first, len(owner)))
    of = owner[first]
    gain = np.where(loose[of] & (count > 1), 2, 1)
    so_far = np.cumsum(gain) - gain
    so_far -= so_far[np.searchsorted(of, np.arange(len(member)))][of]
    taken = so_far <= allowed[of]
    label = mix(zone[of].astype(_U) * _U(0xD6E8FEB86659FD93) + segment[first].astype(_U))
    total = np.add.reduceat(spread, first)
    keys, owners = [mix((total ^ label)[taken])], [of[taken]]
    rows = np.repeat(taken & loose[of] & (count > 1), count)  # all but one of a segment's shingles
    group = np.repeat(np.arange(len(first)), count)[rows]
    keys.append(mix((total[group] - spread[rows]) ^ label[group]))
    owners.append(of[group])
    # Sets whose segments do not yield enough meet each other by the shingles that one of two linked sets must share.
    short = np.bincount(of, gain, len(member)) <= allowed
    for m in np.flatnonzero(short).tolist():
        distinct, z = sets[member[m][0]], member[m][1]
        where = np.searchsorted(frequent, distinct)
        last = frequent[np.minimum(where, len(frequent) - 1)] == distinct if len(frequent) else np.zeros(len(distinct), bool)
        chosen = distinct[np.lexsort((distinct, last))][: len(distinct) - -(-NEEDS * len(distinct) // OF) + 1]
        keys.append(mix(chosen ^ _U((z + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)))
        owners.append(np.full(len(chosen), m))
    return np.array([m[0] for m in member])[np.concatenate(owners)], np.concatenate(keys)


def set_table(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, h, node, size, bits): ``node`` is a digest of the set (null without words), ``h`` a hash of the text."""

    def run(batches):
        for batch in small_batches(batches):
            sets = [text_shingles(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array([set_digest(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())],
                ["id", "h", "node", "size", "bits"])

    return named(docs, id_column, text_column).mapInArrow(run, "id bigint, h bigint, node binary, size bigint, bits binary")


def named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("h"), F.col(text_column).alias("text"))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(text) of one row for each of ``chosen`` (rep, rep_h), or of rows with the same id and text."""
    return docs.join(chosen, docs.id.eqNullSafe(chosen.rep) & (docs.h == chosen.rep_h), "left_semi").select("text")


def frequent_shingles(sample: DataFrame) -> np.ndarray:
    """Shingles of at least OFTEN texts of the sample, the FREQUENT most frequent ones at most."""

    def run(batches):
        for batch in small_batches(batches):
            sets = [text_shingles(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["token"])

    counts = sample.mapInArrow(run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.sort(np.array([r.token for r in rows], np.int64).view(_U))


def allocate(sample: DataFrame, frequent: np.ndarray, sets: int, sampled: int) -> dict[int, int]:
    """The cheapest allocation of each zone: keys of the corpus and PAIR_COST for each two sets that share one, from the sample."""

    def run(batches):
        for batch in small_batches(batches):
            distinct = [text_shingles(t) for t in texts(batch, "text")]
            zone = np.array([len(s).bit_length() - 1 for s in distinct])
            for k in range(len(ALLOCATIONS)):
                owner, key = set_keys(distinct, frequent, dict.fromkeys(range(64), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(zone[owner], pa.int32()), pa.array(np.full(len(key), k), pa.int32()), pa.array(key.view(np.int64), pa.int64())], ["zone", "k", "key"])

    keys = sample.mapInArrow(run, "zone int, k int, key bigint").groupBy("zone", "k", "key").agg(F.count(F.lit(1)).alias("n"))
    costs = keys.groupBy("zone", "k").agg(F.sum("n").alias("keys"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()
    scale, best = sets / max(1, sampled), {}
    for r in costs:
        cost = r["keys"] * scale + PAIR_COST * r["pairs"] * scale * scale
        best[r.zone] = min(best.get(r.zone, (np.inf, 0)), (cost, r.k))
    return {zone: k for zone, (_, k) in best.items()}


def key_blobs(docs: DataFrame, frequent: np.ndarray, plan: dict[int, int], shards: int) -> DataFrame:
    """(shard, hot, keys, nodes): packed keys and digests. A key that many texts of one task share is hot: its texts go
    to shards by their own digest, and the key's shard is told by an entry without a digest."""

    def packed(sets, nodes):
        owner, key = set_keys(sets, frequent, plan)
        pair = np.unique(np.rec.fromarrays([key, owner])) if len(key) else np.rec.fromarrays([key, owner])
        key, owner = pair["f0"], pair["f1"]
        digests = np.array(nodes, f"V{DIGEST}")[owner] if len(key) else np.empty(0, f"V{DIGEST}")
        shard, short = (key % _U(shards)).astype(np.int64), (key >> _U(32)).astype(np.uint32)
        value, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        hot = (times > HOT)[inverse] if len(key) else np.empty(0, bool)
        loud = value[times > HOT]
        runs = (shard[hot] << 32) | short[hot].astype(np.int64)
        by_node = (mix(owner[hot].astype(_U) + key[hot]) % _U(shards)).astype(np.int64)
        home = np.concatenate([shard[~hot], (loud % _U(shards)).astype(np.int64)])
        keys = np.concatenate([short[~hot], (loud >> _U(32)).astype(np.uint32)])
        ids = np.concatenate([digests[~hot], np.zeros(len(loud), f"V{DIGEST}")])
        for is_hot, at, k, d in ((False, home, keys, ids), (True, by_node, runs, digests[hot])):
            order = np.argsort(at, kind="stable")
            at, k, d = at[order], k[order], d[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
            bounds = [*starts, len(at)]
            rows = [(int(at[a]), k[a:b].tobytes(), d[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([is_hot] * len(rows)), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["shard", "hot", "keys", "nodes"])

    def run(batches):
        sets, nodes, held = [], {}, 0
        for batch in small_batches(batches):
            for text in texts(batch, "text"):
                s = text_shingles(text)
                node = set_digest(s)
                if len(s) < 1 << FIRST_ZONE or node in nodes:
                    continue
                nodes[node] = None
                sets.append(s)
                held += len(s)
                if held > HELD_KEYS:
                    yield from packed(sets, list(nodes))
                    sets, nodes, held = [], {}, 0
        yield from packed(sets, list(nodes))

    return docs.select("text").mapInArrow(run, "shard int, hot boolean, keys binary, nodes binary")


def shared_keys(blobs: DataFrame, shards: int) -> DataFrame:
    """(run, a, b): pairs of texts that share a key with few others (no ``run``), and texts ``a`` that share the key
    ``run`` with more (no ``b``)."""

    def run(table: pa.Table) -> pa.Table:
        hot = table["hot"].to_numpy()
        join = lambda name, mask, kind: np.frombuffer(b"".join(table[name].filter(pa.array(mask)).to_pylist()), kind)
        shard = table["shard"][0].as_py()
        key, node = join("keys", ~hot, np.uint32), join("nodes", ~hot, f"V{DIGEST}")
        raw = node.view(np.uint8).reshape(-1, DIGEST)
        words = raw.view(">u4").astype(np.uint64).reshape(-1, 3)
        order = np.lexsort((words[:, 2], words[:, 1], words[:, 0], key))
        key, node, words = key[order], node[order], words[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (words[1:] != words[:-1]).any(axis=1)]) if len(key) else np.empty(0, bool)
        key, node, words = key[fresh], node[fresh], words[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        told = ~words[first].any(axis=1)  # the digest of zeros says that the key is hot
        many = told | (count > FEW)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in range(2, FEW + 1):
            starts = first[~many & (count == n)]
            i, j = np.triu_indices(n, 1)
            a.append((starts[:, None] + i).ravel())
            b.append((starts[:, None] + j).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):  # a pair once in each shard
            code = np.unique(words, axis=0, return_inverse=True)[1].ravel().astype(np.int64)
            keep = np.unique(code[a] * len(code) + code[b], return_index=True)[1]
            a, b = a[keep], b[keep]
        rows = np.repeat(many, count) & words.any(axis=1)
        runs = np.concatenate([(np.int64(shard) << 32) | key[rows].astype(np.int64), join("keys", hot, np.int64)])
        members = [x.tobytes() for x in node[rows]] + [x.tobytes() for x in join("nodes", hot, f"V{DIGEST}")]
        return pa.table({
            "run": pa.array([None] * len(a) + runs.tolist(), pa.int64()),
            "a": pa.array([x.tobytes() for x in node[a]] + members, pa.binary()),
            "b": pa.array([x.tobytes() for x in node[b]] + [None] * len(members), pa.binary())})

    return blobs.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "run bigint, a binary, b binary")


def _may_be_linked(x, y, bits_x, bits_y):
    """Whether sizes and parity sketches leave a link possible (see ``sketch``: differing bits are differing shingles)."""
    most = (OF - NEEDS) * (x + y) // (OF + NEEDS)
    return (np.abs(x - y) <= most) & (np.bitwise_count(bits_x ^ bits_y).sum(axis=-1) <= most)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""

    def run(batches):
        for batch in small_batches(batches, 4096):
            if batch.num_rows:
                x, y = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("size_a", "size_b"))
                s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), _U).reshape(-1, BITS // 64) for c in ("bits_a", "bits_b"))
                yield batch.select(["a", "b"]).filter(pa.array(_may_be_linked(x, y, s, t)))

    one, two = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    close = F.expr(f"abs(size_a - size_b) * {OF + NEEDS} <= (size_a + size_b) * {OF - NEEDS}")
    return pairs.join(one, "a").join(two, "b").where(close).select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(run, "a binary, b binary")


def node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of ``wanted`` (node, rep, rep_h): sorted shingle hashes."""

    def run(batches):
        for batch in small_batches(batches):
            sets = [text_shingles(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    return texts_of(docs, wanted).mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are linked, by counting the intersection."""

    def run(batches):
        for batch in small_batches(batches):
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * both >= NEEDS * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def open_pairs(members: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that share a key of ``members`` (run, node), are still in different components (``root`` of
    ``marked``) and are not ruled out by sizes and sketches.

    A pair that shares several keys is left to the first one that is known to both, so it is listed about once. Runs of
    one component are left out. Others are dealt into slots: a component that fills a block has slots of its
    own. Two slots meet in a cell unless both hold one and the same component, so a component of any size that meets
    few strangers is moved once for each slot of strangers.
    """
    firsts = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("run")), 1, FIRST_KEYS).alias("firsts"))
    with_root = stage(members.join(firsts, "node").join(marked.select("node", "root", "size", "bits"), "node"), "run-members")
    groups = with_root.groupBy("run", "root").agg(F.count(F.lit(1)).alias("n"))
    runs = groups.groupBy("run").agg(F.sum("n").alias("run_n"), F.count(F.lit(1)).alias("run_roots")).where("run_roots > 1")
    groups = stage(groups.join(runs, "run"), "run-components")
    own = F.expr(f"case when run_n <= {BLOCK} then null when n > {BLOCK // 2} then root end")
    slots = F.expr(f"cast(ceil(case when run_n <= {BLOCK} then 1 when n > {BLOCK // 2} then n / {BLOCK} else run_n / {BLOCK} end) as int)")
    groups = groups.select("run", "root", own.alias("own"), slots.alias("slots"))
    # A slot's number: by component for slots of its own, by hash of the component for those that components share.
    dealt = with_root.join(groups, ["run", "root"]).select(
        "run", "node", "root", "size", "bits", "firsts", "own",
        F.expr("case when own is null then pmod(xxhash64(root), slots) else xxhash64(own, pmod(xxhash64(node), slots)) end").alias("slot"))
    numbered = groups.where("own is null").select("run", "own", F.expr("pmod(xxhash64(root), slots)").alias("slot")).union(
        groups.where("own is not null").select("run", "own", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("k")).select(
            "run", "own", F.expr("xxhash64(own, cast(k as bigint))").alias("slot"))).distinct()
    numbered = stage(numbered, "run-slots")
    one, two = (numbered.select("run", F.col("own").alias(f"own_{c}"), F.col("slot").alias(c)) for c in "ij")
    cells = one.join(two, "run").where("(i < j and not coalesce(own_i = own_j, false)) or (i = j and own_i is null)").select("run", "i", "j")
    sides = [dealt.join(cells.withColumn("slot", F.col(c)), ["run", "slot"]) for c in "ij"]
    rows = sides[0].union(sides[1].where("i <> j")).select("run", "i", "j", "slot", "node", "root", "size", "bits", "firsts")

    def run(batches):
        key, cell = None, []

        def close():
            left, right = [], []
            if len(cell) > 1:
                slot, node, root, size = (np.array([r[k] for r in cell], t) for k, t in ((0, np.int64), (1, f"V{DIGEST}"), (2, f"V{DIGEST}"), (3, np.int64)))
                number = np.unique(root.view(np.uint8).reshape(-1, DIGEST), axis=0, return_inverse=True)[1].ravel()
                bits = np.frombuffer(b"".join(r[4] for r in cell), _U).reshape(-1, BITS // 64)
                firsts = np.full((len(cell), FIRST_KEYS), key[0], np.int64)
                for k, r in enumerate(cell):
                    firsts[k, :len(r[5])] = np.minimum(r[5], key[0])  # only keys before this one matter
                for k in range(1, len(cell)):
                    apart = number[:k] != number[k]
                    if key[1] != key[2]:
                        apart &= slot[:k] != slot[k]
                    at = np.flatnonzero(apart & (np.abs(size[:k] - size[k]) * (OF + NEEDS) <= (size[:k] + size[k]) * (OF - NEEDS)))
                    at = at[_may_be_linked(size[at], size[k], bits[at], bits[k])]
                    earlier = firsts[k][firsts[k] < key[0]]
                    for m in at[~(firsts[at][:, :, None] == earlier).any(axis=(1, 2))].tolist():
                        a, b = sorted((node[m].tobytes(), node[k].tobytes()))
                        left.append(a)
                        right.append(b)
            return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("run", "i", "j", "slot", "node", "root", "size", "bits", "firsts")]
            for r, i, j, *row in zip(*columns, strict=True):
                if (r, i, j) != key:
                    yield close()
                    key, cell = (r, i, j), []
                cell.append(row)
        yield close()

    met = rows.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(run, "a binary, b binary")
    return met.distinct()


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the least id reachable by links (its own included).

    Words are runs of other than space and U+0009 to U+000D, with A-Z lower-cased; the set of a document is that of its
    five-word shingles, of all its words where it has fewer. Two documents with words are linked if the Jaccard
    similarity of their sets is at least 0.8. All links count; none is lost by the candidate search.

    A null text counts as the empty one; a document without words is linked with nothing and is its own component.
    Documents of equal sets are one text of the join. A document with a null id takes part, but gives no component_id;
    a component of such rows alone has a null one. Rows with the same id are told apart by their texts. Other columns
    are not read; an empty table gives an empty result.
    """
    source = named(docs, id_column, text_column)
    table = stage(set_table(docs, id_column, text_column), "sets")
    grouped = table.where("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.first(F.struct("size", "bits")).alias("one"))
    nodes = stage(grouped.select("node", "least", F.col("rep.id").alias("rep"), F.col("rep.h").alias("rep_h"), "one.*"), "set-nodes")
    n, total = nodes.where(F.col("size") >= 1 << FIRST_ZONE).agg(F.count(F.lit(1)), F.sum("size")).first()
    parts = 1 << 20
    of_sample = nodes.where(F.col("size") >= 1 << FIRST_ZONE).where(F.expr(f"pmod(xxhash64(node), {parts})") < (parts * SAMPLE) // max(1, n))
    chosen = of_sample.orderBy(F.xxhash64("node"), "node").limit(2 * SAMPLE).select("rep", "rep_h")
    sample = stage(texts_of(source, F.broadcast(chosen)), "set-sample")
    frequent = frequent_shingles(sample)
    plan = allocate(sample, frequent, n, min(n, SAMPLE))
    shards = max(1, -(-(total or 0) // (2 * SHARD_KEYS)))
    runs = stage(shared_keys(key_blobs(source, frequent, plan, shards), shards), "shared-keys")

    members = runs.where("b is null").select("run", F.col("a").alias("node")).distinct()
    heads = stage(members.groupBy("run").agg(F.min("node").alias("a")), "run-heads")
    members = stage(members, "run-nodes")
    stars = members.join(heads, "run").where("node <> a").select("a", F.col("node").alias("b"))
    first = stage(runs.where("b is not null").select("a", "b").union(stars).distinct(), "pairs")
    tried = stage(possible(first, nodes), "pairs")
    keys = nodes.select("node", "rep", "rep_h")
    wanted = stage(keys.join(ends(tried), "node", "left_semi"), "wanted")
    sets = stage(node_sets(source, wanted), "shingle-sets")
    links = stage(linked(tried, sets), "links")
    roots = stage(components(links), "roots")
    marked = nodes.select("node", "size", "bits").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stage(open_pairs(members, marked).join(first, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        lacking = stage(keys.join(ends(more).join(sets.select("node"), "node", "left_anti"), "node", "left_semi"), "wanted")
        if not lacking.isEmpty():
            sets = sets.union(stage(node_sets(source, lacking), "shingle-sets"))
        roots = stage(components(links.union(stage(linked(more, sets), "links"))), "roots")
    classes = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    by_root = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = stage(classes.join(by_root, "root").select("node", "component_id"), "set-components")
    return table.select("id", "node", "size").join(by_node, "node", "left").select(
        F.col("id").alias(id_column), F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
