"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Every five-word shingle of a text is an element with a weight that grows with its number of occurrences. It sends
out arrivals of a Poisson process whose rate is the weight; each arrival goes to a random register, and a register
keeps the element of its first arrival. Elements stop once their next arrival is later than everything that the
registers hold. The share of equal registers of two texts estimates their probability Jaccard similarity.

Links are by the Jaccard similarity of the shingle sets. As repeats lower the other similarity, a text with repeated
shingles has the bands of a second signature too, with weight 1 for all. Estimates only choose the pairs that are
verified first; what rules out others is a bound on the sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raretide.llm.common import mix, small_batches, stage, texts
from raretide.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
# Pairs whose estimate is below this are no links of the spanning forest; they are left to the second pass.
LEAST_ESTIMATE = 0.7
# Members of a bucket compared with each other at once. Larger buckets are divided: by further registers for the
# spanning forest, which need not be whole, and into cells of two slots each for the pairs that it leaves.
BLOCK = 1024
# Of a full block, members that also take part in the next one's spanning forest.
CARRIED = 64
# Bits of a text's parity sketch: each distinct shingle turns one of them over.
BITS = 2048
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to exponent ``n``."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def normalised(text: str) -> bytes:
    """The words of the text in UTF-8, joined by one space."""
    return b" ".join(text.encode("utf-8", "replace").split())


def shingles(words: bytes) -> np.ndarray:
    """64-bit hashes of all shingles of a normalised text, in order; one of all its words where it has fewer than five."""
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(words, np.uint8)
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(data)]])
    if len(starts) >= WORDS:
        starts, ends = starts[: len(starts) - WORDS + 1], ends[WORDS - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, registers) of 32 bits each. A text without shingles has zeros in all registers."""
    out = np.zeros((len(sets), REGISTERS), np.uint32)
    parts = [np.unique(s, return_counts=True) for s in sets]
    sizes = [len(p[0]) for p in parts]
    if not sum(sizes):
        return out
    element = np.concatenate([p[0] for p in parts])
    rate = 1.0 + np.log(np.concatenate([p[1] for p in parts]))
    text = np.repeat(np.arange(len(sets)), sizes)
    first = np.full(len(sets) * REGISTERS, np.inf)
    holder = np.zeros(len(sets) * REGISTERS, np.uint32)
    arrival, k = np.zeros(len(element)), 0
    while len(element):
        draw = mix(element + np.uint64((2 * k + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        arrival -= np.log(uniform) / rate
        place = text * REGISTERS + (mix(draw ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, place, arrival)
        won = first[place] == arrival
        holder[place[won]] = (mix(element[won]) >> np.uint64(32)).astype(np.uint32)
        latest = first.reshape(len(sets), REGISTERS).max(axis=1)
        going = arrival < latest[text]  # a later arrival of the others changes nothing
        element, rate, text, arrival = element[going], rate[going], text[going], arrival[going]
        k += 1
    return holder.reshape(len(sets), REGISTERS)


def sketch(distinct: np.ndarray) -> bytes:
    """Parities of the distinct shingles by the low bits of their hashes. Two sketches differ in at most as many bits
    as there are shingles that only one of the texts has."""
    return np.packbits(np.bincount((distinct % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def signature_table(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, node, sig, plain, size, bits): ``node`` is a 128-bit digest of the words, equal for texts with the same words.

    ``plain`` is the signature without weights, null where no shingle is repeated; ``size`` and ``bits`` are the number
    and the sketch of the distinct shingles.
    """

    def run(batches):
        for batch in small_batches(batches):
            words = [normalised(t) for t in texts(batch, "text")]
            lists = [shingles(w) for w in words]
            sets = [np.unique(x) for x in lists]
            repeats = [k for k, (x, y) in enumerate(zip(lists, sets, strict=True)) if len(y) < len(x)]
            plain: list[bytes | None] = [None] * len(sets)
            for k, sig in zip(repeats, signatures([sets[k] for k in repeats]), strict=True):
                plain[k] = sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([hashlib.sha256(w).digest()[:16] for w in words], pa.binary()),
                 pa.array([s.tobytes() for s in signatures(lists)], pa.binary()), pa.array(plain, pa.binary()),
                 pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())],
                ["id", "node", "sig", "plain", "size", "bits"])

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return named.mapInArrow(run, "id bigint, node binary, sig binary, plain binary, size int, bits binary")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, n): one row per text and bucket that holds other texts too, ``n`` in all.

    A text is in the buckets of the bands of both its signatures.
    """
    width = 4 * ROWS
    rows = nodes.select("node", "sig", "plain", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    own, other = [F.xxhash64("band", F.expr(f"substring({c}, band * {width} + 1, {width})")) for c in ("sig", "coalesce(plain, sig)")]
    rows = rows.select("node", "band", F.explode(F.array_distinct(F.array(own, other))).alias("bucket"))
    sizes = stage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    return rows.join(sizes, "bucket").select("bucket", "band", "node", "n")


def with_parts(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bucket rows with their signatures, ready to be grouped by (bucket, part).

    ``part`` divides buckets of more than a block by as many further registers as their size needs.
    """
    further = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
    part = F.expr(f"xxhash64(substring(concat(sig, sig), (band + 1) * {4 * ROWS} + 1, 4 * further))")
    return buckets.join(nodes, "node").withColumn("further", further).select(
        "bucket", F.when(F.col("further") > 0, part).otherwise(F.lit(0)).cast("long").alias("part"),
        "node", "sig")


def _similar_to(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).mean(axis=1)


def _tree(sigs: np.ndarray):
    """Links of a maximum spanning forest of the estimates that reach the least estimate (Prim's method)."""
    left = np.arange(1, len(sigs))
    best, link = _similar_to(sigs[0], sigs[1:]), np.zeros(len(left), np.int64)
    while len(left):
        k = int(best.argmax())
        node = int(left[k])
        if best[k] >= LEAST_ESTIMATE:
            yield int(link[k]), node
        left, best, link = np.delete(left, k), np.delete(best, k), np.delete(link, k)
        new = _similar_to(sigs[node], sigs[left])
        closer = new > best
        best, link = np.where(closer, new, best), np.where(closer, node, link)


def _pair_batch(out: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["a", "b"])


def forest_pairs(parts: DataFrame) -> DataFrame:
    """(a, b) to verify first. Rows of a bucket meet in order of (bucket, part); a task holds one block of one bucket at a time.

    Each block is linked by a spanning forest, which needs fewer pairs than members. What it misses is left to
    ``open_pairs``.
    """

    def run(batches):
        key, block = None, []
        out: list[list[bytes]] = [[], []]

        def close():
            if len(block) > 1:
                for i, j in _tree(np.frombuffer(b"".join(r[0] for r in block), np.uint32).reshape(-1, REGISTERS)):
                    a, b = sorted((block[i][1], block[j][1]))
                    out[0].append(a)
                    out[1].append(b)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "part", "sig", "node")]
            for bucket, part, *row in zip(*columns, strict=True):
                if (bucket, part) != key:
                    close()
                    key, block = (bucket, part), []
                elif len(block) >= BLOCK:
                    close()
                    block = block[:: BLOCK // CARRIED]
                block.append(row)
            if out[0]:
                yield _pair_batch(out)
                out[0].clear()
                out[1].clear()
        close()
        yield _pair_batch(out)

    dealt = parts.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _across(bits: np.ndarray, sizes: np.ndarray, roots: np.ndarray, slots: np.ndarray | None, similarity: float):
    """Pairs of different components, and of different slots if given, that may reach the similarity.

    Sets of x and y shingles with a Jaccard similarity of at least t have at most (x + y) (1 - t) / (1 + t) shingles
    that are not in both, and at least as many as their sketches differ in bits or they differ in size.
    """
    share = (1 - similarity) / (1 + similarity)
    for i in range(1, len(roots)):
        apart = roots[:i] != roots[i]
        if slots is not None:
            apart &= slots[:i] != slots[i]
        most = share * (sizes[:i] + sizes[i]) + 1e-6
        others = np.flatnonzero(apart & (np.abs(sizes[:i] - sizes[i]) <= most))
        for j in others[np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1) <= most[others]].tolist():
            yield j, i


def open_pairs(buckets: DataFrame, marked: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) to verify: all pairs of all buckets that are still in different components (``root`` of ``marked``) and
    that their sizes and sketches do not rule out.

    Buckets of one component are left out. The members of a bucket are dealt over as many slots as it has blocks, and
    each two slots meet in a cell of their own, so every pair of a bucket meets once, whatever the size of the bucket.
    """
    roots = buckets.join(marked.select("node", "root"), "node").groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    mixed = stage(roots.where("x <> y").select("bucket"), "open-buckets")
    rows = buckets.join(mixed, "bucket").join(marked.select("node", "root", "size", "bits"), "node")
    rows = rows.withColumn("slots", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("slot", F.expr("cast(pmod(xxhash64(node, bucket), slots) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    cells = rows.select("bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "node", "root", "size", "bits")

    def run(batches):
        key, cell = None, []
        out: list[list[bytes]] = [[], []]

        def close():
            names = {r[1]: k for k, r in enumerate(cell)}
            if len(names) > 1:
                bits = np.frombuffer(b"".join(r[4] for r in cell), np.uint64).reshape(-1, BITS // 64)
                sizes = np.array([r[3] for r in cell], np.int64)
                slots = np.array([r[0] for r in cell]) if key[1] < key[2] else None
                for k, m in _across(bits, sizes, np.array([names[r[1]] for r in cell]), slots, similarity):
                    a, b = sorted((cell[k][2], cell[m][2]))
                    out[0].append(a)
                    out[1].append(b)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "slot", "root", "node", "size", "bits")]
            for bucket, i, j, *row in zip(*columns, strict=True):
                if (bucket, i, j) != key:
                    close()
                    key, cell = (bucket, i, j), []
                cell.append(row)
            if out[0]:
                yield _pair_batch(out)
                out[0].clear()
                out[1].clear()
        close()
        yield _pair_batch(out)

    dealt = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """(node): the texts that occur in ``pairs``."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def shingle_sets(docs: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, set) of the texts of ``chosen`` (rep, wanted): sorted distinct shingle hashes. One text per node moves."""

    def run(batches):
        for batch in small_batches(batches):
            rows = [(n, w) for n, w in zip(batch.column("wanted").to_pylist(), (normalised(t) for t in texts(batch, "text")), strict=True)
                    if hashlib.sha256(w).digest()[:16] == n]  # another text of a repeated id is not the one
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in rows], pa.binary()), pa.array([np.unique(shingles(w)).tobytes() for _, w in rows], pa.binary())],
                ["node", "set"])

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    found = named.join(chosen, named.id.eqNullSafe(chosen.rep)).select("wanted", "text")
    return found.mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least ``similarity``."""

    def run(batches):
        for batch in small_batches(batches):
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    return first.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(
        run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id (least id of its class), class_size and kept (id = class_id).

    Classes are the connected components of verified links between different texts, together with all documents of
    the same words (white space aside). A null text counts as the empty one; texts without words form one class.
    Documents with a null id take part, but are neither a ``class_id`` nor kept; a class of such rows alone has a
    null class_id. Rows that repeat the least id are all kept. Other columns are not read; an empty table gives an
    empty result.

    Copies are merged before anything is compared. Within a bucket the first pass verifies a spanning forest, the
    second all pairs that the first left in different components, so a bucket of near copies never lists all pairs.
    """
    table = stage(signature_table(docs, id_column, text_column), "signatures")
    nodes = stage(table.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("sig", "plain", "size", "bits")).alias("one")).select(
        "node", "rep", "copies", "one.*"), "nodes")
    buckets = stage(shared_buckets(nodes), "buckets")
    tree = stage(forest_pairs(with_parts(buckets, nodes)), "pairs")
    named = nodes.select("node", "rep", F.col("node").alias("wanted"))
    chosen = named.join(ends(tree), "node", "left_semi").select("rep", "wanted")
    sets = stage(shingle_sets(docs, chosen.hint("shuffle_hash"), id_column, text_column), "shingle-sets")
    links = stage(verified(tree, sets, similarity), "near-links")
    roots = stage(components(links), "roots")
    marked = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stage(open_pairs(buckets, marked, similarity), "pairs")
    if not more.isEmpty():
        lacking = ends(more).join(sets.select("node"), "node", "left_anti")
        chosen = stage(named.join(lacking, "node", "left_semi").select("rep", "wanted"), "lacking-sets")
        if not chosen.isEmpty():  # texts that no forest pair has
            sets = sets.union(stage(shingle_sets(docs, chosen, id_column, text_column), "shingle-sets"))
        new = stage(verified(more, sets, similarity), "near-links")
        if not new.isEmpty():
            roots = stage(components(links.union(new)), "roots")
    classes = nodes.join(roots, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    totals = classes.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = classes.join(totals, "root").select("node", "class_id", "class_size")
    return table.select("id", "node").join(by_node, "node").select(
        F.col("id").alias(id_column), "class_id", F.col("class_size").cast("long").alias("class_size"),
        F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))
