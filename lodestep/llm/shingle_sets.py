"""Near copies by the exact Jaccard similarity of their sets of five-word shingles: fingerprints and BK-trees inside shards.

A node is a different text (by its 64-bit hash), with the set of the 64-bit hashes of its shingles. Texts that are 0.8 alike
differ in 9.7 of 64 bits of such a set's fingerprint on average, so no few blocks of bits bring them together. A node's shards
are instead 24 bands of five minima of its set: two texts that are 0.8 alike share one with probability
1 - (1 - 0.8 ** 5) ** 24, 0.99993; more alike ones miss still less.

First every node of a shard is compared with one leader of it, which joins a large group of near copies without its pairs.
Shards whose nodes are then of one component are done. In the others a BK-tree over the fingerprints gives, for each node,
the nodes of other components within ``RADIUS`` bits (five deviations above the mean at 0.8); counts of hashes by their low
bits bound how many two sets can share, which leaves out more. What remains, each pair from one of its shards, is compared on the sets. Shards above ``BLOCK``
nodes are cut into blocks, and each pair of blocks has a tree of its own, in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestep.llm.linking import BKTree, components
from lodestep.session import ship, stash

WIDTH = 5
ROWS, BANDS = 5, 24
RADIUS = 24
BLOCK = 2048
#: Rounds of leaders at most, while a shard of several components has more than WHOLE nodes.
ROUNDS, WHOLE = 4, 64
BUCKETS = 128
#: Pairs that a task holds at once.
BATCH = 50_000
_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, (2, ROWS * BANDS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def node(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a shorter text is one shingle. Words are those of simhash."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    found = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, found, repeat(42)), np.uint64, len(words) - width + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    mins = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):  # bounds the table of a very long text
        np.minimum(mins, ((hashes[None, at : at + 4096] ^ _SEEDS[0]) * _SEEDS[1]).min(1), out=mins)
    return [xxh64_intdigest(mins[ROWS * k : ROWS * (k + 1)].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, node and keys of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([band_keys(shingles(t.as_py(), width)) for t in b.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], ["doc_id", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long"), node().alias("node"), "text").mapInArrow(run, "doc_id long, node long, keys array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """node, n and words (its hashes as bytes) for rows of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, got), pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], ["node", "n", "words"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, words binary")


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def compare(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the different pairs (a, b) whose sets are alike."""
    one, two = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("words").alias(f"w_{k}")) for k in "ab")
    full = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    return full.select("a", "b", "w_a", "w_b").mapInArrow(_alike(similarity), "a long, b long")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, fingerprint and counts (hashes by their low bits, as bytes; empty where a count is beyond 16 bits) of each set."""
    for b in batches:
        fps, counts = [], []
        for v in b.column(2):
            x = np.frombuffer(v.as_buffer(), np.uint64)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(x), 1 << 16):
                ones += np.unpackbits(x[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            fps.append(int(np.packbits(ones * 2 > len(x), bitorder="little").view(np.int64)[0]))
            c = np.bincount((x % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            counts.append(c.astype(np.uint16).tobytes() if c.max(initial=0) < 1 << 16 else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(counts, pa.binary())], ["node", "n", "fp", "counts"])


def _search(similarity: float, radius: int):
    """Pairs of a shard's nodes that may be alike and are of different components. Rows come sorted by shard (key, i, j) and side."""

    def pairs(key: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """rows: side, node, root, n, fp, counts, keys; with two sides only pairs across them count."""
        n = np.array([r[3] for r in rows], np.int64)
        counts = np.zeros((len(rows), BUCKETS), np.uint16)
        for k, r in enumerate(rows):
            counts[k] = np.frombuffer(r[5], np.uint16) if r[5] else np.iinfo(np.uint16).max
        root = np.array([r[2] for r in rows], np.int64)
        keys = [frozenset(r[6]) for r in rows]
        both = rows[0][0] != rows[-1][0]
        tree = BKTree(radius)
        for k, r in enumerate(rows):
            fp = r[4] & 0xFFFFFFFFFFFFFFFF
            near = tree.near(fp) if not both or r[0] != rows[0][0] else []
            if not both or r[0] == rows[0][0]:
                tree.insert(fp)
            if not near:
                continue
            at = np.array(near)
            at = at[root[at] != root[k]]
            least, most = np.minimum(n[at], n[k]), np.maximum(n[at], n[k])
            shared = np.minimum(np.minimum(counts[at], counts[k]).sum(1, dtype=np.int64), least)
            for j in at[shared >= similarity * (least + most - shared) - 1e-9]:
                if key == min(keys[k] & keys[j]):  # else another shard has the pair
                    yield (min(r[1], rows[j][1]), max(r[1], rows[j][1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            found = pairs(key[0], kept) if len(kept) > 1 else iter(())
            while some := list(islice(found, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in some], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for shard, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if shard != key:
                    yield from flush()
                    kept, key = [], shard
                kept.append(row)
        yield from flush()

    return run


def _open(members: DataFrame, roots: DataFrame | None, small) -> DataFrame:
    """key, node, root and size of the shards (keys) whose nodes are of several components."""
    if roots is not None:
        members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        members = members.withColumn("root", F.col("node"))
    several = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
    return stash(members.join(small(stash(several, "open-shards")), "key").select("key", "node", "root", "size"), "open-members")


def near_roots(docs: DataFrame, signed: DataFrame, similarity: float, width: int = WIDTH, whole: int = WHOLE, block: int = BLOCK, broadcast_rows: int = 1_000_000) -> DataFrame:
    """node and root (least node of its component) of the nodes that are alike to another; signed: the signatures of docs."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    keyed = signed.select("node", F.explode("keys").alias("key"))
    shared = small(stash(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "shared-bands"))
    members = stash(keyed.join(shared, "key", "left_semi").distinct(), "band-members")
    # one row of docs for each node, but for rows that repeat an id
    least = signed.groupBy("node").agg(F.min("doc_id").alias("least")).join(members.select("node").distinct(), "node", "left_semi")
    least = small(stash(least.withColumnRenamed("node", "own"), "nodes"))
    rows = docs.select(node().alias("node"), F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.join(least, (rows["node"] == least["own"]) & rows["id"].eqNullSafe(least["least"]), "left_semi")
    sets = stash(_sets(rows, width).dropDuplicates(["node"]), "shingle-sets")

    links, roots = None, None

    def linked(pairs: DataFrame) -> DataFrame:
        nonlocal links
        found = stash(compare(stash(pairs.distinct(), "pairs"), sets, similarity), "links")
        links = found if links is None else links.unionByName(found)
        return stash(components(links), "roots")

    at = _open(members, None, small)
    for k in range(ROUNDS):
        # the leader depends on the node alone, so that shards of the same nodes have the same one
        heads = at.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("head"), F.col("root").alias("head_root")), F.xxhash64("node", F.lit(k))).alias("h")).select("key", "h.*")
        stars = at.join(small(stash(heads, "leaders")), "key").where("root <> head_root")
        roots = linked(stars.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")))
        at = _open(members, roots, small)
        if at.where(F.col("size") > whole).isEmpty():
            break
    own = at.groupBy("node").agg(F.collect_set("key").alias("keys"))
    marks = sets.join(own.select("node"), "node", "left_semi").select("node", "n", "words").mapInArrow(_marks, "node long, n long, fp long, counts binary").join(own, "node")
    parts = F.ceil(F.col("size") / block).cast("int")
    side = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = at.select("key", "node", "root", side.alias("side"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "root")
    trees = dealt.join(marks, "node").select("key", "i", "j", "side", "node", "root", "n", "fp", "counts", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    return linked(trees.mapInArrow(_search(similarity, RADIUS), "a long, b long"))
