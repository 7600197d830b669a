"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees.

A shard holds the distinct fingerprints that agree on a block of bits. Fingerprints within radius 2 agree on at least one
of three blocks, so every link lies in some shard. Each task builds one shard's BK-tree after the other (children keyed
by their Hamming distance to the parent) and follows only edges within the radius. The trees of a corpus grow with it, so
they stay in the tasks that build them instead of being broadcast. A shard with more than ``shard_limit`` fingerprints is
cut again by blocks of its other bits, two times at most; what is left then differs in 20 bits at most, which bounds it.
A shard returns a spanning forest, never all pairs; forests are joined by alternating large and small stars.

Nulls and empty texts have fingerprint zero and are linked like any other. Rows are kept as they are: repeated rows and
repeated ids give repeated results. A null doc_id is no candidate for component_id, which is null if no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestep.llm import shingle_sets
from lodestep.llm.linking import BKTree, components
from lodestep.session import fresh, ship, stash

RADIUS = 2
SHARD_LIMIT = 20_000
BITS = 64


def simhash(text: str | None, width: int = 3) -> int:
    """Bit i is set if over half the shingles' hashes have it. Words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the unpacked bits of a very long text
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint, "doc_id long, fp long")


def _cut(fixed: int, parts: int) -> list[int]:
    """Masks that add one block each of the bits that fixed leaves free."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    ends = [len(free) * k // parts for k in range(parts + 1)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(shard: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A link from each fingerprint to the root of its cluster in this shard."""
    tree, up = BKTree(radius), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, fp in enumerate(shard):
        up.append(k)
        for other in tree.add(fp & 0xFFFFFFFFFFFFFFFF):
            a, b = root(k), root(other)
            if a != b:
                up[max(a, b)] = min(a, b)
    for k, fp in enumerate(shard):
        if (r := root(k)) != k:
            yield shard[r], fp


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = [], None

        def flush() -> pa.RecordBatch | None:
            pairs = list(_forest(kept, radius)) if len(kept) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"]) if pairs else None

        for b in batches:
            m, v, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(m):
                continue
            edge = np.flatnonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1])) + 1
            starts = np.concatenate([[0], edge, [len(m)]])
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if key != (m[lo], v[lo]):
                    if out := flush():
                        yield out
                    kept, key = [], (m[lo], v[lo])
                kept.extend(fp[lo:hi].tolist())
        if out := flush():
            yield out

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints which chains of pairs within the radius join.

    distinct: one row per fingerprint, column fp.
    """
    ship(distinct.sparkSession)
    masks = _cut(0, radius + 1)
    rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("v")) for i, x in enumerate(masks)))).alias("k")).select("k.m", "k.v", "fp")
    done = []
    for _ in range(2):
        counts = stash(rows.groupBy("m", "v").count().where(F.col("count") > shard_limit).select("m", "v"), "hot-shards")
        if counts.isEmpty():
            break
        hot = F.broadcast(counts) if counts.count() <= 100_000 else counts
        done.append(rows.join(hot, ["m", "v"], "left_anti"))
        below = [_cut(x, radius + 1) for x in masks]
        first = [sum(map(len, below[:i])) for i in range(len(below))]
        rows = rows.join(hot, ["m", "v"], "left_semi")
        child = F.lit(None)
        for i, kids in enumerate(below):
            child = F.when(F.col("m") == i, F.array(*(F.struct(F.lit(first[i] + j).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("v")) for j, x in enumerate(kids)))).otherwise(child)
        # keys of different levels never meet: each level adds a constant
        rows = rows.select("fp", F.explode(child).alias("k")).select("k.m", "k.v", "fp")
        masks = [x for kids in below for x in kids]
    done.append(rows)
    links = None
    for part in done:
        part = part.repartition("m", "v").sortWithinPartitions("m", "v", "fp").mapInArrow(_links(radius), "a long, b long")
        links = part if links is None else links.unionByName(part)
    return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id reachable over links) of every row of docs."""
    fps = stash(fingerprints(docs), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), radius, shard_limit))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, broadcast_rows: int = 1_000_000, similarity: float = 0.8, width: int = shingle_sets.WIDTH) -> DataFrame:
    """One row of docs for each component of near copies: texts whose sets of five-word shingles are 0.8 alike or more.

    Radius, shingles and shards are not those of near_duplicates: at 0.8 fingerprints differ in more bits than blocks of bits can
    find, see shingle_sets. The row that stays has the smallest (doc_id, hash of the text), with null ids last; repeats of it are cut to one. Texts are not
    shuffled while the rows that go are at most broadcast_rows (24 bytes each); beyond that both sides are.
    """
    signed = stash(shingle_sets.signatures(docs, width), "signatures")
    roots = shingle_sets.near_roots(docs, signed, similarity, width, broadcast_rows=broadcast_rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    nodes = signed.groupBy("node").agg(F.min(order).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = nodes.groupBy("root").agg(F.min("least").alias("best"))
    named = nodes.join(best, "root").select("node", F.col("best.doc_id").alias("best_id"), F.col("best.node").alias("best_node"))
    found = stash(signed.select("doc_id", "node").join(named, "node"), "near-duplicates")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    mark, key = fresh(docs, "text_hash"), F.col("doc_id").cast("long")
    rows = docs.withColumn(mark, shingle_sets.node())

    def meet(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return df.join(keys, (df[mark] == keys[f"{mark}_key"]) & key.eqNullSafe(keys[f"{mark}_id"]), how)

    ids = [F.col("doc_id").alias(f"{mark}_id"), F.col("node").alias(f"{mark}_key")]
    gone = small(stash(found.where(~(F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("node") == F.col("best_node")))).select(*ids).distinct(), "gone"))
    kept = meet(rows, gone, "left_anti")
    again = stash(found.groupBy("doc_id", "node").count().where("count > 1").select(*ids), "repeated-rows")
    if not again.isEmpty():
        again = small(again)
        kept = meet(kept, again, "left_anti").unionByName(meet(kept, again, "left_semi").dropDuplicates(["doc_id", mark]))
    return kept.drop(mark)
