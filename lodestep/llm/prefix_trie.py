"""Prefix trie of conversations: turn arrays sorted over all partitions, swept with a stack, stitched at the partitions' edges.

A turn is 20 bytes, the MD5 of its role and text and its number of words, so a conversation is a binary whose order is that of its turns.
One range sort by (turns, conv_id) puts every node's members side by side: a node is an interval of rows that share d turns. Each
task sweeps its rows with a stack, as if there were no others: the longest common prefix (LCP) of a row with the one before closes the
intervals that are deeper. An interval stands for all nodes along its edge, so the stack is as deep as the path has branches.

What a task knows of a node that lies on neither its first nor its last row's path is final. Nodes on these two paths are open: they
leave the task one by one, keyed by a digest of their turns, and are added up over tasks. Two tasks whose rows share m turns at their
edge have both counted what these m nodes have in common; rows of corrections made from each task's first and last row take it off again.

Nothing is gathered by node: rows grow with the turns, and a node with a third of all conversations is a few numbers for each task. The SHA-256
of a node's ending members runs in the sweep; for open nodes it runs over blocks of BLOCK ids, in order, in a task that holds one block.
A conversation's turns (20 bytes each) are one row, which bounds it at 100 million turns. Range bounds are sampled from such rows.

Null roles and texts count as empty. Turns go by number, null first, equal numbers by role, then by digest, so repeated rows
stay as repeated turns. Rows with a null conv_id belong to no conversation. Extra columns are ignored. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.session import ship, stash

#: Bytes of a turn, and those of them that are its digest.
UNIT, DIGEST = 20, 16
#: Ids of a block of ending members, rows of an Arrow batch.
BLOCK, BATCH = 4096, 8192
GROUP = 20
EMPTY = sha256(b"").hexdigest()
NODE, OPEN, EDGE, ENDS = range(4)
ROW = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id binary, parent binary, part int, block long, data binary"
FIELDS = pa.schema([("kind", pa.int32()), *((k, pa.int64()) for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("id", pa.binary()), ("parent", pa.binary()), ("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn(role: Column, text: Column) -> Column:
    """The 40 hex digits of a turn."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 2 * (UNIT - DIGEST), "0"))


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (UNIT bytes each, in order) of every conversation."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), turn(F.col("role"), F.col("text")).alias("unit")).alias("t"))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["unit"]), "")).alias("turns"))


def grafted(arrays: DataFrame, group: int = GROUP, most: int = 4) -> DataFrame:
    """The conversations rebuilt: the first h turns of conversation c - c % group, then c's own after its first h; h is crc32(c) % most."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int") * UNIT
    stems = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("stem_id"), F.substring("turns", 1, UNIT * (most - 1)).alias("stem"))
    joined = arrays.join(stems, F.col("conv_id") - F.col("conv_id") % group == F.col("stem_id"), "left").withColumn("h", h)
    own, stem = F.col("turns"), F.coalesce("stem", F.lit(b""))
    return joined.select("conv_id", F.concat(F.substring(stem, F.lit(1), F.col("h")), F.substring(own, F.col("h") + 1, F.length(own))).alias("turns"))


def node_id(turns: bytes) -> bytes:
    return blake2b(turns, digest_size=16).digest()


class _Key:
    """The ids of the nodes along a path, from depth d on, each from the one before."""

    def __init__(self, path: bytes, d: int):
        self.path, self.d, self.state = path, d, blake2b(path[: UNIT * d], digest_size=16)

    def digest(self) -> bytes:
        return self.state.digest()

    def to(self, d: int) -> bytes:
        self.state.update(self.path[UNIT * self.d : UNIT * d])
        self.d = d
        return self.digest()


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two conversations share, by halving."""
    lo, hi = 0, min(len(a), len(b)) // UNIT
    if a[: UNIT * hi] == b[: UNIT * hi]:
        return hi
    while lo < hi - 1:
        middle = (lo + hi) // 2
        if a[UNIT * lo : UNIT * middle] == b[UNIT * lo : UNIT * middle]:
            lo = middle
        else:
            hi = middle
    return lo


def words_of(turns: bytes) -> np.ndarray:
    return np.frombuffer(turns, np.uint8).reshape(-1, UNIT)[:, DIGEST:].copy().view(">u4")[:, 0].astype(np.int64)


class _Ends:
    """The ending members of one node, in ascending order: the digest of those so far, and the ids of a block that isn't full."""

    __slots__ = ("blocks", "digest", "ids")

    def __init__(self):
        self.digest, self.ids, self.blocks = sha256(), [], 0

    def add(self, conv: int) -> None:
        self.digest.update((f",{conv}" if self.ids or self.blocks else str(conv)).encode())
        self.ids.append(str(conv))


class _Interval:
    """Rows that share depth turns, so far; first: whether the task's first row is among them."""

    __slots__ = ("children", "conv", "depth", "ends", "first", "leaves", "n", "saved")

    def __init__(self, depth: int, first: bool):
        self.depth, self.first, self.n, self.conv, self.children, self.leaves, self.saved, self.ends = depth, first, 0, None, 0, 0, 0, None


class _Sweep:
    """One task's rows, in order, to the rows of ROW."""

    def __init__(self, part: int, block: int):
        self.part, self.limit, self.stack, self.last, self.head, self.out, self.ready = part, block, [], None, None, [], []

    def add(self, turns: bytes, conv: int) -> None:
        depth = len(turns) // UNIT
        if self.last is None:
            self.head = turns
            self.stack.append(_Interval(0, True))
        else:
            self.close(common_turns(self.last, turns))
        if depth > self.stack[-1].depth:
            self.stack.append(_Interval(depth, self.last is None))
        top = self.stack[-1]
        if top.ends is None:
            top.ends = _Ends()
        top.ends.add(conv)
        if len(top.ends.ids) == self.limit:
            self.block(top.ends, node_id(turns))
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        self.last = turns

    def close(self, shared: int, final: bool = False) -> None:
        """Closes all intervals deeper than shared; an interval that ends there is made if the stack has none."""
        while self.stack[-1].depth > shared:
            done = self.stack.pop()
            up = max(shared, self.stack[-1].depth)
            if up > self.stack[-1].depth:
                self.stack.append(_Interval(up, done.first))
            self.edge(done, up, final or done.first)
            over = self.stack[-1]
            over.n += done.n
            over.conv = done.conv if over.conv is None else min(over.conv, done.conv)
            over.children += 1
            over.leaves += done.leaves
            over.saved += done.saved

    def edge(self, done: _Interval, up: int, is_open: bool) -> None:
        """The nodes of an interval, from its own depth to the turn after up; done.saved becomes that of the highest."""
        if not done.children:
            done.leaves = 1
        words = words_of(self.last[UNIT * up : UNIT * done.depth])
        saved = done.saved + (done.n - 1) * np.cumsum(words[::-1])[::-1]
        path = self.last[: UNIT * done.depth]
        key = _Key(path, up)
        for k, d in enumerate(range(up + 1, done.depth + 1)):
            bottom, top = d == done.depth, d == up + 1
            children = done.children if bottom else 1
            sha = done.ends.digest.hexdigest() if bottom and done.ends else EMPTY
            if is_open:
                above = key.digest()
                row = [OPEN, done.conv, d, None, done.n, children, done.leaves, int(saved[k]), EMPTY, key.to(d), above]
            else:
                row = [NODE, done.conv, d, None if top else done.conv, done.n, children, done.leaves, int(saved[k]), sha, node_id(path) if bottom and children else None, key.digest() if top else None]
            self.put([*row, self.part, None, None])
        if is_open and done.ends:
            self.block(done.ends, node_id(path))
        done.saved = int(saved[0])

    def block(self, ends: _Ends, node: bytes) -> None:
        """A block of a node's ending members, which counts if the node turns out to be open."""
        if ends.ids:
            self.put([ENDS, *[None] * 8, node, None, self.part, ends.blocks, ",".join(ends.ids).encode()])
            ends.ids, ends.blocks = [], ends.blocks + 1

    def put(self, row: list) -> None:
        self.out.append(row)
        if len(self.out) >= BATCH:
            self.ready.append(self.taken())

    def end(self) -> None:
        if self.last is None:
            return
        self.close(0, final=True)
        root = self.stack.pop()
        self.put([OPEN, root.conv, 0, None, root.n, root.children, root.leaves if root.children else 1, root.saved, EMPTY, node_id(b""), None, self.part, None, None])
        if root.ends:
            self.block(root.ends, node_id(b""))
        for k, turns in enumerate((self.head, self.last)):
            self.put([EDGE, *[None] * 10, self.part, k, turns])

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FIELDS)], schema=FIELDS)


def _swept(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for b in batches:
            for turns, conv, part in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sweep = sweep or _Sweep(part, block)
                sweep.add(turns.as_py(), conv)
                while sweep.ready:
                    yield sweep.ready.pop(0)
        if sweep:
            sweep.end()
            yield from sweep.ready
            yield sweep.taken()

    return run


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for each pair of neighbouring tasks, from the last row of one and the first of the next."""
    for b in batches:
        for last, first in zip(b.column(0), b.column(1), strict=True):
            last, first = last.as_py(), first.as_py()
            m = common_turns(last, first)
            saved = np.append(np.cumsum(words_of(last[: UNIT * m])[::-1])[::-1], 0)
            key = _Key(last, 0)
            for at in range(0, m + 1, BATCH):
                d = range(at, min(at + BATCH, m + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.to(k) for k in d], pa.binary()), pa.array([-int(k < m) for k in d], pa.int64()), pa.array([-int(m == len(last) // UNIT)] * len(d), pa.int64()), pa.array([int(saved[max(k, 1) - 1]) for k in d], pa.int64())],
                    ["id", "n_children", "n_leaves", "saved_tokens"],
                )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and ends of each node, from its blocks in order."""
    key, running = None, None
    for b in batches:
        ids, ends = [], []
        for node, data in zip(b.column(0), b.column(1), strict=True):
            node, data = node.as_py(), data.as_py()
            if node != key:
                if running:
                    ids.append(key)
                    ends.append(running.hexdigest())
                key, running = node, sha256(data)
            else:
                running.update(b"," + data)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(ends, pa.string())], ["id", "ends"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["id", "ends"])


def nodes(arrays: DataFrame, partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of arrays (conv_id, turns); every conv_id is one row there.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as op11 has them.
    """
    spark = arrays.sparkSession
    ship(spark)
    by = ["turns", "conv_id"]
    ranged = arrays.select("turns", "conv_id").repartitionByRange(*([partitions] if partitions else []), *by).sortWithinPartitions(*by)
    swept = stash(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_swept(block), ROW), "trie-sweep")

    edges = swept.where(F.col("kind") == EDGE).groupBy("part").agg(F.max(F.when(F.col("block") == 0, F.col("data"))).alias("head"), F.max(F.when(F.col("block") == 1, F.col("data"))).alias("tail"))
    # a row for each task
    pairs = edges.select("head", F.lag("tail").over(Window.orderBy("part")).alias("before")).where("before is not null")
    stitched = pairs.select("before", "head").mapInArrow(_stitched, "id binary, n_children long, n_leaves long, saved_tokens long")

    parts = swept.where(F.col("kind") == OPEN).select("id", "parent", "depth", "conv_id", *SUMS)
    fixes = stitched.select("id", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), *SUMS[1:])
    ends = swept.where(F.col("kind") == ENDS).select("id", "data", "part", "block").repartition("id").sortWithinPartitions("id", "part", "block").select("id", "data").mapInArrow(_digests, "id binary, ends string")
    whole = parts.unionByName(fixes).groupBy("id").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(k).alias(k) for k in SUMS))
    whole = stash(whole.join(ends, "id", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).drop("ends"), "trie-open")

    closed = swept.where(F.col("kind") == NODE)
    columns = ["conv_id", "depth", *SUMS, "ends_sha256"]
    # each id once: closed nodes that have children, and all open ones
    above = closed.where("id is not null").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")).unionByName(whole.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    tops = closed.where("parent is not null").select("parent", *columns).unionByName(whole.select("parent", *columns))
    found = tops.join(above, "parent", "left").select(*columns, "parent_conv_id").unionByName(closed.where("parent is null").select(*columns, "parent_conv_id"))
    return found.select("conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256")


def conversation_trie(conversations: DataFrame, partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return nodes(grafted(turn_arrays(conversations)), partitions, block)
