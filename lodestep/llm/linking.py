"""What near-duplicate searches share: BK-trees over fingerprints, and connected components of their links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.session import ship, stash

#: Links that one task joins at most: some 100 MB.
ONE_TASK = 200_000


class BKTree:
    """Integers by their Hamming distances: the children of a node are keyed by their distance to it."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def near(self, value: int) -> list[int]:
        """Positions of all members within the radius; only edges that can lead to one are followed."""
        near: list[int] = []
        todo, radius, values, children = [0] if self.values else [], self.radius, self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                near.append(at)
            kids = children[at]
            if len(kids) > 2 * radius:
                todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
            else:
                todo += [kid for k, kid in kids.items() if -radius <= k - d <= radius]
        return near

    def insert(self, value: int) -> None:
        mine = len(self.values)
        if mine:
            at, values, children = 0, self.values, self.children
            while True:
                d = (values[at] ^ value).bit_count()
                kid = children[at].get(d)
                if kid is None:
                    children[at][d] = mine
                    break
                at = kid
        self.values.append(value)
        self.children.append({})

    def add(self, value: int) -> list[int]:
        """Positions of all members within the radius; value is inserted."""
        near = self.near(value)
        self.insert(value)
        return near


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all links that one task is given."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(a), root(c)
            if a != c:
                up[max(a, c)] = min(a, c)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, limit: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node and root (its component's smallest node) for every node of the links a-b.

    Up to one_task different links are joined by one task, which that number bounds. More are joined by alternating stars: each round is
    written to the shared folder, and rounds grow with the logarithm of the longest chain. Both give the same.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if state[0] <= one_task:
        ship(links.sparkSession)
        return edges.select("u", "v").coalesce(1).mapInArrow(_joined, "node long, root long")
    for _ in range(limit):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stash(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
