"""Exact nearest neighbours within groups: a pivot join over shards of bounded number, with a vantage-point tree in each task.

Support rows of a group go to their nearest pivot (chosen from a sample, far from each other) and, within its cell, to a range of
distances to it. A row first searches the shard where it would be itself, which bounds its nearest distance. By the triangle
inequality nothing of another shard is nearer than its range of distances allows, nor than the plane between two pivots
does; the row visits only those shards that this bound leaves. Each task searches its shards by a vantage-point tree.

A group has PIVOTS times RANGES shards at most, so what the driver and each task know of them is bounded by the number of groups. Rows that
crowd on a shard are dealt to several copies of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.session import ship, stash

#: Rows of a shard, as long as there are fewer shards than a group may have; pivots of a group; ranges of a cell.
SHARD, PIVOTS, RANGES = 4_000, 64, 64
#: Rows that one copy of a shard is searched for; rows of a leaf.
CROWD, LEAF = 50_000, 48
#: Bounds give way by this share, so that rounding cuts nothing off.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, from differences, so that equal rows are at 0."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += (a[:, None, k] - b[None, :, k]) ** 2
    return np.sqrt(total)


class Tree:
    """A vantage-point tree, searched for many rows at once. own: a number for each row's id."""

    def __init__(self, x: np.ndarray, own: np.ndarray, leaf: int = LEAF):
        self.x, self.own = x, own
        self.root = self._grow(np.arange(len(x)), leaf)

    def _grow(self, at: np.ndarray, leaf: int):
        if len(at) <= leaf:
            return at
        # the row farthest from the first one sees the others at the most different distances
        start = distances(self.x[at[:1]], self.x[at])[0]
        vantage = self.x[at[start.argmax()]]
        d = distances(vantage[None], self.x[at])[0]
        order = d.argsort(kind="stable")
        half = len(at) // 2
        if d[order[0]] == d[order[-1]]:
            return at
        near, far = order[:half], order[half:]
        return vantage, (d[near[0]], d[near[-1]], self._grow(at[near], leaf)), (d[far[0]], d[far[-1]], self._grow(at[far], leaf))

    def search(self, q: np.ndarray, own: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least of best and the distances to rows of another id, and how many distances each row took."""
        best, compared = best.copy(), np.zeros(len(q), np.int64)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    d = distances(q[part], self.x[node])
                    d[own[part, None] == self.own[node]] = np.inf
                    best[part] = np.minimum(best[part], d.min(1))
                    compared[part] += len(node)
                return
            vantage, near, far = node
            d = distances(q[at], vantage[None])[:, 0]
            compared[at] += 1
            inside = d <= (near[1] + far[0]) / 2
            for first in (True, False):
                for (lo, hi, child), mine in ((near, inside), (far, ~inside)):
                    these = np.flatnonzero(mine == first)
                    gap = np.maximum(lo - d[these], d[these] - hi)
                    visit(child, at[these[gap <= best[at[these]] * (1 + SLACK) + SLACK]])

        visit(self.root, np.arange(len(q)))
        return best, compared


class _Shards:
    """A group's pivots and the ranges of its shards."""

    def __init__(self, pivots: np.ndarray, shards: list[tuple[int, int, float, float]]):
        self.pivots = pivots
        self.pivot, self.range = (np.array([s[k] for s in shards], int) for k in (0, 1))
        self.lo, self.hi = (np.array([s[k] for s in shards]) for k in (2, 3))
        self.between = distances(pivots, pivots)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What the distance of each row to anything of each shard is at least."""
        d = distances(q, self.pivots)
        home = d.argmin(1)
        least, rows = d[np.arange(len(q)), home], np.arange(len(q))
        apart = self.between[home]
        plane = np.divide(d**2 - least[:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        mine = d[:, self.pivot]
        out = np.maximum(np.maximum(self.lo - mine, mine - self.hi), np.maximum(plane[:, self.pivot], 0.0))
        # among equal bounds the shard of the nearest pivot comes first
        self.first = np.lexsort((mine, out), axis=1)[:, 0] if len(rows) else home
        return out


def _far_apart(x: np.ndarray, many: int) -> np.ndarray:
    """Rows of x that are far from each other, one after the other."""
    chosen, d = [0], distances(x[:1], x)[0]
    while len(chosen) < many and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(x[chosen[-1:]], x)[0])
    return x[chosen]


PLACE = ["action", "key", "pivot", "range", "copy"]
FOUND = "action string, key string, pivot int, range int, id string, x array<double>, best double, compared long"


def _searched(exclude_self: bool):
    """Rows come sorted by shard, support (side 0) before the rows that ask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, tree, codes = None, [], None, None
        for b in batches:
            if not len(b):
                continue
            marks = b[[*PLACE, "side"]].apply(lambda c: c.astype("category").cat.codes if c.dtype == object else c).to_numpy()
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)])
            for lo, hi in zip(starts, np.r_[starts[1:], len(b)], strict=True):
                part = b.iloc[lo:hi]
                mine, side = tuple(part[PLACE].iloc[0]), part["side"].iloc[0]
                if mine != key:
                    key, rows, tree = mine, [], None
                if side == 0:
                    rows.append(part[["id", "x"]])
                    continue
                if tree is None:
                    if not rows:
                        continue
                    own = pd.concat(rows)
                    codes = pd.Index(own["id"].unique())
                    tree, rows = Tree(np.stack(own["x"].to_list()), codes.get_indexer(own["id"])), []
                own = codes.get_indexer(part["id"]) if exclude_self else np.full(len(part), -2)
                own = np.where(own < 0, -2, own)
                best, compared = tree.search(np.stack(part["x"].to_list()), own, part["best"].to_numpy(float))
                yield part[["action", "key", "pivot", "range", "id", "x"]].assign(best=best, compared=compared)

    return run


def _meet(asked: DataFrame, placed: DataFrame, exclude_self: bool, crowd: int) -> DataFrame:
    """asked (a shard, id, x and best of each row) searched in their shards."""
    shard = PLACE[:4]
    # shards are few, see above
    copies = F.broadcast(asked.groupBy(*shard).agg(F.ceil(F.count("*") / crowd).cast("int").alias("copies")))
    one = placed.join(copies, shard).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumns({"side": F.lit(0), "best": F.lit(0.0)})
    two = asked.join(copies, shard).withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).withColumn("side", F.lit(1))
    columns = [*PLACE, "side", "id", "x", "best"]
    both = one.select(columns).unionByName(two.select(columns))
    return both.repartition(*PLACE).sortWithinPartitions(*PLACE, "side").mapInPandas(_searched(exclude_self), FOUND)


def pivot_join(asked: DataFrame, support: DataFrame, exclude_self: bool = False, shard: int = SHARD, pivots: int = PIVOTS, ranges: int = RANGES, crowd: int = CROWD) -> DataFrame:
    """id, action, distance and compared for each row of asked (key, id, x) and each action whose support (action, key, id, x) has its key.

    distance is the Euclidean one to the nearest support row, with exclude_self of another id; rows without any have none. compared is the
    number of distances that it took. Support and asked should be tables, as they are read several times. Ids that repeat in asked count once.
    """
    ship(asked.sparkSession)
    group = ["action", "key"]
    spot = F.pmod(F.xxhash64("id", "action"), F.lit(1 << 30)) / float(1 << 30)
    # a row for each action and stratum
    want = support.groupBy(*group).agg(F.count("*").alias("n"), F.min_by("x", spot).alias("one")).withColumn("many", F.least(F.lit(pivots), F.ceil(F.col("n") / shard)))
    want = stash(want, "support-groups")
    sample = support.join(F.broadcast(want.select(*group, (4 * F.col("many") / F.col("n")).alias("share"))), group).where(spot <= F.col("share")).select(*group, "x")
    drawn: dict[tuple, list] = {(r["action"], r["key"]): [r["one"]] for r in want.select(*group, "one").collect()}
    many = {(r["action"], r["key"]): r["many"] for r in want.select(*group, "many").collect()}
    for r in sample.collect():  # some 4 * pivots rows a group
        drawn[r["action"], r["key"]].append(r["x"])
    centres = {g: _far_apart(np.array(v, float), many[g]) for g, v in drawn.items()}

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby(group):
                for lo in range(0, len(part), 4096):
                    p = part.iloc[lo : lo + 4096]
                    d = distances(np.stack(p["x"].to_list()), centres[g])
                    yield p.assign(pivot=d.argmin(1).astype(np.int32), d=d.min(1))

    cells = stash(support.select(*group, "id", "x").mapInPandas(assigned, "action string, key string, id string, x array<double>, pivot int, d double"), "support-cells")
    cuts: dict[tuple, dict[int, np.ndarray]] = {}
    for r in cells.groupBy(*group, "pivot").agg(F.count("*").alias("n"), F.percentile_approx("d", [k / ranges for k in range(1, ranges)] or [0.5]).alias("cuts")).collect():
        steps = min(ranges, -(-r["n"] // shard))
        cuts.setdefault((r["action"], r["key"]), {})[r["pivot"]] = np.unique([r["cuts"][ranges * k // steps - 1] for k in range(1, steps)])

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (action, key, pivot), part in b.groupby([*group, "pivot"]):
                yield part.assign(range=np.searchsorted(cuts[action, key][pivot], part["d"]).astype(np.int32))

    placed = stash(cells.mapInPandas(ranged, "action string, key string, id string, x array<double>, pivot int, d double, range int"), "support-shards")
    found: dict[tuple, list] = {}
    for r in placed.groupBy(*group, "pivot", "range").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect():
        found.setdefault((r["action"], r["key"]), []).append((r["pivot"], r["range"], r["lo"], r["hi"]))
    shards = {g: _Shards(centres[g], v) for g, v in found.items()}
    actions = sorted({a for a, _ in shards})
    visit = "action string, key string, pivot int, range int, id string, x array<double>, best double"

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby("key"):
                for action in actions:
                    s = shards.get((action, key))
                    for lo in range(0, len(part) if s else 0, 1024):
                        p = part.iloc[lo : lo + 1024]
                        s.bounds(np.stack(p["x"].to_list()))
                        yield p[["id", "x"]].assign(action=action, key=key, pivot=s.pivot[s.first].astype(np.int32), range=s.range[s.first].astype(np.int32), best=np.inf)

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby(group):
                s = shards[g]
                for lo in range(0, len(part), 1024):
                    p = part.iloc[lo : lo + 1024]
                    home = (p["pivot"].to_numpy()[:, None] == s.pivot) & (p["range"].to_numpy()[:, None] == s.range)
                    best = p["best"].to_numpy(float)[:, None]
                    i, j = np.nonzero((s.bounds(np.stack(p["x"].to_list())) <= best * (1 + SLACK) + SLACK) & ~home & (best > 0))
                    yield p.iloc[i][["action", "key", "id", "x", "best"]].assign(pivot=s.pivot[j].astype(np.int32), range=s.range[j].astype(np.int32))

    support_rows = placed.select(*group, "pivot", "range", "id", "x")
    one = stash(_meet(stash(asked.select("key", "id", "x").mapInPandas(at_home, visit), "first-visits"), support_rows, exclude_self, crowd), "first-found")
    two = _meet(stash(one.drop("compared").mapInPandas(elsewhere, visit), "visits"), support_rows, exclude_self, crowd)
    columns = ["id", "action", "best", "compared"]
    both = one.select(columns).unionByName(two.select(columns))
    return both.groupBy("id", "action").agg(F.min("best").alias("distance"), F.sum("compared").alias("compared")).where("distance < double('infinity')")
