"""Near copies of embeddings by lattice hashing: random projections decoded to points of the E8 lattice, several tables, probes of neighbours.

A vector is scaled to length one. Each table projects it on ``blocks`` times eight random orthonormal directions and decodes each eight
numbers, stretched by ``scale``, to the nearest point of E8; the cell is the tuple of points. Its home is that cell; it visits those cells
that differ in one block by one of the 240 shortest lattice vectors and are nearest to it, ``probes`` in each table. Two vectors are
compared where one is at home and the other is at home or visits, in double precision; nothing below the cosine is linked.

``plan`` gives blocks by the number of vectors (a block tells some 2,000 cells apart) and as many tables as a simulation of pairs just at the
cosine needs for a recall of TARGET; all else is the same at every size. Recall against brute force is tested.

Equal vectors are one class, told apart by a digest of their components, so copies cost nothing. Cells are dealt by Spark; one with more
than ``limit`` members is cut into blocks, each pair of which is compared in a task of its own, as matrices. No pair is emitted: a
pair counts in the least cell where it meets, and a task gives each class its number of links and a tree of links to its component.

Null, empty and zero vectors, and those with null or non-finite components, link with nothing and are their own components. Vectors
of another length than the most frequent one (then the longest) are compared among their own length only. Rows that repeat a
vec_id are vectors of their own; a null vec_id links but is no candidate for component_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm.linking import components
from lodestep.session import ship, stash

COSINE, TARGET, SEED = 0.95, 0.99, 8
#: Members of a cell that a task holds at once, and rows of one side of a product of matrices.
LIMIT, ROWS = 4096, 512
# Vectors up to which so many blocks are used, with the stretch and the probes that go with them.
PLANS = [(200_000, 1, 5.0, 6), (200_000_000, 2, 4.0, 12), (None, 3, 4.0, 24)]


@dataclass(frozen=True)
class Plan:
    blocks: int
    scale: float
    probes: int
    tables: int


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight: the nearer of those of D8 and of D8 moved by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1) % 2)
        off = y[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def directions(d: int, table: int, plan: Plan) -> np.ndarray:
    """8 * blocks random directions, orthonormal as far as d allows, stretched."""
    rng, want = np.random.default_rng([SEED, table, d]), 8 * plan.blocks
    parts = [np.linalg.qr(rng.normal(size=(d, min(d, want))))[0] for _ in range(-(-want // min(d, want)))]
    return np.concatenate(parts, 1)[:, :want] * plan.scale


def _mixed(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """64 bits of each row of small integers: sums of multiples, so that one block's change is a sum, too."""
    return (x.astype(np.int64).astype(np.uint64) * by).sum(-1, dtype=np.uint64)


def cells(unit: np.ndarray, table: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row of unit in a table, and the cells that it visits."""
    y = unit @ directions(unit.shape[1], table, plan)
    by = np.random.default_rng([SEED, table]).integers(0, 1 << 63, 8 * plan.blocks).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    home, costs, moves = np.zeros(len(unit), np.uint64), [], []
    for k in range(plan.blocks):
        part, mine = y[:, 8 * k : 8 * k + 8], by[8 * k : 8 * k + 8]
        point = decode(part)
        home += _mixed(np.rint(2 * point), mine)
        costs.append(-(part - point) @ shortest().T)
        moves.append(np.broadcast_to(_mixed(np.rint(2 * shortest()), mine), (len(unit), 240)))
    cost = np.concatenate(costs, 1)
    near = np.argpartition(cost, plan.probes - 1, 1)[:, : plan.probes]
    return home.view(np.int64), (home[:, None] + np.take_along_axis(np.concatenate(moves, 1), near, 1)).view(np.int64)


def recall(cosine: float, d: int, plan: Plan, pairs: int = 2000) -> list[float]:
    """The share of random pairs just at the cosine that meet in the first 1, 2, ... tables."""
    rng = np.random.default_rng(SEED)
    u, v = rng.normal(size=(2, pairs, d))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    w = cosine * u + np.sqrt(max(0.0, 1 - cosine**2)) * v
    met, found = np.zeros(pairs, bool), []
    for table in range(plan.tables):
        (a, to_a), (b, to_b) = cells(u, table, plan), cells(w, table, plan)
        met |= (a == b) | (to_a == b[:, None]).any(1) | (to_b == a[:, None]).any(1)
        found.append(float(met.mean()))
    return found


def plan(vectors: int, cosine: float, d: int, target: float = TARGET, most: int = 64) -> Plan:
    """Blocks by the number of vectors, tables by the recall that they give at the cosine."""
    _, blocks, scale, probes = next(p for p in PLANS if p[0] is None or vectors <= p[0])
    got = recall(cosine, d, Plan(blocks, scale, probes, most)) if d > 1 else [1.0]
    return Plan(blocks, scale, probes, next((k + 1 for k, r in enumerate(got) if r >= target), most))


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id and node of each row: a digest of its components, null where it links with nothing."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.exists(x, lambda v: v != 0)
    # -0.0 is 0.0
    plain = F.transform(x, lambda v: v + F.lit(0.0))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.xxhash64(plain)).alias("node"), F.when(sound, F.xxhash64(F.lit(1), plain)).alias("check"), F.when(sound, plain).alias("x"))


HOUSED = "node long, weight long, homes array<long>, visits array<long>, x binary"


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's components, in single precision where that loses nothing; the first byte tells which."""
    single = x.astype(np.float32)
    same = (single == x).all(1)
    return [b"f" + s.tobytes() if k else b"d" + r.tobytes() for k, s, r in zip(same, single, x, strict=True)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row scaled to length one."""
    unit = x / np.abs(x).max(1)[:, None]
    return unit / np.sqrt((unit * unit).sum(1))[:, None]


def unpacked(rows: list[bytes]) -> np.ndarray:
    return scaled(np.stack([np.frombuffer(r, np.float32 if r[:1] == b"f" else np.float64, offset=1).astype(float) for r in rows]))


def _housed(plans: dict[int, Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, weight = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw = b.column(2)
            sizes = np.diff(raw.offsets.to_numpy())
            flat = raw.flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                p = plans[int(d)]
                for lo in range(0, len(rows), 1024):
                    mine = rows[lo : lo + 1024]
                    x = np.stack([flat[at[k] : at[k] + d] for k in mine])
                    unit = scaled(x)
                    homes, visits = zip(*(cells(unit, t, p) for t in range(p.tables)), strict=True)
                    # vectors of different lengths never meet
                    homes, visits = np.stack(homes, 1) ^ int(d), np.stack(visits, 1) ^ int(d)
                    yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(weight[mine]), pa.array(list(homes)), pa.array(list(visits.reshape(len(mine), -1))), pa.array(packed(x), pa.binary())], [f.split()[0] for f in HOUSED.split(", ")])

    return run


FOUND = "node long, links long, other long"


def _compared(cosine: float, limit: int):
    """node and links (of what the node meets here for the first time), or node and other (a link to its component's tree here)."""

    def matched(cell: int, tab: int, rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: side, home, node, weight, homes, visits, x. Two sides meet across only."""
        side = np.array([r[0] for r in rows])
        home = np.array([r[1] for r in rows])
        if not home.any() or len(rows) < 2:
            return None
        node, weight = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        homes = np.array([r[4] for r in rows], np.int64)
        visits = np.array([r[5] for r in rows], np.int64).reshape(len(rows), homes.shape[1], -1)
        x = unpacked([r[6] for r in rows])
        both, links, up = side[0] != side[-1], np.zeros(len(rows), np.int64), np.arange(len(rows))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for lo in range(0, len(rows), ROWS):
            hi = min(lo + ROWS, len(rows))
            close = x[lo:hi] @ x.T >= cosine
            close &= home[lo:hi, None] | home
            close &= node[lo:hi, None] < node  # each pair once; a node may be here once only
            if both:
                close &= side[lo:hi, None] != side
            i, j = np.nonzero(close)
            i += lo
            if not len(i):
                continue
            first = np.ones(len(i), bool)
            for t in range(tab + 1):
                a, b = homes[i, t], homes[j, t]
                i_there, j_there = (visits[i, t] == b[:, None]).any(1), (visits[j, t] == a[:, None]).any(1)
                if t < tab:
                    first &= ~((a == b) | i_there | j_there)
                else:  # in this table they meet at one's home, the other's, or both: the lesser counts
                    least = np.where(a == b, a, np.where(i_there & j_there, np.minimum(a, b), np.where(i_there, b, a)))
                    first &= least == cell
            i, j = i[first], j[first]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
        got = np.flatnonzero(links)
        if not len(got):
            return None
        heads = np.array([root(k) for k in got.tolist()])
        return pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got]), pa.array(node[heads])], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for *shard, side, home, node, weight, homes, visits, x in zip(*columns, strict=True):
                if shard != key:
                    if len(rows) > 1 and (out := matched(key[0], key[1], rows)):
                        yield out
                    key, rows = shard, []
                rows.append((side, home, node, weight, homes, visits, x))
        if len(rows) > 1 and (out := matched(key[0], key[1], rows)):
            yield out

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, limit: int = LIMIT, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stash(classes(vectors), "vectors")
    own = rows.where("node is not null").groupBy("node", "check", F.size("x").alias("d")).agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("x").alias("x"))
    own = stash(own.withColumn("node", F.xxhash64("node", "check")), "vector-classes")
    # one row for each length of vectors
    plans = {r["d"]: plan(r["n"], cosine, r["d"], target) for r in own.groupBy("d").agg(F.count("*").alias("n")).collect()}
    # a row for each vector; its cells are dealt by numbers alone, and its components go only to cells where it may meet another
    housed = stash(own.select("node", "weight", "x").mapInArrow(_housed(plans), HOUSED), "housed")
    key, rest = ["cell", "tab"], ["home", "node", "weight", "homes", "visits", "x"]
    probes = (F.size("visits") / F.size("homes")).cast("int")
    at = F.concat(F.transform("homes", lambda c, t: F.struct(c.alias("cell"), t.alias("tab"), F.lit(True).alias("home"))), F.transform("visits", lambda c, k: F.struct(c.alias("cell"), F.floor(k / probes).cast("int").alias("tab"), F.lit(False).alias("home"))))
    places = housed.select("node", F.explode(at).alias("at")).select("node", "at.*")
    met = stash(places.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or("home").alias("housed")).where("n > 1 and housed").select(*key, F.ceil(F.col("n") / limit).cast("int").alias("blocks")), "met-cells")
    members = places.join(met, key).join(housed, "node")
    # a cell with over limit members is dealt in pairs of blocks
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).cast("int").alias("side"), *rest)
    shard = [*key, "one", "two"]
    found = stash(dealt.repartition(*shard).sortWithinPartitions(*shard, "side").mapInArrow(_compared(cosine, limit), FOUND), "cell-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = own.select("node", "check", "weight", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stash(named, "vector-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(ids, "root").select(F.col("node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    out = rows.select("vec_id", F.xxhash64("node", "check").alias("class"), F.col("node").isNotNull().alias("sound")).join(named, "class", "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
