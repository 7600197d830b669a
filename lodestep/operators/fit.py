"""Fits: ridge over distributed Gram matrices, isotonic blocks, grouped splits, text and dictionary encoders."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestep.operators.stats import running
from lodestep.session import ship, stash

SLOPES = (0.0, 0.05, 0.10, 0.20, 0.30, 0.50)
REFERENCE_CAPABILITY = 0.80


def solve(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The solution of a small symmetric system; a singular one is an error."""
    if np.linalg.matrix_rank(gram) < len(gram):
        raise ValueError("singular ridge system")
    return np.linalg.solve(gram, target)


def gram(df: DataFrame, vector: str, targets: list[str], by: str | None = None) -> dict:
    """X'X and X'y of df's rows (and the number of rows) for each value of ``by``.

    Every task adds up its own rows; the driver gets p * (p + targets) sums for each task and value, whatever the rows.
    """
    ship(df.sparkSession)
    keys = [F.col(by).cast("int").alias("k")] if by else [F.lit(0).alias("k")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, part in b.groupby("k"):
                x, y = np.stack(part["v"].to_list()).astype(float), part[[f"y{i}" for i in range(len(targets))]].to_numpy(float)
                old = sums.get(k, [0, 0, 0])
                sums[k] = [old[0] + x.T @ x, old[1] + x.T @ y, old[2] + len(x)]
        for k, (a, b, n) in sums.items():
            flat = np.concatenate([a.ravel(), b.ravel(), [n]])
            yield pd.DataFrame({"k": k, "i": np.arange(len(flat)), "x": flat})

    rows = df.select(*keys, F.col(vector).alias("v"), *(F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)))
    sums = rows.mapInPandas(partial, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x"))
    flat: dict[int, dict[int, float]] = {}
    for r in sums.collect():
        flat.setdefault(r["k"], {})[r["i"]] = r["x"]
    out = {}
    for k, cells in flat.items():
        v, t = np.array([cells[i] for i in range(len(cells))]), len(targets)
        p = int(round((-t + (t * t + 4 * (len(v) - 1)) ** 0.5) / 2))  # p * p + p * t + 1 cells
        out[k] = (v[: p * p].reshape(p, p), v[p * p : -1].reshape(p, t), int(v[-1]))
    return out


#: Triangles that one task stacks into one.
STACK = 64


def triangle(df: DataFrame, vector: str, targets: list[str], stack: int = STACK) -> np.ndarray:
    """R of a QR of [X y] over all rows, by a tree: tasks reduce batches of their rows to triangles, and stacks of these to one.

    X'X would square the condition of X; triangles keep it. The driver gets at most stack triangles of (p + targets) squared.
    """
    ship(df.sparkSession)
    columns = [F.col(vector).alias("v"), *(F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets))]

    def reduced(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for x in parts:
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        return r

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = reduced(np.c_[np.stack(b["v"].to_list()).astype(float), b[[f"y{i}" for i in range(len(targets))]].to_numpy(float)] for b in batches if len(b))
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel().tolist()], "width": r.shape[1]})

    def stacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = reduced(np.reshape(flat, (-1, width)) for b in batches for flat, width in zip(b["r"], b["width"], strict=True))
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel().tolist()], "width": r.shape[1]})

    schema = "r array<double>, width int"
    at = stash(df.select(*columns).mapInPandas(rows, schema), "triangles")
    while (n := at.count()) > stack:
        at = stash(at.repartition(-(-n // stack)).mapInPandas(stacked, schema), "triangles")
    found = reduced(np.reshape(r["r"], (-1, r["width"])) for r in at.collect())
    if found is None:
        raise ValueError("no rows to fit")
    return found


def ridge(df: DataFrame, vector: str, targets: list[str], penalty: float) -> np.ndarray:
    """Coefficients (p by targets) of the least squares of X b = y with penalty on all but the intercept; a design of lower rank is an error."""
    r = triangle(df, vector, targets)
    p = r.shape[1] - len(targets)
    x = np.vstack([r[:, :p], np.sqrt(penalty) * np.diag([0.0] + [1.0] * (p - 1))])
    found, _, rank, _ = np.linalg.lstsq(x, np.vstack([r[:, p:], np.zeros((p, len(targets)))]), rcond=None)
    if rank < p:
        raise ValueError("singular ridge system")
    return found


def push(blocks: list[tuple[float, float, float]], upper: float, s: float, w: float) -> None:
    """One more block (upper, sum, weight) at the end; neighbours are pooled until values do not fall."""
    while blocks and blocks[-1][1] * w > s * blocks[-1][2]:
        _, s1, w1 = blocks.pop()
        s, w = s + s1, w + w1
    blocks.append((upper, s, w))


def pool(bounds, sums, weights) -> list[tuple[float, float, float]]:
    """Blocks (upper, sum, weight) with values that never fall, by pooling neighbours."""
    blocks: list[tuple[float, float, float]] = []
    for block in zip(bounds, sums, weights, strict=True):
        push(blocks, *block)
    return blocks


#: Ranges whose blocks are merged at once.
FAN_IN = 8


def isotonic(df: DataFrame, prediction: str, outcome: str, fan_in: int = FAN_IN) -> DataFrame:
    """upper and value of each block of an isotonic step function, as a table: there may be as many blocks as predictions.

    Ties are pooled first, then each range of predictions in its task. Lists of blocks merge associatively, so fan_in neighbouring ranges at
    a time become one, until one is left. A block whose value is not below any of an earlier range, nor above any of a later one,
    parts what is before it from what is after it and stays where it is; only the others meet in a task.
    """
    ship(df.sparkSession)
    tied = df.where(F.col(prediction).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(prediction).cast("double").alias("upper")).agg(F.sum(F.col(outcome).cast("double")).alias("s"), F.count("*").cast("double").alias("w"))

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, blocks = None, []
        for b in batches:
            for part, upper, s, w in zip(b["range"], b["upper"], b["s"], b["w"], strict=True):
                if part != key:
                    if blocks:
                        yield pd.DataFrame(blocks, columns=["upper", "s", "w"]).assign(range=key)
                    key, blocks = part, []
                push(blocks, upper, s, w)
        if blocks:
            yield pd.DataFrame(blocks, columns=["upper", "s", "w"]).assign(range=key)

    schema, columns = "upper double, s double, w double, range int", ["range", "upper", "s", "w"]
    at = tied.repartitionByRange("upper").sortWithinPartitions("upper").withColumn("range", F.spark_partition_id()).select(columns)
    at = stash(at.mapInPandas(pooled, schema), "isotonic")
    ranges = at.agg(F.max("range")).first()[0] or 0
    while ranges:
        value, whole = F.col("s") / F.col("w"), F.floor(F.col("range") / fan_in).cast("int")
        # a row for each range
        ends = at.groupBy("range").agg(F.min(value).alias("least"), F.max(value).alias("most")).withColumn("whole", whole)
        earlier, later = (Window.partitionBy("whole").orderBy("range").rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
        ends = ends.select(F.col("range").alias("r__"), F.max("most").over(earlier).alias("before"), F.min("least").over(later).alias("after"))
        met = at.join(F.broadcast(ends), F.col("range") == F.col("r__"))
        free = (value >= F.coalesce("before", value)) & (value <= F.coalesce("after", value))
        rest = met.where(~free).select(whole.alias("range"), "upper", "s", "w").repartition("range").sortWithinPartitions("range", "upper").mapInPandas(pooled, schema)
        at = stash(met.where(free).select("upper", "s", "w", whole.alias("range")).unionByName(rest), "isotonic")
        ranges //= fan_in
    return at.select("upper", (F.col("s") / F.col("w")).alias("value"))


def _before(x: np.ndarray, f: int, g: int, size: int, filled: np.ndarray, targets: list[float]) -> np.ndarray:
    """How many times g is chosen before f is, when f's share is x: the i with (share of g after i groups, g) < (x, f)."""
    share = lambda i: (filled[g] + i * size) / targets[g]
    earlier = (lambda i: share(i) <= x) if g < f else (lambda i: share(i) < x)
    n = np.maximum(np.ceil((x * targets[g] - filled[g]) / size), 0.0)
    for _ in range(2):  # the estimate is off by rounding alone
        n = np.where((n > 0) & ~earlier(n - 1), n - 1, n)
    for _ in range(2):
        n = np.where(earlier(n), n + 1, n)
    return n


def _nth(f: int, j: np.ndarray, size: int, filled: np.ndarray, targets: list[float]) -> np.ndarray:
    """The place among equal groups, in their order, of the one that is f's j-th."""
    x = (filled[f] + j * size) / targets[f]
    return j + sum(_before(x, f, g, size, filled, targets) for g in range(len(targets)) if g != f)


def _count(f: int, rank: np.ndarray, size: int, filled: np.ndarray, targets: list[float]) -> np.ndarray:
    """How many of the first rank equal groups go to f."""
    low, high = np.zeros(len(rank)), rank.astype(float)  # by halving: _nth grows with j
    for _ in range(int(rank.max(initial=1)).bit_length() + 1):
        middle = np.floor((low + high) / 2)
        fits = (middle < high) & (_nth(f, middle, size, filled, targets) < rank)
        low, high = np.where(fits, middle + 1, low), np.where(fits, high, middle)
    return low


def places(rank: np.ndarray, size: int, filled: np.ndarray, targets: list[float]) -> np.ndarray:
    """Where each of the equal groups with these ranks goes, if all go in turn to the place with the least share of its target."""
    out = np.zeros(len(rank), np.int32)
    for f in range(1, len(targets)):
        j = _count(f, rank, size, filled, targets)
        out[_nth(f, j, size, filled, targets) == rank] = f
    return out


def greedy(df: DataFrame, key: str, targets: Callable[[int], list[float]], out: str) -> DataFrame:
    """df with the place of each row's group: groups go, largest first, then by the SHA-256 of their key, to the least filled place.

    Groups of one size are alike, so the driver walks the sizes and their numbers, and each group finds its place from its rank
    among those of its size. targets: from the number of rows to what each place is to get. A null key is an empty one.
    """
    ship(df.sparkSession)
    hash_ = F.sha2(F.coalesce(F.col(key), F.lit("")), 256)
    groups = df.groupBy(hash_.alias("h__")).agg(F.count("*").alias("n__"))
    ranked = stash(running(groups.withColumn("one__", F.lit(1)), "h__", "one__", "upto__", ["n__"]), "group-ranks")
    sizes = sorted(((r[0], r[1]) for r in ranked.groupBy("n__").count().collect()), reverse=True)
    goals = targets(sum(n * c for n, c in sizes))
    filled, before = np.zeros(len(goals)), {}
    for n, c in sizes:
        before[n] = filled.copy()
        filled = filled + n * np.array([_count(f, np.array([c]), n, filled, goals)[0] for f in range(len(goals))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, part in b.groupby("n__"):
                yield pd.DataFrame({"h__": part["h__"], out: places(part["upto__"].to_numpy(float) - 1, n, before[n], goals)})

    found = ranked.select("h__", "n__", "upto__").mapInPandas(run, f"h__ string, {out} int")
    return df.withColumn("h__", hash_).join(found, "h__").drop("h__")


def grouped_folds(df: DataFrame, key: str, folds: int, out: str = "fold") -> DataFrame:
    """df with a fold for each row: groups in order go to the smallest fold."""
    return greedy(df, key, lambda _: [1.0] * folds, out)


def three_way(df: DataFrame, key: str, validation: float = 0.2, test: float = 0.2, out: str = "part") -> DataFrame:
    """df with part (0 train, 1 validation, 2 test): groups in order go where the target is least filled."""
    return greedy(df, key, lambda rows: [max(rows * f, 1) for f in (1.0 - validation - test, validation, test)], out)


#: Terms of a part that are looked at first; different terms at which a task starts a new part; terms of a batch that are counted at once.
FIRST, PART, SLICE = 4096, 250_000, 100_000


def _slices(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive rows of lists with some ``most`` values together; a row with more stands alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lists[lo:hi]
        lo = hi


def term_counts(df: DataFrame, terms: str, most: int = PART) -> DataFrame:
    """part, place (by n, from 1), term, n and d (rows that have it) of the terms that each task has counted, written; nothing is shuffled."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, parts = 0, 0, []

        def merged() -> pa.Table:
            return pa.concat_tables(parts).group_by("t").aggregate([("n", "sum"), ("d", "sum")]).rename_columns(["t", "n", "d"])

        def counted() -> Iterator[pa.RecordBatch]:
            t = merged().sort_by([("n", "descending"), ("t", "ascending")])
            name = pa.array([f"{TaskContext.get().partitionId()}.{part}"] * len(t))
            t = pa.table({"part": name, "place": pa.array(np.arange(1, len(t) + 1)), "term": t["t"], "n": t["n"], "d": t["d"]})
            yield from t.to_batches(max_chunksize=50_000)

        for lists in itertools.chain.from_iterable(_slices(b.column(0), SLICE) for b in batches):
            own = pa.table({"r": np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), "t": lists.flatten()})
            by_row = own.group_by(["r", "t"]).aggregate([([], "count_all")])
            by_term = by_row.group_by("t").aggregate([("count_all", "sum"), ("count_all", "count")]).rename_columns(["t", "n", "d"])
            parts.append(by_term.cast(pa.schema([("t", pa.string()), ("n", pa.int64()), ("d", pa.int64())])))
            held += len(by_term)
            if held > most:
                parts = [merged()]
                held = len(parts[0])
                if held > most // 2:
                    yield from counted()
                    part, held, parts = part + 1, 0, []
        if parts:
            yield from counted()

    return stash(df.select(terms).mapInArrow(run, "part string, place long, term string, n long, d long"), "term-counts")


def vocabulary(df: DataFrame, terms: str, rows: int, features: int = 96, least: int = 3, first: int = FIRST, part: int = PART, broadcast_rows: int = 1_000_000) -> DataFrame:
    """term, df, total, idf of the most frequent terms that at least three documents have.

    Each task counts its own terms. The sums of every part's first ones bound from below what the last term of the result has; what a part
    has not listed is at most its last listed count there, which bounds the others from above. Only terms that can still
    reach the result are summed over all parts. Where terms that no part lists could, more are listed.
    """
    counts = term_counts(df, terms, part)
    while True:
        ends = counts.groupBy("part").agg(F.coalesce(F.max(F.when(F.col("place") == first, F.col("n"))), F.lit(0)).alias("last"))  # a row for each part
        rest = ends.agg(F.coalesce(F.sum("last"), F.lit(0))).first()[0]
        listed = counts.where(F.col("place") <= first).join(F.broadcast(ends), "part").groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("last").alias("listed"))
        listed = stash(listed, "listed-terms")
        sure = listed.where(F.col("d") >= least).orderBy(F.desc("n")).limit(features).agg(F.count("*"), F.min("n")).first()
        floor = sure[1] if sure[0] == features else 0
        if not rest or rest < floor:
            break
        first *= 8
    may = listed.where(F.col("n") + F.lit(rest) - F.col("listed") >= floor).select("term")
    may = F.broadcast(may) if may.count() <= broadcast_rows else may
    t = counts.join(may, "term").groupBy("term").agg(F.sum("d").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least)
    return t.orderBy(F.desc("total"), "term").limit(features).withColumn("idf", F.log(F.lit(1.0 + rows) / (1 + F.col("df"))) + 1)


def tfidf(df: DataFrame, id_: str, terms: str, vocab: DataFrame) -> DataFrame:
    """id, term and weight: (1 + ln tf) * idf, of length 1 for each row. The vocabulary, which is small, goes to the rows; nothing is shuffled."""
    ship(df.sparkSession)
    known = [(r["term"], r["idf"]) for r in vocab.select("term", "idf").collect()]
    names, idf = pa.array([k for k, _ in known], pa.string()), np.array([i for _, i in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            both, tf = np.unique(row[at >= 0] * max(len(idf), 1) + at[at >= 0], return_counts=True)
            row, at = np.divmod(both, max(len(idf), 1))
            raw = (1 + np.log(tf)) * idf[at]
            norm = np.sqrt(np.bincount(row, raw * raw, len(lists)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(at)), pa.array(raw / norm[row])], [id_, "term", "weight"])

    kind = dict(df.dtypes)[id_]
    return df.select(id_, terms).mapInArrow(run, f"`{id_}` {kind}, term string, weight double")


def cross_validated_slope(df: DataFrame, names: list[str], folds: str, outcome: str, capability: str, penalty: float) -> tuple[float, dict[float, float]]:
    """The slope of the capability term with the least held-out squared error (the smaller one of equals), and all errors.

    names: the features; each fold's model standardises them with its own training rows. One pass adds up X'X and X'y for each
    fold; a fold's training sums are all sums less its own, and standardising them is arithmetic. A second pass scores.
    """
    ship(df.sparkSession)
    centre = [c or 0.0 for c in df.agg(*(F.avg(n) for n in names)).first()]
    ys = [(F.col(outcome) - s * (F.col(capability) - REFERENCE_CAPABILITY)).alias(f"t{i}") for i, s in enumerate(SLOPES)]
    x = F.array(F.lit(1.0), *(F.col(n).cast("double") - F.lit(c) for n, c in zip(names, centre, strict=True))).alias("v")
    rows = df.select(F.col(folds).cast("int").alias("k"), x, *ys, F.col(outcome).cast("double").alias("y"), (F.col(capability) - REFERENCE_CAPABILITY).cast("double").alias("c"))
    sums = gram(rows, "v", [f"t{i}" for i in range(len(SLOPES))], by="k")
    whole = [sum(part[i] for part in sums.values()) for i in (0, 1)] if sums else []
    coefficients: dict[int, np.ndarray] = {}
    for k, (a, b, _) in sums.items():
        a, b = whole[0] - a, whole[1] - b
        if not a[0, 0]:
            continue
        mean = a[0] / a[0, 0]
        spread = np.diag(a) / a[0, 0] - mean**2
        scale = np.where(spread > 1e-12 * np.maximum(np.diag(a) / a[0, 0], 1e-300), np.sqrt(np.maximum(spread, 0)), 1.0)
        scale[0], mean[0] = 1.0, 0.0
        m = np.diag(1 / scale)
        m[:, 0] -= mean / scale
        coefficients[k] = m.T @ solve(m @ a @ m.T + penalty * np.diag([0.0] + [1.0] * len(names)), m @ b)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, part in b.groupby("k"):
                if k in coefficients:
                    p = np.stack(part["v"].to_list()).astype(float) @ coefficients[k] + np.outer(part["c"].to_numpy(float), SLOPES)
                    e = ((np.clip(p, 0.0, 1.0) - part["y"].to_numpy(float)[:, None]) ** 2).sum(0)
                    yield pd.DataFrame({"i": np.arange(len(SLOPES)), "e": e, "n": len(part)})

    total = {r["i"]: r["e"] / max(r["n"], 1) for r in rows.mapInPandas(errors, "i int, e double, n long").groupBy("i").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()}
    losses = {s: float(total.get(i, 0.0)) for i, s in enumerate(SLOPES)}
    return min(SLOPES, key=lambda s: (losses[s], s)), losses
