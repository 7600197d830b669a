"""Statistics: ranks, percentiles, correlations, AUC, histograms, calibration, bootstrap."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.session import ship, stash


def zscale(column: str) -> Column:
    """An aggregate: the population deviation, 1 where it is 0."""
    return F.coalesce(F.nullif(F.stddev_pop(column), F.lit(0.0)), F.lit(1.0))


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's correlation, 0 where a column is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def _same(left: DataFrame, right: DataFrame, columns: list[str], mark: str) -> Column:
    """Equality of the columns, nulls included; right has them with mark after their names."""
    return reduce(lambda x, y: x & y, (left[c].eqNullSafe(right[f"{c}{mark}"]) for c in columns))


def running(df: DataFrame, order: str, value: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """df, one row for each group and order, with out: the sum of value over the rows up to each.

    The rows are dealt by ranges of groups and order, and each range starts from the sums before it, so that no task gets a
    whole group.
    """
    g = groups or []
    ranged = stash(df.repartitionByRange(*g, order).withColumn("range__", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*g, "range__").agg(F.sum(value).cast("double").alias("own__"))
    # a row for each range of a group
    w = Window.partitionBy(*(g or [F.lit(0)])).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"{c}__b") for c in [*g, "range__"]), F.coalesce(F.sum("own__").over(w), F.lit(0.0)).alias("before__"))
    own = ranged.withColumn(out, F.sum(value).over(Window.partitionBy(*g, "range__").orderBy(order)))
    joined = own.join(before if g else F.broadcast(before), _same(own, before, [*g, "range__"], "__b"))
    return joined.withColumn(out, F.col(out) + F.col("before__")).select(*df.columns, out)


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each name, the exact sum of a whole-number column over a group's rows up to each, in order.

    As running(), but for several columns at once, and for rows of equal order, which follow each other. No task gets a whole group.
    """
    ranged = stash(df.repartitionByRange(*groups, *order).withColumn("range__", F.spark_partition_id()), "ranges")
    # a row for each range of a group
    w = Window.partitionBy(*groups).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.groupBy(*groups, "range__").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    before = own.select(*(F.col(c).alias(f"{c}__b") for c in [*groups, "range__"]), *(F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"{k}__b") for k in sums))
    upto = Window.partitionBy(*groups, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mine = ranged.withColumns({f"{k}__o": F.sum(c).over(upto) for k, c in sums.items()})
    joined = mine.join(before, _same(mine, before, [*groups, "range__"], "__b"))
    return joined.select(*df.columns, *((F.col(f"{k}__o") + F.col(f"{k}__b")).alias(k) for k in sums))


def _ranked(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """groups, column, rows__ (its own), upto__ and total__ for each different value that is not null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("rows__"))
    ranked = stash(running(counts, column, "rows__", "upto__", groups), "ranked")
    total = ranked.groupBy(*(F.col(c).alias(f"{c}__t") for c in groups)).agg(F.sum("rows__").alias("total__"))
    return ranked.join(total, _same(ranked, total, groups, "__t")) if groups else ranked.crossJoin(F.broadcast(total))


def elements(df: DataFrame, column: str, at: dict[str, Callable[[Column], Column]], groups: list[str] | None = None) -> DataFrame:
    """groups and, for each name, the element of the sorted values at the place (from 0) that its function gives for their number."""
    g = groups or []
    r = _ranked(df, column, g)
    return r.groupBy(*g).agg(*(F.min(F.when(F.col("upto__") > f(F.col("total__")), F.col(column))).alias(k) for k, f in at.items()))


def percentiles(df: DataFrame, column: str, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """groups and, for each name, the percentile of its share, interpolated between neighbours. No task gets a whole group."""
    places = {k: (lambda n, q=q: (n - 1) * q) for k, q in shares.items()}
    ends = {f"{k}__{e}": (lambda n, f=f, h=h: h(f(n))) for k, f in places.items() for e, h in (("lo", F.floor), ("hi", F.ceil))}
    g = groups or []
    found = elements(df, column, ends, g)
    n = df.where(F.col(column).isNotNull()).groupBy(*(F.col(c).alias(f"{c}__n") for c in g)).agg(F.count("*").alias("n__"))
    both = found.join(n, _same(found, n, g, "__n")) if g else found.crossJoin(F.broadcast(n))
    between = lambda k: F.col(f"{k}__lo") + (F.col(f"{k}__hi") - F.col(f"{k}__lo")) * (places[k](F.col("n__")) - F.floor(places[k](F.col("n__"))))
    return both.select(*g, *(between(k).cast("double").alias(k) for k in shares))


def percentile_ranks(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """df with the share of rows whose value is not above a row's own. Counts are made per value, so ties are cheap."""
    g = groups or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*g, column).agg(F.count("*").alias("n__"))
    ranks = running(counts, column, "n__", "upto__", g)
    total = counts.groupBy(*g).agg(F.sum("n__").alias("all__"))
    ranks = ranks.join(F.broadcast(total), g) if g else ranks.crossJoin(F.broadcast(total))
    ranks = ranks.select(*g, column, (F.col("upto__") / F.col("all__")).alias(f"{column}_rank"))
    return df.join(ranks, [*g, column], "left")


def ranks_among(rows: DataFrame, reference: DataFrame, column: str, out: str) -> DataFrame:
    """rows with out: the share of the reference's rows whose value is not above a row's own; 0 where none is, or the value is null."""
    points = reference.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n__"))
    asked = rows.where(F.col(column).isNotNull()).select(column).distinct().withColumn("n__", F.lit(0).cast("long"))
    both = points.unionByName(asked).groupBy(F.col(column).alias("value__")).agg(F.sum("n__").alias("n__"))
    ranks = running(both, "value__", "n__", "upto__")
    total = points.agg(F.coalesce(F.sum("n__"), F.lit(1)).alias("all__"))
    ranks = ranks.crossJoin(F.broadcast(total)).select("value__", (F.col("upto__") / F.col("all__")).alias(out))
    return rows.join(ranks, rows[column] == ranks["value__"], "left").drop("value__").withColumn(out, F.coalesce(out, F.lit(0.0)))


def auc(df: DataFrame, outcome: str, prediction: str, groups: list[str] | None = None) -> DataFrame:
    """Tie-aware ROC AUC by group; 0.5 with one class only. Equal predictions are counted first and share their mean rank."""
    g = groups or []
    bins = df.groupBy(*g, prediction).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("double")).alias("pos"))
    ranked = running(bins, prediction, "n", "upto", g)
    ranked = ranked.withColumn("ranks", F.col("pos") * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2))
    s = ranked.groupBy(*g).agg(F.sum("ranks").alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(*g, F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))), F.lit(0.5)).alias("auc"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, groups: list[str]) -> DataFrame:
    """groups, bin and share: bins of equal width, values beyond the ends in the end bins, each group's shares add up to 1."""
    at = F.floor((F.col(column) - low) / (high - low) * bins).cast("int")
    counted = df.where(F.col(column).isNotNull()).groupBy(*groups, F.least(F.lit(bins - 1), F.greatest(F.lit(0), at)).alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


#: Blocks of a step function up to which they go along in the plan.
STEPS = 10_000


def step(x: Column, blocks: list[tuple[float, float]]) -> Column:
    """The value of the first block (upper, value; sorted) whose bound is not below x, else of the last; x itself without blocks. By halving."""
    if not blocks:
        return x
    uppers, values = (F.array(*(F.lit(float(b[k])) for b in blocks)) for k in (0, 1))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        fits = F.get(uppers, middle) >= x
        return F.when(s["lo"] >= s["hi"], s).when(fits, F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(blocks) - 1).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(len(blocks).bit_length())), start, halve, lambda s: s["lo"])
    return F.when(x.isNotNull(), F.get(values, at))


def step_lookup(rows: DataFrame, value: str, blocks: DataFrame, out: str, steps: int = STEPS) -> DataFrame:
    """rows with the value of the first block whose upper bound is not below theirs, or else of the last block; null where theirs is.

    blocks: upper and value, sorted. Up to steps of them go along in the plan. More are met by the different values in ranges of both; a value
    after the last block of its range takes the first one of the next range that has any.
    """
    if blocks.limit(steps + 1).count() <= steps:
        return rows.withColumn(out, step(F.col(value), sorted(map(tuple, blocks.select("upper", "value").collect()))))
    asked = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("k__")).distinct()
    both = asked.select("k__", F.lit(0).alias("block__"), F.lit(None).cast("double").alias("v__")).unionByName(blocks.select(F.col("upper").alias("k__"), F.lit(1).alias("block__"), F.col("value").cast("double").alias("v__")))
    ranged = stash(both.repartitionByRange("k__").withColumn("range__", F.spark_partition_id()), "step-ranges")
    # a row for each range
    firsts = ranged.groupBy("range__").agg(F.min_by("v__", F.when(F.col("block__") == 1, F.col("k__"))).alias("f__"), F.max_by("v__", F.when(F.col("block__") == 1, F.col("k__"))).alias("l__"))
    later, all_ = Window.orderBy("range__").rowsBetween(1, Window.unboundedFollowing), Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.col("range__").alias("r__"), F.coalesce(F.first("f__", ignorenulls=True).over(later), F.last("l__", ignorenulls=True).over(all_)).alias("next__"))
    # from above, since a frame that only grows is one pass
    w = Window.partitionBy("range__").orderBy(F.desc("k__"), F.desc("block__")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("own__", F.last("v__", ignorenulls=True).over(w)).where("block__ = 0").join(F.broadcast(firsts), F.col("range__") == F.col("r__")).select("k__", F.coalesce("own__", "next__").alias(out))
    return rows.join(found, rows[value].cast("double") == found["k__"], "left").drop("k__")


#: Where the cumulative Poisson distribution of mean 1 steps, as far as 32 bits tell.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def resampled(df: DataFrame, key: str, iterations: int, seed: int, sums: dict[str, Column]) -> DataFrame:
    """iteration, n__ and the sums of bootstrap samples: in each, a row counts as often as its own Poisson draw of mean 1.

    A draw is 32 bits of an MD5 of seed, key and iteration, the same on any engine; rows with equal keys draw alike. Each task
    adds up its own rows, so nothing is gathered or joined. Samples without any row are left out.
    """
    ship(df.sparkSession)
    names, blocks, steps = list(sums), (iterations + 3) // 4, np.array(POISSON)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((iterations, len(names) + 1))
        for b in batches:
            values = np.c_[np.ones(len(b)), np.nan_to_num(b[names].to_numpy(float))]
            for k, v in zip(b["key__"], values, strict=True):
                raw = b"".join([hashlib.md5(f"{seed}:{i}:{k}".encode()).digest() for i in range(blocks)])
                times = np.searchsorted(steps, np.frombuffer(raw, ">u4")[:iterations] / 2.0**32, side="right")
                total += np.outer(times, v)
        yield pd.DataFrame(total, columns=["n__", *names]).assign(iteration=np.arange(iterations))[["iteration", "n__", *names]]

    own = df.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key__"), *(c.cast("double").alias(k) for k, c in sums.items()))
    drawn = own.mapInPandas(run, "iteration int, n__ double, " + ", ".join(f"{k} double" for k in names))
    return drawn.groupBy("iteration").agg(F.sum("n__").alias("n__"), *(F.sum(k).alias(k) for k in names)).where("n__ > 0")


#: Different rows of a bucket of the bootstrap.
BUCKET = 50_000


def dealt(n: int, weights: np.ndarray, bucket: int, iterations: int, seed: int) -> np.ndarray:
    """How many of n draws of each sample fall to a bucket: halves of the buckets share a sample's draws binomially, down to the one.

    Each half's generator has its own key, so every task that asks for a bucket gets the same numbers.
    """
    before = np.concatenate([[0], np.cumsum(weights)])
    lo, hi, left = 0, len(weights), np.full(iterations, n)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        share = (before[middle] - before[lo]) / max(before[hi] - before[lo], 1)
        first = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi]))).binomial(left, share)
        lo, hi, left = (lo, middle, first) if bucket < middle else (middle, hi, left - first)
    return left


def bootstrap(df: DataFrame, key: str, iterations: int, seed: int, sums: dict[str, Column], bucket: int = BUCKET) -> DataFrame:
    """iteration, n__ and the sums of bootstrap samples: each draws as many rows as df has, with replacement.

    Equal rows are drawn as one of their number. Rows are dealt to buckets by hash; a sample's draws are split among the buckets by their
    sizes, and within a bucket drawn at once from its rows in order. What is drawn does not depend on partitions.
    """
    ship(df.sparkSession)
    names = list(sums)
    own = df.select(F.col(key).cast("string").alias("key__"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in sums.items()))
    own = own.groupBy("key__", *names).agg(F.count("*").alias("times__"))
    buckets = max(1, -(-own.count() // bucket))
    own = stash(own.withColumn("bucket__", F.pmod(F.xxhash64("key__", *names), F.lit(buckets)).cast("int")), "bootstrap-rows")
    # a number for each bucket
    weights = np.zeros(buckets, np.int64)
    for r in own.groupBy("bucket__").agg(F.sum("times__").alias("n")).collect():
        weights[r["bucket__"]] = r["n"]
    n = int(weights.sum())

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key__", *names], kind="stable")
        at, values, ends = int(rows["bucket__"].iloc[0]), rows[names].to_numpy(float), np.cumsum(rows["times__"].to_numpy())
        draws = dealt(n, weights, at, iterations, seed)
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, at])))
        total = np.zeros((iterations, len(names)))
        for i, d in enumerate(draws):
            drawn = np.searchsorted(ends, rng.integers(0, ends[-1], d), side="right")
            total[i] = np.bincount(drawn, minlength=len(rows)) @ values
        return pd.DataFrame(total, columns=names).assign(n__=draws.astype(float), iteration=np.arange(iterations))[["iteration", "n__", *names]]

    schema = "iteration int, n__ double, " + ", ".join(f"{k} double" for k in names)
    return own.groupBy("bucket__").applyInPandas(run, schema).groupBy("iteration").agg(F.sum("n__").alias("n__"), *(F.sum(k).alias(k) for k in names))


def interval(df: DataFrame, column: str) -> DataFrame:
    """ci_low and ci_high: the 2.5 and 97.5 percentiles, interpolated."""
    return df.agg(F.percentile(column, F.lit(0.025)).alias("ci_low"), F.percentile(column, F.lit(0.975)).alias("ci_high"))
