from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestep.operators import fit, stats


def plain(x, y):
    """Blocks by pooling sorted ties one after the other, with fractions of whole sums."""
    blocks = []
    for v in np.unique(x):
        blocks.append([v, float(y[x == v].sum()), int((x == v).sum())])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            u, s, w = blocks.pop()
            blocks[-1] = [u, blocks[-1][1] + s, blocks[-1][2] + w]
    return [(u, s / w) for u, s, w in blocks]


def shapes(n):
    rng = np.random.default_rng(n)
    k = np.arange(n)
    yield "noise", k % 97, rng.integers(0, 2, n)
    yield "rising", k, k
    yield "falling", k, -k
    yield "saws", k, k % 50
    yield "steps", k, k // 40 - (k % 40 > 37) * 3
    yield "one", np.zeros(n, int), rng.integers(0, 2, n)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_merged_blocks_are_those_of_one_list(spark, fan_in):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, x, y in shapes(600):
            df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "p double, y double")
            got = sorted(map(tuple, fit.isotonic(df, "p", "y", fan_in).collect()))
            want = plain(np.array(x, float), np.array(y, float))
            assert [u for u, _ in got] == [u for u, _ in want], name
            assert np.allclose([v for _, v in got], [v for _, v in want]), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert fit.isotonic(df.limit(0), "p", "y").count() == 0


@pytest.mark.parametrize("steps", [10_000, 0])
def test_lookups_by_halving_and_by_ranges(spark, steps):
    rng = np.random.default_rng(2)
    blocks = sorted((float(u), float(v)) for u, v in zip(rng.choice(1000, 77, replace=False), np.sort(rng.random(77)), strict=True))
    blocks = [(u, v) for (u, _), v in zip(blocks, sorted(v for _, v in blocks), strict=True)]
    values = [float(v) for v in rng.integers(-50, 1100, 400)] + [u for u, _ in blocks] + [None, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").repartition(5)
    got = {r["k"]: r["o"] for r in stats.step_lookup(df, "v", spark.createDataFrame(blocks, "upper double, value double"), "o", steps).collect()}
    uppers = [u for u, _ in blocks]
    assert len(got) == len(values)
    for k, v in enumerate(values):
        assert got[k] == (None if v is None else blocks[min(int(np.searchsorted(uppers, v)), len(blocks) - 1)][1])


def test_as_many_blocks_as_predictions_stay_a_table(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") / n).alias("p"), F.col("id").cast("double").alias("y"))
    blocks = fit.isotonic(rows, "p", "y")
    assert blocks.agg(F.count("*"), F.sum("value")).first()[:] == (n, n * (n - 1) / 2)
    assert stats.step_lookup(rows, "p", blocks, "o").where("o <> y").isEmpty()


def test_ridge_of_a_design_that_its_gram_matrix_loses(spark):
    rng = np.random.default_rng(6)
    n, t = 900, np.linspace(0, 1, 900)
    x = np.c_[np.ones(n), t, t + 1e-9 * rng.normal(size=n), rng.normal(size=n)]
    y = x @ np.array([[1.0, 0.5], [2.0, -1.0], [3.0, 4.0], [-1.0, 2.0]])
    df = spark.createDataFrame([(a.tolist(), float(b[0]), float(b[1])) for a, b in zip(x, y, strict=True)], "v array<double>, y double, z double").repartition(9)
    got, want = fit.ridge(df, "v", ["y", "z"], 0.0), np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(x @ got - y).max() < 1e-8 and np.allclose(got, want, rtol=1e-4)
    gram = np.linalg.solve(x.T @ x, x.T @ y)  # what normal equations make of it
    assert np.abs(gram - want).max() > 0.1
    a = 15 * np.diag([0.0, 1.0, 1.0, 1.0])
    assert np.allclose(fit.ridge(df, "v", ["y", "z"], 15.0), np.linalg.solve(x.T @ x + a, x.T @ y))
    r = fit.triangle(df, "v", ["y", "z"], stack=2)
    assert np.allclose(r.T @ r, np.c_[x, y].T @ np.c_[x, y])
    same = spark.createDataFrame([([1.0, float(k), float(k)], float(k)) for k in range(9)], "v array<double>, y double")
    with pytest.raises(ValueError, match="singular"):
        fit.ridge(same, "v", ["y"], 0.0)
    assert np.allclose(fit.ridge(same, "v", ["y"], 1e-3)[1:, 0], 0.5, atol=1e-4)


def plain_vocabulary(texts, features, least):
    total, seen = Counter(t for x in texts for t in x), Counter(t for x in texts for t in set(x))
    best = sorted((t for t in total if seen[t] >= least), key=lambda t: (-total[t], t))[:features]
    return [(t, seen[t], total[t]) for t in best]


@pytest.mark.parametrize(("first", "part"), [(4096, 2_000_000), (2, 2_000_000), (1, 40)])
def test_most_frequent_terms_whatever_is_listed_first(spark, first, part):
    rng = np.random.default_rng(first)
    texts = [[f"t{int(k)}" for k in rng.zipf(1.3, rng.integers(0, 40)) if k < 400] for _ in range(150)] + [["rare"] * 500, ["pair"] * 90, ["pair"] * 9, []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, terms array<string>").repartition(5)
    for features, least in ((10, 3), (3, 1), (1000, 3)):
        got = fit.vocabulary(df, "terms", len(texts), features, least, first, part).collect()
        assert [(r["term"], r["df"], r["total"]) for r in got] == plain_vocabulary(texts, features, least)
        assert all(abs(r["idf"] - (np.log((1 + len(texts)) / (1 + r["df"])) + 1)) < 1e-12 for r in got)
    assert fit.vocabulary(df.limit(0), "terms", 0).count() == 0


def test_weights_of_terms_have_length_one(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x", "q"]), ("b", ["q"]), ("c", []), ("d", None), ("e", ["y"])], "id string, terms array<string>")
    vocab = spark.createDataFrame([("x", 2.0), ("y", 3.0)], "term string, idf double")
    got = {(r["id"], r["term"]): r["weight"] for r in fit.tfidf(df, "id", "terms", vocab).collect()}
    n = np.hypot((1 + np.log(2)) * 2, 3)
    assert got == pytest.approx({("a", "x"): (1 + np.log(2)) * 2 / n, ("a", "y"): 3 / n, ("e", "y"): 1.0})
    assert fit.tfidf(df, "id", "terms", vocab.limit(0)).count() == 0


def test_slices_of_a_batch_of_terms():
    lists = pa.array([["a"] * n if n is not None else None for n in (3, 0, None, 9, 2, 2, 1, 30)], pa.list_(pa.string()))
    cut = list(fit._slices(lists, 5))
    assert [x for c in cut for x in c.to_pylist()] == lists.to_pylist() and [len(c) for c in cut] == [3, 1, 3, 1]
    assert fit.PART <= 250_000 and not list(fit._slices(lists[:0], 5))
