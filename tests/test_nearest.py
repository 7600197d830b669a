import numpy as np
import pytest

from lodestep.operators import nearest as ne


def clustered(rng, n, p, centres, at=0):
    return [("ab"[rng.integers(2)], "uv"[int(rng.random() < 0.2)], f"t{at + k}", [float(v) for v in centres[rng.integers(len(centres))] + rng.normal(size=p) * 0.3]) for k in range(n)]


def brute(asked, support, exclude_self):
    """The nearest distance of each row and action, and how many pairs comparing all takes."""
    out, pairs = {}, 0
    for key, i, x in asked:
        for action in "ab":
            own = np.array([s[3] for s in support if s[:2] == (action, key) and not (exclude_self and s[2] == i)])
            pairs += len(own)
            if len(own):
                out[i, action] = np.sqrt(((own - x) ** 2).sum(1)).min()
    return out, pairs


@pytest.mark.parametrize("exclude_self", [False, True])
def test_clusters_take_a_tenth_of_all_pairs(spark, exclude_self):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 10
    support = clustered(rng, 2000, 8, centres)
    asked = [(k, i, x) for _, k, i, x in support[:700] + clustered(rng, 700, 8, centres, 10**6)]
    s, a = spark.createDataFrame(support, "action string, key string, id string, x array<double>"), spark.createDataFrame(asked, "key string, id string, x array<double>")
    got = {(r["id"], r["action"]): r for r in ne.pivot_join(a, s, exclude_self, shard=100, crowd=200).collect()}
    want, pairs = brute(asked, support, exclude_self)
    assert got.keys() == want.keys() and all(abs(got[k]["distance"] - want[k]) < 1e-12 for k in want)
    assert sum(r["compared"] for r in got.values()) < 0.1 * pairs


@pytest.mark.parametrize(("shard", "pivots", "ranges"), [(7, 3, 2), (40, 64, 64), (10**6, 1, 1)])
def test_ties_repeats_and_spread_rows(spark, shard, pivots, ranges):
    rng = np.random.default_rng(shard)
    support = [("a" if k % 3 else "b", "u", f"t{k % 150}", [float(v) for v in rng.integers(0, 4, 3)]) for k in range(300)]
    asked = [("u", f"t{k}", [float(v) for v in rng.integers(0, 5, 3)]) for k in range(200)] + [("w", "x", [0.0, 0.0, 0.0])]
    s, a = spark.createDataFrame(support, "action string, key string, id string, x array<double>"), spark.createDataFrame(asked, "key string, id string, x array<double>")
    got = {(r["id"], r["action"]): r["distance"] for r in ne.pivot_join(a, s, True, shard, pivots, ranges).collect()}
    want, _ = brute(asked, support, True)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_nothing_to_search(spark):
    s, a = spark.createDataFrame([], "action string, key string, id string, x array<double>"), spark.createDataFrame([("u", "t", [1.0])], "key string, id string, x array<double>")
    assert ne.pivot_join(a, s).count() == 0
    own = spark.createDataFrame([("a", "u", "t", [1.0])], "action string, key string, id string, x array<double>")
    assert ne.pivot_join(a, own, True).count() == 0
    assert [r["distance"] for r in ne.pivot_join(a, own).collect()] == [0.0]
    assert ne.pivot_join(a.limit(0), own).count() == 0


def test_trees_of_equal_and_of_spread_rows():
    rng = np.random.default_rng(5)
    for x in (np.zeros((200, 4)), rng.normal(size=(500, 4)), np.repeat(rng.normal(size=(9, 4)), 60, 0)):
        own, q = np.arange(len(x)), rng.normal(size=(60, 4))
        best, _ = ne.Tree(x, own, 8).search(q, np.full(60, -1), np.full(60, np.inf))
        assert np.array_equal(best, ne.distances(q, x).min(1))
        best, _ = ne.Tree(x, own, 8).search(x, own, np.full(len(x), np.inf))
        d = ne.distances(x, x)
        np.fill_diagonal(d, np.inf)
        assert np.array_equal(best, d.min(1))
