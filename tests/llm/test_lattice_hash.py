import numpy as np
import pytest

from lodestep.llm import lattice_hash as lh


def brute(rows, cosine=0.95):
    ok = [k for k, (_, e) in enumerate(rows) if e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in {len(rows[k][1]) for k in ok}:
        ks = [k for k in ok if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in ks], float)
        x /= np.abs(x).max(1)[:, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                links[ks[a]] += 1
                p, q = root(ks[a]), root(ks[b])
                up[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, links[k], least.get(root(k)), i is not None and i == least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted(map(tuple, lh.near_duplicates(df, **options).collect()), key=str)


def test_decoding_against_all_near_points():
    rng = np.random.default_rng(1)
    assert len(lh.shortest()) == 240 and set((lh.shortest() ** 2).sum(1)) == {2.0}
    x = rng.normal(size=(300, 8)) * 2
    got = lh.decode(x)
    for p in got:  # whole or half numbers throughout, with an even sum
        assert len({v % 1 for v in p}) == 1 and p.sum() % 2 == 0
    best = ((x - got) ** 2).sum(1)
    assert best.max() <= 1 + 1e-9  # the covering radius
    for v in lh.shortest():
        assert (((x - got - v) ** 2).sum(1) >= best - 1e-9).all()


def test_visits_are_the_nearest_neighbours():
    plan, x = lh.Plan(1, 5.0, 6, 1), np.random.default_rng(2).normal(size=(20, 8))
    y = x @ lh.directions(8, 0, plan)
    by = np.random.default_rng([lh.SEED, 0]).integers(0, 1 << 63, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    homes, visits = lh.cells(x, 0, plan)
    for k in range(20):
        p = lh.decode(y[k : k + 1])[0]
        order = sorted(lh.shortest(), key=lambda v: ((y[k] - p - v) ** 2).sum())[:6]
        assert homes[k] == lh._mixed(np.rint(2 * p)[None], by).view(np.int64)[0]
        assert set(visits[k]) == {lh._mixed(np.rint(2 * (p + v))[None], by).view(np.int64)[0] for v in order}


@pytest.mark.parametrize("vectors", [1000, 1_000_000, 1_000_000_000])
def test_planned_recall(vectors):
    plan = lh.plan(vectors, 0.95, 64)
    assert lh.recall(0.95, 64, plan)[-1] >= 0.99 and plan.tables <= 20


def mixed_rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(k, [float(z) for z in base[rng.integers(30)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.35])]) for k in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [None] + [1.0] * 15), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    rows += [(None, [1.0, 2.0]), (None, None), (507, rows[0][1]), (507, rows[0][1]), (508, [1e308] * 16), (509, [1e-308] * 16), (514, [5.0])]
    return rows + [(510, [-0.0] + [1.0] * 15), (511, [0.0] + [1.0] * 15), (512, [3.0]), (513, [-2.0]), (515, [float("inf")] * 16)]


@pytest.mark.parametrize("limit", [4096, 16])
def test_links_and_components_against_all_pairs(spark, limit):
    rows = mixed_rows()
    df = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "vec_id long, embedding array<double>, node int, x int, cell int")
    assert found(df, limit=limit) == brute(rows)


def test_a_large_group_beside_far_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    rows = [(k, [float(z) for z in (centre + rng.normal(size=32) * 0.1 if k % 2 else rng.normal(size=32))]) for k in range(600)] + [(1000 + k, [float(z) for z in centre]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    assert found(df, limit=100) == brute(rows)


def test_recall_at_the_cosine(spark):
    """Pairs just above the cosine, over all tables of the plan."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1000):
        u, v = rng.normal(size=(2, 64))
        v -= (u @ v) / (u @ u) * u
        w = 0.951 * u / np.linalg.norm(u) + np.sqrt(1 - 0.951**2) * v / np.linalg.norm(v)
        rows += [(2 * k, u.tolist()), (2 * k + 1, w.tolist())]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(r[1] for r in got) >= 0.98 * 2000 and all(r[1] <= 1 for r in got)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_the_query_against_all_pairs(spark, small):
    from lodestep.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op13_lattice_hash"](spark, small).collect()), key=str) == brute(rows)


def test_components_are_written_once_and_without_loss(spark, monkeypatch):
    rng, sizes, real = np.random.default_rng(4), [], lh.stash

    def counted(df, label):
        t = real(df, label)
        sizes.append(t.count() if "x" in t.columns else 0)
        return t

    monkeypatch.setattr(lh, "stash", counted)
    rows = [(k, [float(v) for v in rng.normal(size=16)]) for k in range(150)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute(rows)
    assert max(sizes) == 150
    x = np.concatenate([rng.normal(size=(3, 5)), rng.normal(size=(3, 5)).astype(np.float32).astype(float)])
    assert [r[:1] for r in lh.packed(x)] == [b"d"] * 3 + [b"f"] * 3 and (lh.unpacked(lh.packed(x)) == lh.scaled(x)).all()
