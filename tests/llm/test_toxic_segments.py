import math
import random
import zlib
from collections import Counter

import pytest

from lodestep.llm import toxic_segments as ts
from lodestep.llm.queries import toxicity


def brute(scores):
    """All maximal scoring segments, by their recursive definition: the best one, then those on either side of it."""
    best = None
    for a in range(len(scores)):
        s = 0.0
        for b in range(a, len(scores)):
            s += scores[b]
            if s > 0 and (best is None or s > best[2] + 1e-9):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return brute(scores[:a]) + [best] + [(x + b + 1, y + b + 1, z) for x, y, z in brute(scores[b + 1 :])]


def test_segments_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        hits = [(k, rng.choice([0.37, 1.13, 2.71, 4.93])) for k in range(25) if rng.random() < 0.4]
        scores = [dict(hits).get(k, -rng.choice([0.11, 0.53, 1.0, 2.9])) for k in range(25)]
        got = [(a, b, round(s, 6)) for a, b, s in ts.segments(scores)]
        want = [(a, b, round(s, 6)) for a, b, s in brute(scores)]
        assert sum(s for *_, s in got) == sum(s for *_, s in want) or {x[2] for x in got} == {x[2] for x in want}
    assert ts.segments([]) == [] and ts.segments([-1.0, -0.5, 0.0, 2.0, -1.0, 2.0, -3.0]) == [(3, 5, 3.0)]


def test_held_out_accuracy(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity(spark, small).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.05 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_held_out_labels_do_not_count(spark, tiny):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(ts.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(ts.score(docs, ts.fit(docs, x)).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_nulls_repeats_and_missing_labels(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "bad word", 1), (3, "bad " * 100_000, 1), (3, "bad", 1)] + [(k, f"some fine text {k}", 1) for k in range(10, 60)] + [(k, f"some vile text {k}", 1) for k in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = [(k, 0) for k in range(10, 60)] + [(k, 1) for k in range(60, 90)] + [(60, 0), (None, 1), (1, None), (2, 0), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = ts.score(docs, ts.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in ts.reject(docs, labels).collect()}
    assert {10, 2, 1} <= kept and not kept & {k for k in range(60, 90)}
    for some in (labels.where("toxic = 0"), labels.where("false")):
        assert all(r["score"] == 0 for r in ts.score(docs, ts.fit(docs, some)).collect())
    assert ts.score(docs.where("false"), ts.fit(docs.where("false"), labels)).count() == 0


def whole(docs, labels):
    """The query in plain Python: (doc_id, text) and (doc_id, toxic) rows to {row: (score, predicted, n_passages, best)}."""
    tokens = lambda t: ts._tokens((t or "").lower())
    crc = lambda d: zlib.crc32(str(d).encode())
    marks, first = {}, {}
    for d, y in labels:
        if d is not None and y is not None and crc(d) % 3 != 1:
            marks[d] = max(y, marks.get(d, 0))
    for d, t in sorted(((d, t) for d, t in docs if d in marks), key=lambda r: r[0]):
        first.setdefault(t, d)
    own = [(crc(d) // 3 % 3 == 0, marks[d], tokens(t)) for d, t in docs if d in set(first.values())]
    y = [Counter(), Counter()]
    for held, toxic, w in own:
        if not held:
            y[toxic].update(set(w))
    n0, n1 = sum(y[0].values()), sum(y[1].values())
    s = [Counter(), Counter()]
    for k in (0, 1):
        for w, n in y[k].items():
            s[k][w[: ts.STEM]] += n
    base, least = math.log(n0 / n1), ts.LEAST_TEXTS
    bound = lambda a, b, x, z, toxic: (lambda v: v if toxic >= least else min(v, 0.0))(math.log(a / b) + base - ts.Z * math.sqrt(1 / (x + 0.5) + 1 / (z + 0.5)))

    def score(w):
        k = w[: ts.STEM]
        a, b = s[1][k], s[0][k]
        if a + b < least:
            return base - 2 * ts.Z
        stem, share = bound(a + 0.5, b + 0.5, a, b, a), (a + 0.5) / (a + b + 1)
        u, v = y[1][w], y[0][w]
        own = bound(u + ts.PRIOR * share, v + ts.PRIOR * (1 - share), u, v, u)
        return own if u + v and (own > 0 or stem > 0 and u + v >= least) else stem

    def found(w):
        return [x for *_, x in brute([score(t) for t in w])]

    clean = [(found(w), len(w)) for held, toxic, w in own if held and not toxic]
    over = sum(len(f) for f, _ in clean)
    rate, scale = (over + 1) / (sum(sum(f) for f, _ in clean) + 2.0), (over + 1) / (sum(n for _, n in clean) + 1)

    def evidence(f, n):
        x = sorted((rate * v - math.log(scale * max(n, 1)) for v in f), reverse=True)
        x = [v for r, v in enumerate(x) if r == 0 or v > 0]
        sums = [sum(x[: r + 1]) for r in range(len(x))]
        return min(-t + (r * math.log(2 * max(t, 1e-9)) if r else 0.0) - math.log(math.factorial(r + 1)) - math.log(math.factorial(r)) for r, t in enumerate(sums))

    held = [(toxic, 200.0 if not (f := found(w)) else evidence(f, len(w))) for h, toxic, w in own if h]
    bins = Counter((t > 0, round(min(max(e, -200), 200) * 4)) for t, e in held)
    cut, out = ts._best_cut(dict(bins)), {}
    for d, t in docs:
        w = tokens(t)
        f = found(w)
        p = 0.0 if cut is None or not f else 1 / (1 + math.exp(-min(max(cut - evidence(f, len(w)) + math.log(7 / 3), -700), 700)))
        out[d] = (p, int(p >= 0.7), sum(rate * x - math.log(scale * max(len(w), 1)) > -math.log(ts.SIGNIFICANT) for x in f), max(f, default=0.0))
    return out


def test_the_query_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    vile, fine = ["vilest", "vilely", "nastiness", "nasty"], [f"word{chr(97 + k)}" for k in range(26)]
    docs, labels = [], []
    for d in range(260):
        toxic = d % 4 == 0
        w = rng.choices(fine, k=rng.randrange(0, 40))
        for _ in range(rng.randrange(1, 4) if toxic else d % 13 == 5):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choices(vile, k=rng.randrange(1, 5) if toxic else 1)
        docs.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs += [(300, None), (301, ""), (302, docs[4][1]), (303, docs[5][1])]
    labels += [(302, 1), (4, 0), (7, None), (999, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got, want = toxicity(spark, str(tmp_path)).collect(), whole(docs, labels)
    assert len(got) == len(docs)
    for r in got:
        assert (r["score"], r["predicted"], r["n_passages"], r["best"]) == (pytest.approx(want[r["doc_id"]][0], abs=1e-6), want[r["doc_id"]][1], want[r["doc_id"]][2], pytest.approx(want[r["doc_id"]][3]))
        assert len(r["passages"]) == r["n_passages"] and all(x["first"] <= x["last"] for x in r["passages"])
    assert sum(r["predicted"] for r in got) > 40 and any(r["n_passages"] > 1 for r in got)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"some {'vile' if k % 3 == 0 else 'fine'} text {k}", 1, 2, 3) for k in range(90)], "doc_id long, text string, toxic int, calibrates int, evidence int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "x") for k in range(90)], "doc_id long, toxic int, text string")
    out = ts.reject(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] % 3 for r in out.collect()} == {1, 2}
