import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from lodestep.llm import poisson_mix as pm

SCHEMA = "doc_id long, text string, source string, copies string"


def draw(doc_id, rate, seed=pm.SEED):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p = p * rate / k
        c += p
    return k


def test_against_brute_force(spark):
    rows = [(k, f"t{k}", ["a", "b", None][k % 3 if k % 5 else 0], "x") for k in range(300)] + [(None, "n", "a", "x"), (7, "again", "b", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    n = Counter(r[2] for r in rows)
    w = {s: c**pm.TEMPERATURE for s, c in n.items()}
    rate = {s: w[s] / sum(w.values()) * len(rows) * 2.0 / n[s] for s in n}
    want = Counter((r[0], r[1], r[2], k) for r in rows for k in range(draw(r[0], rate[r[2]])))
    for most in (10, 0):
        got = pm.mix(docs, epochs=2.0, broadcast_rows=most).collect()
        assert Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in got) == want
    assert abs(len(got) - 2 * len(rows)) < 6 * math.sqrt(2 * len(rows))


def test_weights_zero_and_missing(spark):
    docs = spark.createDataFrame([(k, "t", "ab"[k % 2], "x") for k in range(200)], SCHEMA)
    w = lambda *rows: spark.createDataFrame(list(rows), "source string, weight double")
    got = pm.mix(docs, w(("a", 3.0))).collect()
    assert {r["source"] for r in got} == {"a"} and abs(len(got) - 200) < 90 and got[0]["rate"] == 2.0
    assert pm.mix(docs, w(("a", 0.0), ("b", None))).count() == 0
    assert pm.mix(docs, w()).count() == 0


def test_rates_beyond_one_part(spark):
    docs = spark.createDataFrame([(k, "t", "ab"[k % 2], "x") for k in range(40)], SCHEMA)
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = {r["doc_id"]: (r["copies"], r["n"]) for r in pm.mix(docs, weights, epochs=600.0).groupBy("doc_id", "copies").agg(F.count("*").alias("n")).collect()}
    cdf, want = [], {}
    p = c = math.exp(-400.0)
    for k in range(1, 1000):
        cdf.append(c)
        p *= 400.0 / k
        c += p
    for d in range(0, 40, 2):
        u = [int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / 2**52 for x in (f"{pm.SEED}:{d}", f"{pm.SEED}:{d}:part:2", f"{pm.SEED}:{d}:part:3")]
        want[d] = sum(sum(c <= x for c in cdf) for x in u)
    assert {d: n for d, (n, _) in got.items()} == want and all(n == m for n, m in got.values())
    assert abs(sum(want.values()) / 20 - 1200) < 40


def test_order_is_shuffled_and_stable(spark):
    docs = spark.createDataFrame([(k, "t", "a", "x") for k in range(500)], SCHEMA)
    a, b = ([(r["doc_id"], r["copy"]) for r in pm.mix(docs).collect()] for _ in range(2))
    assert a == b and a != sorted(a)
    assert pm.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "t", "a", 5, 6, 7)], "doc_id long, text string, source string, mix_source int, cdf int, mix_cdf int")
    out = pm.mix(docs, epochs=20.0)
    assert out.columns == [*docs.columns, "copies", "copy", "rate", "order_key"] and out.first()[3:6] == (5, 6, 7)
