"""Each query against its SQL on the smallest tables, and some with other numbers of partitions."""

import os
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.operators import policy
from lodestep.plans import pipeline, queries
from lodestep.plans.oracles import ORACLES
from lodestep.plans.queries import QUERIES


def plain(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
        return "null"
    return f"{x:.7g}" if "float" in type(x).__name__ else str(bool(x)) if "bool" in type(x).__name__ else str(x)


def rows(df):
    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tiny}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, tiny, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["q_workload_score", "q_isotonic", "q_ridge", "q_template_split", "q_cached_cost", "q_oof_quality_cv"])
def test_partitions_do_not_matter(spark, tiny, name):
    seen = []
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(rows(QUERIES[name](spark, tiny).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]


def test_fitted_chain_against_numpy(spark, tiny):
    """Targets, the encoder with its terms, both ridges, and the quality model of fitted_policy's rows, by numpy."""
    rows = queries._fitted_rows(spark, tiny)
    own = sorted(rows.collect(), key=lambda r: r["trajectory_id"])
    n = len(own)
    target = np.zeros(n)
    for signal, weight in pipeline.WORKLOAD.items():
        v = np.array([r[signal] for r in own])
        target += 100 * weight * np.array([(v <= x).mean() for x in v])
    got = {r["trajectory_id"]: r["workload_target"] for r in pipeline.with_targets(rows, rows).collect()}
    assert np.allclose([got[r["trajectory_id"]] for r in own], target)

    total, df = Counter(), Counter()
    for r in own:
        total.update(r["terms"])
        df.update(set(r["terms"]))
    words = sorted((t for t in total if df[t] >= 3), key=lambda t: (-total[t], t))[:16]
    tf = np.array([[r["terms"].count(t) for t in words] for r in own], float)
    raw = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * (np.log((1 + n) / (1 + np.array([df[t] for t in words]))) + 1), 0.0)
    text = raw / np.maximum(np.sqrt((raw**2).sum(1, keepdims=True)), 1e-300)
    numbers = np.array([[r[f"n_{f}"] for f in pipeline.OPENING] for r in own], float)
    scaled = lambda x: (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    hot = np.array([[r["x_task_category"] == c for c in T.CATEGORIES] + [r["x_risk_level"] == k for k in pipeline.RISKS] for r in own], float)
    x = np.c_[np.ones(n), scaled(numbers), hot, scaled(text)]
    y = np.c_[target, [r["risk_target"] for r in own]]
    ridge = lambda x, y, p: np.linalg.solve(x.T @ x + p * np.diag([0.0] + [1.0] * (x.shape[1] - 1)), x.T @ y)
    want = np.clip(x @ ridge(x, y, pipeline.STAGE_ONE_PENALTY), 0, [100, 1])
    a = pipeline.fit_stage_one(pipeline.with_targets(rows, rows), text_features=16)
    scored = {r["trajectory_id"]: (r["predicted_complexity"], r["predicted_risk"]) for r in a.stage_one(rows).collect()}
    assert a.encoder.vocabulary == words and np.allclose([scored[r["trajectory_id"]] for r in own], want, atol=1e-6)

    out = queries.fitted_policy(spark, tiny).collect()
    assert len(out) == n and all(0 <= r["predicted_complexity"] <= 100 and 0 <= r["predicted_risk"] <= 1 and 0 <= r["predicted_quality"] <= 1 for r in out)
    assert {r["chosen_action"] for r in out} <= {p["action"] for p in policy.profile_table()}


ODD_TEXTS = ["a 1 3.14", "10.0.0.1 10.0.0.2 10.0.0.3", "x 3.14-3.14, 1.2.3a", "2024-01-02 2024-01-03T10:00 1", "PII_NAME_1", "a\u00a0\u00a0b\u00a0", "\u0130\u0391\u03a3 \u03a3", "http://a\u00a0b http\u017f://c me@x.org-", "3\u00b2 \u00bd7 \u0663", "abcde\u017fgh \u0131bcdefgh", "a\x0bb\x85", "<\u212a> <delivery_note>x\n</delivery_note> cron path: `a` \n", None]


@pytest.mark.parametrize("name", ["q_sanitize", "q_template_split"])
def test_odd_texts_against_the_sql(spark, tmp_path, name):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as e

    texts = ODD_TEXTS + [f"{a}{b}" for a in ODD_TEXTS[:6] for b in ODD_TEXTS[:6]]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = e.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall())


def test_long_texts_are_met_once_by_the_encoder(spark):
    """Many terms and a long vocabulary: what a row takes grows with their sum, not their product."""
    names = [f"t{k:03d}" for k in range(400)]
    e = pipeline.Encoder({}, {}, names, [1.0 + k / 100 for k in range(400)])
    text = F.concat(F.array(F.lit("t007"), F.lit("t007"), F.lit("t390")), F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.concat(F.lit("other"), k.cast("string"))))
    begin = time.monotonic()
    got = np.array(spark.range(1).select(text.alias("terms")).select(e.text().alias("x")).first()["x"])
    assert time.monotonic() - begin < 6
    want = np.zeros(400)
    want[7], want[390] = (1 + np.log(2)) * 1.07, 4.9
    assert np.allclose(got, want / np.linalg.norm(want))
