import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestep.operators import evaluation, fit, outcomes, policy, stats, trajectory


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_common_prefix_of_least_and_greatest(spark):
    rng = random.Random(1)
    sets = [["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))] for _ in range(60)] + [["a😀b", "a😀c"], ["x" * 5000, "x" * 4999 + "y"]]
    rows = [(min(s), max(s), len(os.path.commonprefix(s))) for s in sets]
    got = table(spark, rows, "a string, b string, n int").select(trajectory.common_prefix(F.col("a"), F.col("b")).alias("k"), "n").collect()
    assert all(r["k"] == r["n"] for r in got)


def test_split_and_ids(spark):
    r = table(spark, [("g", "m", "c", 5), ("g", "n", "c", 6), ("h", "m", "d", 1)], "group_id string, model string, source_chunk string, source_line int")
    o = table(spark, [("g", "split_all_requests")], "original_group_id string, decision string")
    import hashlib

    got = {(x["source_chunk"], x["source_line"]): (x["trajectory_id"], x["grouping_status"]) for x in trajectory.split_groups(r, o).collect()}
    assert got[("c", 5)] == ("g-" + hashlib.sha1(b"c:4").hexdigest()[:8], "audited_split") and got[("d", 1)] == ("h", "singleton")
    assert {x["grouping_status"] for x in trajectory.split_groups(r, o.where("false")).collect()} == {"mixed_model_conflict", "singleton"}
    with pytest.raises(Exception, match="unsupported"):
        trajectory.split_groups(r, table(spark, [("g", "merge")], "original_group_id string, decision string")).collect()


CASES = [
    ((1, 1, 1, 0, 1, 0, 0), "FAILURE", 0.0, "high"), ((1, 0, 0, 0, 0, 0, 0), "FAILURE", 0.0, "high"), ((0, 1, 0, 0, 0, 0, 0), "FAILURE", 0.0, "medium"),
    ((0, 1, 1, 0, 0, 0, 0), "UNKNOWN", None, "low"), ((0, 0, 1, 0, 0, 1, 1), "RECOVERED", 0.7, "medium"), ((0, 0, 0, 0, 1, 0, 0), "SUCCESS", 1.0, "high"),
    ((1, 0, 0, 0, 1, 0, 0), "UNKNOWN", None, "low"), ((1, 0, 1, 0, 1, 0, 0), "SUCCESS", 1.0, "medium"), ((0, 0, 0, 1, 0, 0, 0), "SUCCESS", 1.0, "medium"),
]


def test_label_cascade(spark):
    rows = [(k, *map(bool, c[:4]), *c[4:]) for k, (c, *_) in enumerate(CASES)]
    d = table(spark, rows, "k int, cor boolean, neg boolean, pos boolean, noop boolean, e int, err int, rec int")
    v = outcomes.label_cascade(*(F.col(c) for c in ("cor", "neg", "pos", "noop", "e", "err", "rec")))
    got = [tuple(r) for r in d.select("k", v.alias("v")).orderBy("k").select("v.label", "v.score", "v.confidence").collect()]
    assert got == [c[1:] for c in CASES]


def test_outputs_meet_null_ids_and_the_last_one_counts(spark):
    calls = table(spark, [(1, "a", 0), (1, None, 1), (1, "z", 2)], "r int, call_id string, pos int")
    outputs = table(spark, [(1, "a", 3, "old"), (1, "a", 4, "new"), (1, None, 5, "none"), (2, "z", 1, "other")], "r int, call_id string, pos int, output string")
    assert [r["output"] for r in outcomes.with_outputs(calls, outputs, ["r"]).orderBy("pos").collect()] == ["new", "none", None]


def test_recovered_is_the_semi_join(spark):
    rng = random.Random(3)
    rows = [(r, p, rng.choice("ab"), rng.random() < 0.4, rng.random() < 0.3) for r in range(8) for p in range(12)]
    got = {(r["req"], r["pos"]): r["recovered"] for r in outcomes.recovered_errors(table(spark, rows, "req int, pos int, name string, failed boolean, succeeded boolean"), ["req"]).collect()}
    for q, p, n, f, _ in rows:
        assert got[q, p] == (f and any(q2 == q and p2 > p and n2 == n and s2 for q2, p2, n2, _, s2 in rows))


def test_small_statistics(spark):
    d = table(spark, [(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (10.0, 5.0)], "x double, c double")
    r = d.agg(F.percentile("x", F.lit(0.95)), stats.correlation(F.col("x"), F.col("c")), stats.zscale("c")).first()
    assert r[0] == pytest.approx(9.1) and r[1:] == (0.0, 1.0)
    assert stats.elements(d, "x", {"median": lambda n: F.floor(n / 2), "q1": lambda n: F.floor(n / 4)}).first()[:] == (4.0, 2.0)
    p = table(spark, [(0.1, 0), (0.3, 1), (0.4, 0), (0.8, 1), (0.8, 0)], "p double, y int")
    assert stats.auc(p, "y", "p").first()[0] == pytest.approx(0.583333, abs=1e-6)
    assert stats.auc(p.where("y = 1"), "y", "p").first()[0] == 0.5
    ranks = stats.percentile_ranks(table(spark, [(1,), (2,), (2,), (4,), (None,)], "v int"), "v")
    assert sorted((r["v"], r["v_rank"]) for r in ranks.collect() if r["v"]) == [(1, 0.25), (2, 0.75), (2, 0.75), (4, 1.0)]
    blocks = fit.isotonic(p, "p", "y")
    assert [tuple(r) for r in blocks.orderBy("upper").collect()] == [(0.1, 0.0), (0.4, 0.5), (0.8, 0.5)]
    looked = stats.step_lookup(table(spark, [(0.2,), (0.9,)], "v double"), "v", blocks, "o").collect()
    assert [r["o"] for r in looked] == [0.5, 0.5]


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=30))
@settings(deadline=None)
def test_pooling_is_monotone_keeps_means_and_can_be_split(points):
    tied = {}
    for x, y in points:
        s, w = tied.get(x, (0, 0))
        tied[x] = (s + y, w + 1)
    rows = [(x, float(s), float(w)) for x, (s, w) in sorted(tied.items())]
    whole = fit.pool(*zip(*rows, strict=True))
    values = [s / w for _, s, w in whole]
    assert values == sorted(values) and sum(s for _, s, _ in whole) == sum(y for _, y in points)
    cut = len(rows) // 2
    halves = [b for part in (rows[:cut], rows[cut:]) if part for b in fit.pool(*zip(*part, strict=True))]
    assert [(u, pytest.approx(s / w)) for u, s, w in fit.pool(*zip(*halves, strict=True))] == [(u, pytest.approx(s / w)) for u, s, w in whole]


def test_ridge_against_numpy_for_any_partitioning(spark):
    rng = np.random.default_rng(2)
    x, y = np.c_[np.ones(60), rng.normal(size=(60, 3))], rng.normal(size=(60, 2))
    d = table(spark, [(a.tolist(), float(b[0]), float(b[1])) for a, b in zip(x, y, strict=True)], "v array<double>, a double, b double")
    want = np.linalg.solve(x.T @ x + 7 * np.diag([0, 1, 1, 1]), x.T @ y)
    for n in (1, 5, 32):
        assert np.allclose(fit.ridge(d.repartition(n), "v", ["a", "b"], 7.0), want)
    with pytest.raises(ValueError):
        fit.ridge(table(spark, [([0.0, 0.0], 1.0)], "v array<double>, a double"), "v", ["a"], 0.0)


def test_splits_keep_templates_together(spark):
    d = table(spark, [(k, t) for k, t in enumerate("aaabbc")], "id int, t string")
    got = {(r["t"], r["part"]) for r in fit.three_way(d, "t", 0.2, 0.2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    folds = fit.grouped_folds(table(spark, [(k, str(k // 3)) for k in range(90)], "id int, t string"), "t", 5).collect()
    assert len({(r["t"], r["fold"]) for r in folds}) == 30 and {sum(r["fold"] == f for r in folds) for f in range(5)} == {18}
    assert fit.three_way(d.where("false"), "t").count() == 0


def test_doubly_robust_values(spark):
    d = table(spark, [(0.8, 1, 2.0, 0.1), (0.9, 0, 0.0, 0.4)], "direct_policy_quality double, matched int, inverse_propensity double, residual double")
    r = d.agg(*(c.alias(k) for k, c in evaluation.stabilised().items())).first()
    assert r["dr_value"] == pytest.approx(0.95)
    e = table(spark, [(0.5, 1, 2.0, 0.0), (0.5, 1, 4.0, 0.0)], "direct_policy_quality double, matched int, inverse_propensity double, residual double")
    assert e.agg(evaluation.stabilised()["ess"]).first()[0] == pytest.approx(1.8)
    assert d.where("matched = 0").agg(evaluation.stabilised()["ess"]).first()[0] == 0


def test_propensities(spark):
    d = table(spark, [("general", "0", 0, "opus"), ("general", "0", 0, "opus"), ("general", "0", 0, "luna")], "x_task_category string, x_risk_level string, x_has_image int, incumbent_action string")
    p = {(r["exact_key"], r["action"]): r["propensity"] for r in policy.propensities(d).collect()}
    assert p["general|0|0", "opus"] == pytest.approx(1 / 3) and len(p) == 6 and sum(p.values()) == pytest.approx(1)
    other = d.limit(1).withColumn("x_risk_level", F.lit("3"))
    assert policy.with_propensity(other, policy.propensities(d), "incumbent_action").first()["propensity"] == pytest.approx(1 / 6)


def test_choice_takes_the_cheapest_within_tolerance(spark):
    row = table(spark, [(1000, 0, 0, 0, 0, 0, 0, 10.0, 0.1)], "x_total_context_tokens_est int, x_requires_external_action int, x_is_coding int, x_is_research int, x_requires_multiple_steps int, x_high_risk_language int, x_has_image int, predicted_complexity double, predicted_risk double")
    c = policy.candidates(row, F.lit(0.5), 0.2)
    chosen = {t: c.select(policy.choose(F.lit(t))).first()[0] for t in (0.0, 0.05)}
    assert chosen == {0.0: "fable", 0.05: "luna"}
    none = policy.candidates(row, F.lit(0.5), 0.2, F.array().cast("array<string>"))
    assert none.select(policy.choose(F.lit(0.0)), policy.decision_reason()).first()[:] == ("sonnet", "fixed_fallback_no_support")
    flat = policy.candidates(row, F.lit(0.5), 0.0)
    assert flat.select(policy.choose(F.lit(0.0))).first()[0] == "luna"


def test_profiles_and_scenarios():
    base, swapped = policy.profile_table(), policy.profile_table("gpt_sol_luna_swapped")
    assert base[3]["coding"] == swapped[5]["coding"] and base[3]["route_model"] == swapped[3]["route_model"]
    assert policy.profile_table("compressed")[5]["tool_use"] == pytest.approx(0.79)
    with pytest.raises(ValueError):
        policy.profile_table("other")


def test_nearest_support_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(str(k), rng.choice(["opus", "luna"]), rng.choice(["coding", "general"]), "1", 0, rng.random(), rng.random()) for k in range(60)]
    d = table(spark, rows, "trajectory_id string, incumbent_action string, x_task_category string, x_risk_level string, x_has_image int, a double, b double")
    got = {(r["trajectory_id"], r["action"]): (r["n"], r["distance"]) for r in policy.nearest(d, policy.support_table(d, ["a", "b"]), ["a", "b"], {"a": 2.0, "b": 1.0}, True).collect()}
    for r, action in itertools.product(rows, ("opus", "luna")):
        other = [(((r[5] - s[5]) / 2) ** 2 + (r[6] - s[6]) ** 2) for s in rows if s[1] == action and s[2] == r[2] and s[0] != r[0]]
        if other:
            assert got[r[0], action] == (len(other), pytest.approx((min(other) / 2) ** 0.5))


@pytest.mark.parametrize("local, block", [(1 << 30, 4000), (0, 4000), (0, 7)])
def test_nearest_keeps_every_row_of_a_large_stratum(spark, local, block):
    n = 2_500
    rows = [(str(k), "luna" if k % 50 else "sol", "t", "0", 0, float(k * k % 7919), float(k % 13)) for k in range(n)]
    rows = rows if block > 7 else rows[:60]
    d = spark.createDataFrame(rows, "trajectory_id string, incumbent_action string, x_task_category string, x_risk_level string, x_has_image int, a double, b double")
    got = {(r["trajectory_id"], r["action"]): (r["n"], r["distance"]) for r in policy.nearest(d, policy.support_table(d, ["a", "b"]), ["a", "b"], {"a": 2.0, "b": 1.0}, True, local, shard=block).collect()}
    x = np.array([[r[5] / 2.0, r[6]] for r in rows])
    for action in ("luna", "sol"):
        own = np.array([k for k, r in enumerate(rows) if r[1] == action])
        for i, r in enumerate(rows):
            others = own[own != i]
            want = np.sqrt(((x[others] - x[i]) ** 2).sum(1).min() / 2)
            assert got[r[0], action] == (len(others), pytest.approx(want))


def test_splits_in_closed_form_are_those_of_a_walk():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted({rng.randrange(1, 60) for _ in range(rng.randrange(1, 6))}, reverse=True)
        counts = [rng.randrange(1, 80) for _ in sizes]
        total = sum(a * b for a, b in zip(sizes, counts, strict=True))
        goals = rng.choice([[1.0] * rng.choice([1, 2, 3, 5]), [max(total * f, 1) for f in (1 - 0.2 - 0.2, 0.2, 0.2)]])
        walked, filled = [0.0] * len(goals), np.zeros(len(goals))
        for n, c in zip(sizes, counts, strict=True):
            want = []
            for _ in range(c):
                want.append(min(range(len(goals)), key=lambda f: (walked[f] / goals[f], f)))
                walked[want[-1]] += n
            assert fit.places(np.arange(float(c)), n, filled, goals).tolist() == want
            filled = filled + n * np.array([fit._count(f, np.array([c]), n, filled, goals)[0] for f in range(len(goals))])
            assert filled.tolist() == walked


def test_percentiles_by_group_against_numpy(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(40)) if rng.random() < 0.9 else None) for _ in range(500)]
    got = {r["g"]: r for r in stats.percentiles(table(spark, rows, "g string, v double"), "v", {"lo": 0.1, "mid": 0.5, "hi": 0.95}, ["g"]).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert [got[g][k] for k in ("lo", "mid", "hi")] == [pytest.approx(np.quantile(v, q)) for q in (0.1, 0.5, 0.95)]
    one = stats.percentiles(table(spark, rows, "g string, v double"), "v", {"mid": 0.5}).first()[0]
    assert one == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert stats.percentiles(table(spark, [], "g string, v double"), "v", {"mid": 0.5}).first()[0] is None


def test_ranks_among_other_rows(spark):
    rows, reference = [0.5, 1.0, 2.5, 9.0, None], [1.0, 2.0, 2.0, 4.0, None]
    d = table(spark, [(x,) for x in rows], "v double")
    got = {r["v"]: r["p"] for r in stats.ranks_among(d, table(spark, [(x,) for x in reference], "v double"), "v", "p").collect()}
    assert got == {0.5: 0.0, 1.0: 0.25, 2.5: 0.75, 9.0: 1.0, None: 0.0}
    assert stats.ranks_among(d, d.where("false"), "v", "p").agg(F.max("p")).first()[0] == 0.0


def test_resampling_draws_poisson_counts(spark):
    d = table(spark, [(k, float(k % 7)) for k in range(400)], "id long, v double")
    got = stats.resampled(d, "id", 50, 7, {"v": F.col("v")}).collect()
    assert sorted(r["iteration"] for r in got) == list(range(50))
    assert abs(np.mean([r["n__"] for r in got]) - 400) < 10 and 15 < np.std([r["n__"] for r in got]) < 26
    assert abs(np.mean([r["v"] / r["n__"] for r in got]) - np.mean([k % 7 for k in range(400)])) < 0.1
    again = stats.resampled(d.repartition(7), "id", 50, 7, {"v": F.col("v")}).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_terms_of_whole_texts(spark):
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(2000)) + " tail tail"
    from lodestep.functions import text as T

    d = table(spark, [(k, text) for k in range(3)], "id int, text string").select("id", T.terms(T.model_text(T.sanitise(F.col("text")))).alias("terms"))
    assert len(text) > 12_000
    vocab = fit.vocabulary(d, "terms", 3, features=5000)
    found = {r["term"]: (r["df"], r["total"]) for r in vocab.collect()}
    assert found["tail"] == (3, 6) and found["tail__tail"] == (3, 3) and "wordaa" in found
    weights = fit.tfidf(d, "id", "terms", vocab).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert [r["s"] for r in weights] == [pytest.approx(1.0)] * 3


def test_judgments_of_a_chunk(spark):
    e = table(spark, [("a", "c1", 1, "UNKNOWN"), ("b", "c1", 2, "UNKNOWN"), ("c", "c1", 3, "SUCCESS"), ("d", "c1", 4, "SUCCESS"), ("e", "c2", 2, "UNKNOWN")], "trajectory_id string, source_chunk string, source_line int, y_outcome_label string")
    lines = table(spark, [(2, "PARTIAL", "high", "some"), (3, "UNJUDGEABLE", "low", "none")], "source_line int, label string, confidence string, reason string")
    got = {r["trajectory_id"]: tuple(r)[1:4] for r in outcomes.judged(e, lines, "c1", 3).collect()}
    assert got == {"a": ("SUCCESS", 1.0, "medium"), "b": ("PARTIAL", 0.5, "high"), "c": ("UNJUDGEABLE", None, "low")}
    with pytest.raises(ValueError, match="found 3"):
        outcomes.judged(e, lines, "c1", 100)
    with pytest.raises(Exception, match="unknown judgment"):
        outcomes.judged(e, lines.withColumn("label", F.lit("FINE")), "c1").collect()
