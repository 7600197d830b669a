import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import logs as synthetic
from lodestep.functions import money
from lodestep.functions import text as T
from lodestep.operators import evaluation, outcomes, policy, stats
from lodestep.plans import pipeline


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("export")
    synthetic.write(folder, 160, 5)
    return pipeline.load(spark, str(folder)), folder


def plain_excerpts(request):
    """The excerpts of a request, item by item."""
    def text(c):
        if isinstance(c, list):
            return "\n".join(p.get("text", "") for p in c if isinstance(p, dict))
        return c if isinstance(c, str) else ""

    items, opening = request["input"], []
    for x in items:
        if not isinstance(x, dict) or x.get("type") in ("function_call", "custom_tool_call", "reasoning") or x.get("role") == "assistant":
            break
        opening.append(x)
    later = [x for x in items[len(opening) :] if isinstance(x, dict)]
    answers = [text(x.get("content")) for x in later if x.get("role") == "assistant"]
    outputs = [str(x.get("output", "")) for x in later if x.get("type") in ("function_call_output", "custom_tool_call_output")]
    task = "\n".join(text(x.get("content")) for x in opening if x.get("role") == "user")
    return task, next((a for a in reversed(answers) if a.strip()), "")[:1200], outputs[-1][-1200:] if outputs else ""


def test_excerpts_are_the_last_output_and_the_opening(spark, logs):
    read, folder = logs
    asked = read.requests.select(*pipeline.KEYS, F.lit("SUCCESS").alias("review_label"))
    got = pipeline.reviews(read, asked.unionByName(spark.createDataFrame([("none", 1, "FAILURE")], asked.schema))).collect()
    assert len(got) == asked.count() + 1
    lines, texts = {}, []
    for r in got:
        if r["source_chunk"] == "none":
            assert [r[k] for k in r.asDict() if k.endswith("excerpt")] == ["", "", ""]
            continue
        if r["source_chunk"] not in lines:
            lines[r["source_chunk"]] = (folder / r["source_chunk"]).read_text(encoding="utf-8").splitlines()
        task, answer, output = plain_excerpts(json.loads(lines[r["source_chunk"]][r["source_line"] - 1]))
        assert (r["review_final_assistant_excerpt"], r["review_last_tool_output_excerpt"]) == (answer, output)
        texts.append((task, r["review_task_excerpt"]))
    routed = spark.createDataFrame(texts, "task string, got string").select(F.right(T.routing_text(F.col("task")), F.lit(700)).alias("want"), "got")
    assert routed.where("want <> got").isEmpty() and any(t for t, _ in texts)


@pytest.fixture(scope="module")
def rows(spark, logs):
    read, _ = logs
    evaluated = pipeline.evaluation_table(read, pipeline.features(read))
    calibrated = outcomes.calibrate(evaluated, spark.createDataFrame([], "trajectory_id string, review_label string, review_score double, review_confidence string"), "trajectory_id")
    return pipeline.stash(pipeline.modelling_rows(read, calibrated), "rows")


def test_held_out_rows_do_not_support_themselves(spark, rows):
    o = pipeline.Options(text_features=3, folds=2, tolerances=[0.0, 0.05], bootstrap=50, min_stratum=1)
    e = pipeline.evaluate(rows, o, 0.05)
    split = pipeline.fit.three_way(rows, "template", o.validation_share, o.test_share)
    assert {r[0] for r in e.details.select("trajectory_id").collect()} == {r[0] for r in split.where("part = 2").select("trajectory_id").collect()}
    own = F.array_contains("supported", F.col("incumbent_action"))
    whole = pipeline.fitted(rows, o)
    inside = pipeline.placed(rows.join(e.details.select("trajectory_id"), "trajectory_id"), whole)
    assert inside.where(~own).isEmpty()  # in the sample each row is its own nearest support
    assert not e.details.where(~own).isEmpty()

    compared = {r["policy"]: r for r in e.comparison.collect()}
    assert set(compared) == {"incumbent", "heuristic", "learned_0.000", "learned_0.050"}
    assert compared["learned_0.050"]["validation_selected"] == 1 and (compared["incumbent"]["ci_low"], compared["incumbent"]["dr_delta"]) == (0.0, 0.0)
    for r in compared.values():
        assert sum(json.loads(r["route_counts"]).values()) == r["n"] and r["ci_low"] <= r["ci_high"]
    scenarios = {r["scenario"]: r for r in e.scenarios.collect()}
    assert set(scenarios) == set(pipeline.SCENARIOS)
    for k in ("n", "changed_routes", "savings", "dr_quality", "ci_low", "ci_high", "route_counts"):
        assert scenarios["base"][k] == pytest.approx(compared["learned_0.050"][k])
    assert scenarios["base"]["route_disagreement_vs_base"] == 0
    assert {r["weight_cap"] for r in e.caps.collect()} == {"2", "5", "10", "20", "unclipped"}


def test_each_scenario_has_a_quality_model_of_its_own(spark, rows):
    o = pipeline.Options(text_features=3, folds=2)
    folded = pipeline.out_of_fold(pipeline.with_targets(rows, rows), o)
    a = pipeline.fit_artifact(folded, o)
    own = pipeline.quality_rows(folded, a)
    again, other = pipeline.fit_quality(a, own, o), pipeline.fit_quality(a, own, o, "gpt_sol_luna_swapped")
    assert again.to_json() == a.to_json()
    assert other.profiles != a.profiles and (other.slope, other.quality) != (a.slope, a.quality) or a.slope == other.slope == 0
    whole = pipeline.fit_artifact(folded, o, "gpt_sol_luna_swapped")
    assert other.losses == pytest.approx(whole.losses) and other.quality == pytest.approx(whole.quality)


def test_prices_and_profiles_reach_costs(spark):
    prices = money.prices_from('{"claude-": [7, 1, 1], "claude-opus": [3, 1, 1]}')
    assert policy.uncached_price("claude-opus-5", prices) == 3 and policy.uncached_price("claude-fable-5", prices) == 7 and policy.uncached_price("x", prices) == 2
    names = ["action", "route_model", "family", *money.DIMENSIONS]
    doc = {p[0]: dict(zip(names[1:], p[1:], strict=True)) for p in money.PROFILES}
    assert money.profiles_from(json.dumps({"profiles": doc})) == policy.profile_table()
    doc["sol"]["candidate"] = False
    assert [p["action"] for p in money.profiles_from(json.dumps({"profiles": doc}))] == ["fable", "opus", "sonnet", "terra", "luna"]
    with pytest.raises(ValueError):
        money.profiles_from('{"profiles": {"fable": {}}}')
    with pytest.raises(ValueError):
        money.prices_from('{"a": [1, 2]}')


def test_calibration_counts(spark):
    d = spark.createDataFrame([("SUCCESS", "all_proxy_unknown"), ("UNJUDGEABLE", "all_proxy_unknown"), ("FAILURE", "model_proxy_check"), ("PARTIAL", "model_proxy_check"), ("UNJUDGEABLE", "model_proxy_check"), ("FAILURE", "all_proxy_unknown")], "review_label string, sample string")
    got = outcomes.calibration_counts(d).first().asDict()
    assert got == {"reviewed": 6, "all_proxy_unknown": 3, "model_proxy_check": 3, "judgeable": 4, "success": 1, "partial": 1, "failure": 2, "unjudgeable": 2, "proxy_judgeable": 2, "proxy_false_positive": 1, "proxy_partial": 1}


def test_a_samples_draws_are_all_dealt():
    weights = np.array([5, 0, 70, 1, 24, 100])
    draws = np.stack([stats.dealt(200, weights, k, 4000, 7) for k in range(6)])
    assert (draws.sum(0) == 200).all() and (draws >= 0).all()
    # means and deviations of multinomial shares
    p = weights / 200
    assert np.allclose(draws.mean(1), 200 * p, atol=5 * np.sqrt(200 * p * (1 - p) / 4000) + 1e-12)
    assert np.allclose(draws.std(1), np.sqrt(200 * p * (1 - p)), rtol=0.08)


@pytest.mark.parametrize("bucket", [50_000, 40])
def test_bootstrap_against_numpy(spark, bucket):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(str(k % 150), float(v)) for k, v in enumerate(x)], "k string, x double")
    got = stats.bootstrap(df, "k", 3000, 11, {"x": F.col("x"), "one": F.lit(1.0)}, bucket).toPandas().sort_values("iteration")
    assert len(got) == 3000 and (got["n__"] == 300).all() and (got["one"] == 300).all()
    means, plain = got["x"].to_numpy() / 300, np.array([rng.choice(x, 300).mean() for _ in range(3000)])
    assert abs(means.mean() - x.mean()) < 5 * x.std() / np.sqrt(300 * 3000)
    assert means.std() == pytest.approx(plain.std(), rel=0.08)
    assert np.percentile(means, [2.5, 97.5]) == pytest.approx(np.percentile(plain, [2.5, 97.5]), abs=0.02)
    again = stats.bootstrap(df.repartition(7), "k", 3000, 11, {"x": F.col("x"), "one": F.lit(1.0)}, bucket).toPandas().sort_values("iteration")
    assert np.allclose(again["x"], got["x"])


def test_intervals_of_policies_share_their_samples(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(str(k), p, float(rng.random()), int(rng.random() < 0.5), 2.0, float(rng.normal()), float(k % 2)) for k in range(60) for p in ("a", "b")], "id string, policy string, direct_policy_quality double, matched int, inverse_propensity double, residual double, evaluation_outcome_score double")
    both = {r["policy"]: (r["ci_low"], r["ci_high"]) for r in evaluation.bootstrap_intervals(d, "id", ["a", "b"], 400, 1).collect()}
    twice = {r["policy"]: (r["ci_low"], r["ci_high"]) for r in evaluation.bootstrap_intervals(d.where("policy = 'a'").unionByName(d.where("policy = 'a'").withColumn("policy", F.lit("c"))), "id", ["a", "c"], 400, 1).collect()}
    assert both["a"][0] < both["a"][1] and twice["a"] == twice["c"] and all(v[0] < v[1] for v in both.values())
