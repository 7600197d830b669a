import json

import pytest
from pyspark.sql import functions as F

import logs as synthetic
from lodestep.__main__ import main
from lodestep.functions import money
from lodestep.plans import pipeline
from lodestep.sources import sinks, traces


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Many wide plans over few rows: compiling them would take longer than running them."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    folder = tmp_path_factory.mktemp("export")
    return folder, synthetic.write(folder)


def test_lines_keep_their_numbers(spark, export):
    folder, rows = export
    got = traces.read_lines(spark, str(folder)).collect()
    assert len(got) == len(rows)
    for r in got:
        with open(folder / r["source_chunk"], encoding="utf-8") as f:
            assert json.loads(f.read().splitlines()[r["source_line"] - 1]) == json.loads(r["request"])
    with pytest.raises(Exception):  # noqa: B017
        traces.read_lines(spark, str(folder / "none")).count()


def test_features_of_openings(spark, export):
    folder, rows = export
    logs = pipeline.load(spark, str(folder))
    f = pipeline.features(logs, scope="trajectory")
    assert f.where("x_prior_tool_calls > 0 or x_assistant_messages > 0").isEmpty()
    calls = pipeline.features(logs, scope="call")
    assert calls.count() == len(rows)
    both = calls.join(logs.requests.select(*pipeline.KEYS, "n_items"), pipeline.KEYS)
    assert both.where("x_input_items <> n_items").isEmpty() and both.agg(F.sum("x_prior_tool_calls")).first()[0] > 50
    lines = {(r["source_chunk"], r["source_line"]): json.loads(r["request"]) for r in traces.read_lines(spark, str(folder)).collect()}
    for r in calls.collect():
        q = lines[r["source_chunk"], r["source_line"]]
        assert r["x_input_tokens_est"] == len(json.dumps(q["input"])) // 4
        assert r["x_tool_schema_tokens_est"] == len(json.dumps(q.get("tools", []))) // 4
    assert len(f.columns) == 49


def test_the_whole_way(spark, export, tmp_path, monkeypatch):
    folder, _ = export
    at = lambda name: str(tmp_path / name)
    main(["load", str(folder)], spark)
    try:
        main(["audit", str(folder), "--audit-output", at("audit"), "--overrides-output", at("overrides")], spark)
    except SystemExit as e:
        assert "ambiguous" in str(e)
    main(["features", str(folder), "--output", at("features"), "--overrides", at("overrides")], spark)
    main(["evaluation", str(folder), "--features", at("features"), "--output", at("evaluation")], spark)
    evaluated = sinks.read_table(spark, at("evaluation"))
    assert len(evaluated.columns) == 49 + 19
    assert {r[0] for r in evaluated.select("y_outcome_label").distinct().collect()} >= {"SUCCESS", "FAILURE", "UNKNOWN"}
    one = evaluated.first()["trajectory_id"]
    (tmp_path / "judgments.json").write_text(json.dumps({"trajectory_id": one, "review_label": "UNJUDGEABLE", "review_score": None, "review_confidence": "high"}))
    main(["review", str(folder), "--evaluation", at("evaluation"), "--judgments", at("judgments.json"), "--calibrated", at("calibrated"), "--sample", at("sample"), "--summary", at("review.md")], spark)
    assert sinks.read_table(spark, at("sample")).count() == 1
    reviewed = sinks.read_by_id(spark, at("calibrated"), "trajectory_id", one).first()
    assert reviewed["evaluation_outcome_score"] is None and reviewed["evaluation_outcome_usable"] == 0 and reviewed["evaluation_label_source"] == "manual_review"
    main(["train", str(folder), "--calibrated", at("calibrated"), "--artifact", at("artifact.json"), "--frontier", at("frontier"), "--test", at("test"), "--summary", at("train.md"), "--chart", at("chart.svg"), "--details", at("details"), "--complexity", at("complexity"), "--summary-json", at("summary.json"), "--text-features", "4", "--folds", "2", "--tolerances", "0,0.005,0.01,0.015,0.02,0.025,0.03,0.04,0.05", "--min-stratum", "2", "--fallback", "opus", "--floor", "0.05", "--bootstrap", "20", "--quality-loss", "0.05"], spark)
    artifact = pipeline.Artifact.from_json(sinks.get_text(spark, at("artifact.json")))
    assert artifact.to_json() == pipeline.Artifact.from_json(artifact.to_json()).to_json() and len(artifact.encoder.vocabulary) <= 4
    assert (artifact.min_stratum, artifact.fallback, artifact.floor) == (2, "opus", 0.05)
    assert "tolerance" in (tmp_path / "train.md").read_text().lower() and (tmp_path / "chart.svg").read_text().startswith("<svg")
    frontier = sinks.read_table(spark, at("frontier")).collect()
    assert len(frontier) == 9 and all(0 <= r["dr_quality"] <= 1 and r["ess"] <= r["n"] for r in frontier)
    assert len(artifact.support) == len({x[2] for x in artifact.support}) and not artifact.support_path
    monkeypatch.setattr(pipeline, "SUPPORT_ROWS", 0)
    apart = pipeline.Artifact.from_json(artifact.to_json())
    apart.keep_support(artifact.support_rows(spark), at("artifact.json.support"))
    assert not apart.support and sorted(map(tuple, apart.support_rows(spark).collect())) == sorted((a, k, i, x) for a, k, i, x in artifact.support)
    main(["route", "--features", at("features"), "--artifact", at("artifact.json"), "--output", at("routes")], spark)
    routes = spark.read.json(at("routes")).collect()
    assert len(routes) == sinks.read_table(spark, at("features")).count() and all(len(r["route"]) == r["n_calls"] for r in routes)
    (tmp_path / "request.json").write_text(json.dumps({"input": [{"role": "user", "content": "debug the code"}], "tools": []}))
    main(["route-one", at("request.json"), "--artifact", at("artifact.json")], spark)
    with pytest.raises(ValueError):
        pipeline.route_request(spark, {"input": "x"}, artifact)
    summary = json.loads((tmp_path / "summary.json").read_text())
    assert len(summary) == 22 + 3 and summary["holdout_n"] == summary["test_n"] and 0 <= summary["execution_risk_auc"] <= 1
    details = sinks.read_table(spark, at("details"), "csv")
    assert details.count() == summary["test_n"] and len(details.columns) == 20
    (tmp_path / "prices.json").write_text(json.dumps({k: [10 * u, c, o] for k, u, c, o in money.PRICES}))
    names = ["action", "route_model", "family", *money.DIMENSIONS]
    priors = {p[0]: dict(zip(names[1:], p[1:], strict=True)) for p in money.PROFILES}
    (tmp_path / "priors.json").write_text(json.dumps({"profiles": priors}))
    outputs = [x for k in ("comparison", "sensitivity", "weights") for x in (f"--{k}", at(k))]
    main(["evaluate", str(folder), "--calibrated", at("calibrated"), "--artifact", at("artifact.json"), "--summary", at("sensitivity.md"), "--chart", at("evaluated.svg"), "--bootstrap", "20", "--text-features", "4", "--folds", "2", "--tolerances", "0,0.05", "--prices", at("prices.json"), "--profiles", at("priors.json"), *outputs], spark)
    assert "gpt_sol_luna_swapped" in (tmp_path / "sensitivity.md").read_text() and (tmp_path / "evaluated.svg").read_text().startswith("<svg")
    compared = {r["policy"]: r for r in sinks.read_table(spark, at("comparison"), "csv").collect()}
    assert {"incumbent", "heuristic", "learned_0.000", "learned_0.050"} <= set(compared) and compared["incumbent"]["dr_delta"] == "0.0"
    assert {r["n"] for r in compared.values()} == {str(summary["test_n"])}
    # ten times the prices give ten times the costs
    assert float(compared["incumbent"]["incumbent_cost"]) == pytest.approx(10 * summary["incumbent_opening_cost_usd_est"])
    scenarios = {r["scenario"]: r for r in sinks.read_table(spark, at("sensitivity"), "csv").collect()}
    assert len(scenarios) == 4 and float(scenarios["base"]["route_disagreement_vs_base"]) == 0
    main(["replay", routes[0]["trajectory"], "--test", at("test")], spark)
    main(["notebook", "--frontier", at("frontier"), "--test", at("test"), "--output", at("frontier.ipynb"), "--calibrated", at("calibrated"), "--data", at("data.ipynb"), "--details", at("details"), "--summary-json", at("summary.json"), "--model", at("model.ipynb")], spark)
    for name, cells in (("data", 8), ("model", 7)):
        assert len(json.loads((tmp_path / f"{name}.ipynb").read_text())["cells"]) == cells
    book = json.loads((tmp_path / "frontier.ipynb").read_text())
    assert book["nbformat"] == 4 and [c["cell_type"] for c in book["cells"]] == ["markdown", "code", "code"] and "<svg" in book["cells"][2]["outputs"][1]["data"]["image/svg+xml"]


def test_tables_go_out_and_come_back(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "k int, v array<string>")
    for kind in ("parquet", "csv", "json"):
        sinks.write_table(d, str(tmp_path / kind), kind)
        assert sinks.read_table(spark, str(tmp_path / kind), kind).count() == 2
    assert sinks.read_table(spark, str(tmp_path / "csv"), "csv").dtypes == [("k", "string"), ("v", "string")]
    assert sinks.read_overrides(spark, None).isEmpty() and sinks.read_overrides(spark, str(tmp_path / "none")).isEmpty()


def test_sessions_of_a_stream_and_of_a_table_agree(spark, small, tmp_path):
    from lodestep.streaming.sessions import call_sessions, route_stream

    e = spark.read.parquet(f"{small}/events.parquet")
    batch = call_sessions(e, "10 minutes")
    assert batch.agg(F.sum("calls")).first()[0] == e.count()
    stream = spark.readStream.schema(e.schema).parquet(f"{small}/events.parquet*")
    q = route_stream(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == e.count()
