"""Commands: python -m lodestep COMMAND ... (load, audit, features, evaluation, review, train, route, route-one, evaluate, replay, notebook)."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestep.functions import money
from lodestep.operators import evaluation, outcomes, policy, stats
from lodestep.plans import pipeline, reports
from lodestep.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestep", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), default=v, type=type(v) if v is not None else str)
        return c

    options = {k: v for k, v in asdict(pipeline.Options()).items() if k not in ("tolerances", "profiles", "prices")} | {"profiles": "", "prices": "", "tolerances": ",".join(f"{t:g}" for t in policy.TOLERANCES)}
    command("load", "export")
    command("audit", "export", audit_output="results/audit", overrides_output="results/overrides")
    command("features", "export", scope="trajectory", output="results/features", overrides="")
    command("evaluation", "export", features="results/features", output="results/evaluation")
    command("review", "export", evaluation="results/evaluation", judgments="", lines="", chunk="", expected=0, calibrated="results/calibrated", sample="results/review_sample", summary="results/review.md")
    command("train", "export", calibrated="results/calibrated", artifact="results/artifact.json", frontier="results/frontier", test="results/test", details="results/details", complexity="results/complexity", summary_json="results/summary.json", summary="results/train.md", chart="results/frontier.svg", **options)
    command("route", features="results/features", artifact="results/artifact.json", output="results/routes")
    command("route-one", "request", artifact="results/artifact.json")
    command("evaluate", "export", calibrated="results/calibrated", artifact="results/artifact.json", comparison="results/comparison", sensitivity="results/sensitivity", weights="results/weights", summary="results/evaluation.md", chart="results/evaluated.svg", tolerance="", **options)
    command("replay", "trajectory", test="results/test")
    command("notebook", frontier="results/frontier", test="results/test", output="results/frontier.ipynb", calibrated="", data="results/data.ipynb", details="", summary_json="results/summary.json", model="results/model.ipynb")
    return p


def _options(spark: SparkSession, a: argparse.Namespace) -> pipeline.Options:
    """Options of train and evaluate, with the profiles and prices of the files named."""
    given = {f.name: getattr(a, f.name) for f in fields(pipeline.Options)}
    profiles = money.profiles_from(sinks.get_text(spark, a.profiles)) if a.profiles else None
    prices = money.prices_from(sinks.get_text(spark, a.prices)) if a.prices else None
    return pipeline.Options(**given | {"tolerances": sorted({float(x) for x in a.tolerances.split(",")}), "profiles": profiles, "prices": prices})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestep").getOrCreate()
    logs = pipeline.load(spark, a.export) if "export" in a else None
    if a.command == "load":
        sizes = logs.requests.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"))
        print(reports.table(sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("requests"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count_if(F.col("models") > 1).alias("mixed")).crossJoin(stats.elements(sizes, "n", {"median": lambda n: F.floor(n / 2)}))))
        print(reports.table(logs.requests.groupBy("model").count().orderBy(F.desc("count"), "model")))
    elif a.command == "audit":
        found, overrides = pipeline.audit(logs)
        sinks.write_table(found, a.audit_output)
        sinks.write_table(overrides, a.overrides_output, "json")
        if unclear := found.where("decision = 'manual_review'").count():
            raise SystemExit(f"{unclear} ambiguous candidate groups need a manual review")
    elif a.command == "features":
        sinks.write_table(pipeline.features(logs, sinks.read_overrides(spark, a.overrides), a.scope), a.output)
    elif a.command == "evaluation":
        sinks.write_table(pipeline.evaluation_table(logs, sinks.read_table(spark, a.features)), a.output)
    elif a.command == "review":
        schema = "trajectory_id string, review_label string, review_score double, review_confidence string"
        judgments = spark.read.schema(schema).json(a.judgments) if a.judgments else spark.createDataFrame([], schema)
        evaluated, counts = sinks.read_table(spark, a.evaluation), None
        if a.lines:
            lines = spark.read.schema("source_line int, label string, confidence string, reason string").json(a.lines)
            sample = outcomes.judged(evaluated, lines, a.chunk, a.expected)
            counts = outcomes.calibration_counts(sample).first().asDict()
            judgments = sample.select(*judgments.columns)
        else:
            sample = judgments
        keys = evaluated.select("trajectory_id", *pipeline.KEYS)
        sinks.write_table(pipeline.reviews(logs, sample.join(keys, "trajectory_id")), a.sample)
        calibrated = outcomes.calibrate(evaluated, judgments, "trajectory_id")
        sinks.write_table(calibrated, a.calibrated)
        sinks.put_text(spark, a.summary, reports.review_report(calibrated.groupBy("evaluation_label_source", "y_outcome_label", "evaluation_outcome_label").count(), counts))
    elif a.command == "train":
        t = pipeline.train(pipeline.modelling_rows(logs, sinks.read_table(spark, a.calibrated)), _options(spark, a))
        if t.artifact.support_path:
            t.artifact.keep_support(t.artifact.support_rows(spark), a.artifact + ".support")
        sinks.put_text(spark, a.artifact, t.artifact.to_json())
        sinks.write_table(t.frontier, a.frontier)
        sinks.write_table(t.test.drop("terms", "candidates", "way"), a.test)
        sinks.put_text(spark, a.summary, reports.training_report(t.tolerance, t.feasible, t.frontier, t.test_metrics, t.summary))
        sinks.put_text(spark, a.summary_json, json.dumps(t.summary, sort_keys=True, indent=1))
        sinks.write_table(t.decisions, a.details, "csv")
        sinks.write_table(t.complexity, a.complexity, "csv")
        sinks.put_text(spark, a.chart, reports.frontier_svg(t.test_metrics))
    elif a.command == "route":
        sinks.write_table(pipeline.route(sinks.read_table(spark, a.features), pipeline.Artifact.from_json(sinks.get_text(spark, a.artifact))), a.output, "json")
    elif a.command == "route-one":
        found = pipeline.route_request(spark, json.loads(sinks.get_text(spark, a.request)), pipeline.Artifact.from_json(sinks.get_text(spark, a.artifact)))
        print(reports.case_report(found))
    elif a.command == "evaluate":
        rows = pipeline.modelling_rows(logs, sinks.read_table(spark, a.calibrated))
        tolerance = float(a.tolerance) if a.tolerance else pipeline.Artifact.from_json(sinks.get_text(spark, a.artifact)).tolerance
        e = pipeline.evaluate(rows, _options(spark, a), tolerance)
        for df, path in ((e.comparison, a.comparison), (e.scenarios, a.sensitivity), (e.caps, a.weights)):
            sinks.write_table(df, path, "csv")
        sinks.put_text(spark, a.chart, reports.frontier_svg(e.comparison))
        sinks.put_text(spark, a.summary, reports.evaluation_report(e.comparison, e.scenarios, e.caps, e.tolerance))
    elif a.command == "notebook":
        sinks.put_text(spark, a.output, reports.frontier_notebook(sinks.read_table(spark, a.frontier), evaluation.metrics(sinks.read_table(spark, a.test), ["policy"])))
        if a.calibrated:
            sinks.put_text(spark, a.data, reports.data_notebook(sinks.read_table(spark, a.calibrated)))
        if a.details:
            details = sinks.read_table(spark, a.details, "csv").withColumns({c: F.col(c).cast("double") for c in ("observed_complexity", "predicted_complexity")})
            sinks.put_text(spark, a.model, reports.model_notebook(details, json.loads(sinks.get_text(spark, a.summary_json))))
    elif a.command == "replay":
        for r in sinks.read_by_id(spark, a.test, "trajectory_id", a.trajectory).select("policy", "logged_model", "chosen_action", "predicted_complexity", "predicted_risk", "incumbent_cost", "policy_cost").collect():
            print(reports.case_report(r.asDict()), end="\n\n")


if __name__ == "__main__":
    main()
