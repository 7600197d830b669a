"""Outcomes: calls and their outputs, recovered errors, duplicates, the label cascade, manual reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions.json_semantics import canonical_arguments, output_failed, output_succeeded
from lodestep.operators.trajectory import joined_text, opening_lengths
from lodestep.sources.traces import CALL_TYPES, OUTPUT_TYPES


def with_outputs(calls: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """calls with the output of their call_id, the last where one id has several; a null id meets null ids."""
    last = outputs.groupBy(*keys, "call_id").agg(F.max_by("output", "pos").alias("output"))
    o = last.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("call_id").alias("o_call_id"), "output")
    on = calls["call_id"].eqNullSafe(o["o_call_id"])
    for k in keys:
        on = on & (calls[k] == o[f"o_{k}"])
    return calls.join(o, on, "left").drop("o_call_id", *(f"o_{k}" for k in keys))


def recovered_errors(calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls with recovered: a failed call with a later success of the same name. The last success says it for all."""
    last = calls.where("succeeded").groupBy(*keys, "name").agg(F.max("pos").alias("last_success"))
    return calls.join(last, [*keys, "name"], "left").withColumn("recovered", F.col("failed") & F.coalesce(F.col("last_success") > F.col("pos"), F.lit(False))).drop("last_success")


def duplicate_surplus(calls: DataFrame, keys: list[str], condition: Column | None = None) -> DataFrame:
    """keys, calls, names, errors and duplicates (calls beyond the first of the same name and arguments)."""
    c = calls if condition is None else calls.where(condition)
    pairs = c.groupBy(*keys, "name", "arguments").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("errors"))
    return pairs.groupBy(*keys).agg(F.sum("n").alias("calls"), F.count_distinct("name").alias("names"), F.sum("errors").alias("errors"), F.sum(F.col("n") - 1).alias("duplicates"))


def label_cascade(correction: Column, negative: Column, positive: Column, noop: Column, effects: Column, errors: Column, recovered: Column) -> Column:
    """A struct of label, score, confidence and reason; the first rule that holds decides."""
    evidence = (effects > 0) | positive | noop

    def verdict(label: str, score: float | None, confidence: str, reason: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(score).cast("double").alias("score"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    # Labels, scores, confidences, reasons and the order of the rules
    return (
        F.when(correction & (negative | ~evidence), verdict("FAILURE", 0.0, "high", "explicit later user correction without clear subsequent completion"))
        .when(negative & ~evidence, verdict("FAILURE", 0.0, "medium", "explicit negative completion language"))
        .when((errors > 0) & (recovered > 0) & evidence, verdict("RECOVERED", 0.7, "medium", "tool error followed by same-tool success and completion evidence"))
        .when((effects > 0) & ~correction & ~negative, verdict("SUCCESS", 1.0, "high", "structured successful side effect with no correction or negative completion"))
        .when(noop & ~negative, verdict("SUCCESS", 1.0, "medium", "expected no-op completion signal"))
        .when(positive & ~negative, verdict("SUCCESS", 1.0, "medium", "positive completion language in observable history"))
        .otherwise(verdict("UNKNOWN", None, "low", "insufficient observable evidence; final model output is absent"))
    )


def eligibility(label: Column, confidence: Column) -> dict[str, Column]:
    known = label != "UNKNOWN"
    return {"y_primary_eval_eligible": (known & (confidence == "high")).cast("int"), "y_sensitivity_eval_eligible": (known & confidence.isin("high", "medium")).cast("int")}


def last_text(text: Column, pos: Column, condition: Column) -> Column:
    """An aggregate: the last text of those that meet condition and are not blank, or an empty text."""
    fine = condition & F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s", " ")) != "", F.lit(False))
    return F.coalesce(F.max_by(F.when(fine, text), F.when(fine, pos)), F.lit(""))


def history(items: DataFrame, keys: list[str]) -> DataFrame:
    """The items after the opening, with position counted from it."""
    return items.join(opening_lengths(items, keys).select(*keys, "opening_len"), keys).where("pos >= opening_len")


def outcome_features(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The outcome columns of each request that has items; a history may be empty."""
    keys = keys or ["source_chunk", "source_line"]
    later = history(items, keys)
    calls = later.where(F.col("type").isin(CALL_TYPES)).select(*keys, "pos", "call_id", "name", "arguments")
    outputs = later.where(F.col("type").isin(OUTPUT_TYPES)).select(*keys, "pos", "call_id", "output")
    c = with_outputs(calls, outputs, keys)
    c = c.select(*keys, "pos", "name", canonical_arguments("arguments").alias("arguments"), output_failed("output").alias("failed"), output_succeeded("output").alias("succeeded"))
    c = recovered_errors(c, keys).withColumn("effect", T.has(F.col("name"), T.SIDE_EFFECT_TOOL) & F.col("succeeded") & ~F.col("failed"))
    per_call = c.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.col("failed").cast("long")).alias("errors"), F.sum(F.col("recovered").cast("long")).alias("recovered"), F.sum(F.col("effect").cast("long")).alias("effects"))
    twice = duplicate_surplus(c, keys, F.col("effect")).select(*keys, F.col("duplicates").alias("duplicate_effects"))
    role, pos, text = F.col("role"), F.col("pos"), F.col("content_text")
    per_text = later.groupBy(*keys).agg(
        F.count("*").alias("history_items"),
        joined_text(text, pos, role == "user").alias("later_user"),
        joined_text(F.col("output_text"), pos, F.col("type").isin(OUTPUT_TYPES)).alias("outputs"),
        last_text(text, pos, role == "assistant").alias("final"),
    )
    r = items.select(*keys).distinct().join(per_text, keys, "left").join(per_call, keys, "left").join(twice, keys, "left")
    r = r.na.fill("", ["later_user", "outputs", "final"]).na.fill(0, ["history_items", "calls", "errors", "recovered", "effects", "duplicate_effects"])
    r = r.withColumns({"correction": T.has(F.col("later_user"), T.CORRECTION), "positive": T.has(F.col("final"), T.POSITIVE), "negative": T.has(F.col("final"), T.NEGATIVE), "noop": T.has(F.concat("final", F.lit("\n"), "outputs"), T.NOOP_SUCCESS)})
    r = r.withColumn("v", label_cascade(*(F.col(k) for k in ("correction", "negative", "positive", "noop", "effects", "errors", "recovered"))))
    return r.select(
        *keys,
        F.col("v.label").alias("y_outcome_label"),
        F.col("v.score").alias("y_outcome_score"),
        F.col("v.confidence").alias("y_label_confidence"),
        F.col("v.reason").alias("y_label_reason"),
        F.lit("observable_history_before_missing_final_output").alias("y_label_scope"),
        F.lit(1).alias("y_final_output_missing"),
        F.col("history_items").alias("y_observed_history_items"),
        F.col("calls").alias("y_observed_tool_calls"),
        F.col("errors").alias("y_tool_errors"),
        F.col("recovered").alias("y_recovered_tool_errors"),
        F.greatest(F.col("errors") - F.col("recovered"), F.lit(0)).alias("y_unrecovered_tool_errors"),
        F.col("effects").alias("y_successful_side_effects"),
        F.col("duplicate_effects").alias("y_duplicate_successful_side_effects"),
        *(F.col(k).cast("int").alias(f"y_{name}") for k, name in (("correction", "user_correction"), ("positive", "positive_completion"), ("negative", "negative_completion"), ("noop", "noop_success"))),
        *(c.alias(k) for k, c in eligibility(F.col("v.label"), F.col("v.confidence")).items()),
    )


# What a manual judgment scores (one that cannot be judged has none), the samples, and the reason of a default judgment
SAMPLES = ("all_proxy_unknown", "model_proxy_check")
DEFAULT_REASON = "manual review found a completed action or task-valid silent/no-op outcome in observable history"
REVIEW_SCORES = {"SUCCESS": 1.0, "PARTIAL": 0.5, "FAILURE": 0.0, "UNJUDGEABLE": None}


def judged(evaluation: DataFrame, lines: DataFrame, chunk: str, expected: int = 0) -> DataFrame:
    """Manual judgments of one chunk: trajectory_id, review_label, review_score, review_confidence, review_reason and sample.

    All its UNKNOWN rows count, with SUCCESS and medium confidence where lines (source_line, label, confidence, reason) does not say
    otherwise, and the other rows that lines names. Another number of rows than expected (0: any) is an error, as is another label.
    """
    own = evaluation.where(F.col("source_chunk") == chunk).select("trajectory_id", F.col("source_line").cast("int").alias("line"), (F.col("y_outcome_label") == "UNKNOWN").alias("unknown"))
    said = lines.select(F.col("source_line").cast("int").alias("said_line"), F.col("label").alias("review_label"), F.col("confidence").alias("review_confidence"), F.col("reason").alias("review_reason"))
    rows = own.join(said, own["line"] == said["said_line"], "left").where("unknown or said_line is not null")
    default = {"review_label": "SUCCESS", "review_confidence": "medium", "review_reason": DEFAULT_REASON}
    rows = rows.withColumns({k: F.when(F.col("said_line").isNull(), F.lit(v)).otherwise(F.col(k)) for k, v in default.items()})
    found = rows.count() if expected else 0
    if found != expected:
        raise ValueError(f"expected {expected} reviewed rows, found {found}")
    score = F.raise_error(F.concat(F.lit("unknown judgment "), F.coalesce("review_label", F.lit("null")))).cast("double")
    for k, v in REVIEW_SCORES.items():
        score = F.when(F.col("review_label") == k, F.lit(v).cast("double")).otherwise(score)
    return rows.select("trajectory_id", "review_label", score.alias("review_score"), "review_confidence", "review_reason", F.when(F.col("unknown"), SAMPLES[0]).otherwise(SAMPLES[1]).alias("sample"))


def calibration_counts(reviewed: DataFrame) -> DataFrame:
    """One row of counts over judgments (review_label, sample): reviewed, by sample, judgeable, by label, and what the proxy checks found."""
    label, check = F.col("review_label"), F.col("sample") == SAMPLES[1]
    fine = label != "UNJUDGEABLE"
    return reviewed.agg(
        F.count("*").alias("reviewed"),
        *(F.count_if(F.col("sample") == k).alias(k) for k in SAMPLES),
        F.count_if(fine).alias("judgeable"),
        *(F.count_if(label == k).alias(k.lower()) for k in REVIEW_SCORES),
        F.count_if(check & fine).alias("proxy_judgeable"),
        F.count_if(check & (label == "FAILURE")).alias("proxy_false_positive"),
        F.count_if(check & (label == "PARTIAL")).alias("proxy_partial"),
    )


def calibrate(evaluation: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """evaluation with a review's label, score and confidence where there is one (its null score too), else telemetry's.

    reviews: key, review_label, review_score, review_confidence.
    """
    r = reviews.withColumnRenamed(key, "review_key")
    joined = evaluation.join(r, evaluation[key] == r["review_key"], "left")
    reviewed = F.col("review_key").isNotNull()
    pick = lambda a, b: F.when(reviewed, F.col(a)).otherwise(F.col(b))
    out = joined.withColumns({"evaluation_outcome_label": pick("review_label", "y_outcome_label"), "evaluation_outcome_score": pick("review_score", "y_outcome_score"), "evaluation_label_confidence": pick("review_confidence", "y_label_confidence"), "evaluation_label_source": F.when(reviewed, "manual_review").otherwise("telemetry")})
    return out.withColumn("evaluation_outcome_usable", (~F.col("evaluation_outcome_label").isin("UNKNOWN", "UNJUDGEABLE")).cast("int")).drop("review_key", "review_label", "review_score", "review_confidence")


def friction(errors: Column, unrecovered: Column, correction: Column, duplicates: Column) -> Column:
    return errors + unrecovered + correction + duplicates
