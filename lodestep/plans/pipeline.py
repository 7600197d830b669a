"""The whole way from request logs to an evaluated policy, of the same operators as the queries.

load -> audit -> features -> outcomes -> calibrate -> train -> route -> evaluate. Tables are DataFrames; what is fitted is an
``Artifact`` of plain values that goes along in expressions and as JSON; only its support grows with the logs, and is a table where large.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions.money import PROFILES, canonical_action
from lodestep.operators import evaluation, fit, outcomes, policy, stats, trajectory
from lodestep.session import new_path, stash
from lodestep.sources import traces

KEYS = ["source_chunk", "source_line"]
# Fixed values
WORKLOAD = {"continuation_tokens": 0.50, "tool_calls": 0.30, "distinct_tools": 0.20}
OPENING = "x_total_context_tokens_est x_task_text_tokens_est x_input_items x_user_messages x_image_parts x_available_tools x_question_marks x_instruction_markers x_is_scheduled x_is_communication x_is_coding x_is_artifact x_is_research x_is_correction x_requires_multiple_steps x_requires_external_action x_high_risk_language x_available_communication_tools x_available_file_tools x_available_code_tools x_available_research_tools x_available_media_tools x_available_write_tools".split()
LOGGED = ["x_total_context_tokens_est", "x_task_text_tokens_est"]
QUALITY = "x_is_scheduled x_is_communication x_is_coding x_is_artifact x_is_research x_requires_multiple_steps x_requires_external_action x_high_risk_language x_has_image x_available_tools".split()
RISKS = ["0", "1", "2", "3"]
STAGE_ONE_PENALTY, QUALITY_PENALTY, TEXT_FEATURES, FOLDS, QUALITY_FOLDS, BOOTSTRAP, SEED = 150.0, 15.0, 96, 5, 5, 2000, 20260822
#: Support rows that an artifact holds itself.
SUPPORT_ROWS = 20_000


@dataclass
class Options:
    """What training and evaluation may be told."""

    validation_share: float = 0.2
    test_share: float = 0.2
    stage_one_penalty: float = STAGE_ONE_PENALTY
    quality_penalty: float = QUALITY_PENALTY
    text_features: int = TEXT_FEATURES
    folds: int = FOLDS
    tolerances: list[float] = field(default_factory=lambda: list(policy.TOLERANCES))
    quality_loss: float = 0.02
    direct_loss: float = 0.02
    ess_share: float = 0.2
    caliper_quantile: float = policy.CALIPER_QUANTILE
    min_stratum: int = policy.MIN_STRATUM
    fallback: str = policy.FALLBACK
    floor: float = policy.PROPENSITY_FLOOR
    bootstrap: int = BOOTSTRAP
    seed: int = SEED
    profiles: list[dict] | None = None  # other than those of money, as policy.profile_table has them
    prices: list | None = None  # other than those of money, as rows of money.PRICES


@dataclass
class Logs:
    requests: DataFrame
    items: DataFrame


def load(spark: SparkSession, folder: str) -> Logs:
    """Requests (with group_id and the first user text) and items of the folder's JSON lines files, parsed once."""
    lines = traces.read_lines(spark, folder)
    items, requests = stash(traces.items(lines), "items"), stash(traces.requests(lines), "requests")
    own = F.col("is_object")
    openings = items.groupBy(*KEYS).agg(*(trajectory.first_text(F.col("opening_text"), F.col("pos"), own & (F.col("role") == r)).alias(f"first_{r}") for r in ("system", "user")))
    r = requests.join(openings, KEYS, "left").na.fill("", ["first_system", "first_user"])
    return Logs(r.withColumn("group_id", trajectory.group_key(F.col("first_system"), F.col("first_user"))), items)


def audit(logs: Logs) -> tuple[DataFrame, DataFrame]:
    """The audit of groups with several requests (ambiguous ones are marked), and overrides that split the others."""
    of = F.concat_ws(":", "source_line", "source_chunk")
    fields = ["type", "role", "name", "call_id", "content_text", "arguments", "output"]
    r = logs.requests.withColumn("history", of)
    ordered = trajectory.with_previous(trajectory.call_order(r, "group_id", *KEYS), "group_id", "call_index")
    pairs = ordered.select("group_id", "history", "n_items", "previous_history", "previous_items")
    items = logs.items.select(of.alias("history"), "pos", F.lit(0).alias("tokens"), F.xxhash64(*fields).alias("h1"), F.xxhash64(F.lit(1), *fields).alias("h2"))
    shared = trajectory.shared_lengths(pairs, trajectory.prefixes(items, ["h1", "h2"]))
    chain = shared.groupBy("group_id").agg(F.coalesce(F.bool_and(F.col("shared") == F.col("previous_items")), F.lit(True)).alias("chain"))
    a = trajectory.audit(r, "group_id", "model", "first_user").join(chain, "group_id")
    ambiguous = (F.col("full_first_user_unique") == 1) | F.col("chain")
    # The reasons below
    reason = F.concat(F.lit("full opening messages differ; no exact growing-history prefix"), F.when(F.col("mixed_models") == 1, "; mixed logged models violate the confirmed trajectory premise").otherwise(""))
    a = a.select(F.col("group_id").alias("original_group_id"), "request_count", "models", "mixed_models", "full_first_user_unique", "common_first_user_prefix_chars", F.col("chain").cast("int").alias("exact_item_prefix_chain"), F.when(ambiguous, "manual_review").otherwise("split_all_requests").alias("decision"), F.when(ambiguous, "low").otherwise("high").alias("confidence"), F.when(ambiguous, "ambiguous candidate group").otherwise(reason).alias("reason"))
    return a, a.where("decision = 'split_all_requests'").select("original_group_id", "decision", "confidence", "reason")


def features(logs: Logs, overrides: DataFrame | None = None, scope: str = "trajectory") -> DataFrame:
    """The feature table: of each trajectory's first request's opening, or of every call's whole input (scope call)."""
    spark = logs.requests.sparkSession
    o = overrides if overrides is not None else spark.createDataFrame([], "original_group_id string, decision string")
    split = trajectory.split_groups(logs.requests, o)
    ordered = trajectory.call_order(split, "trajectory_id", *KEYS)
    per = ordered.groupBy("trajectory_id").agg(F.count("*").alias("observed_calls"), F.array_join(F.sort_array(F.collect_set("model")), "|").alias("logged_models_in_group"))
    chosen = ordered if scope == "call" else ordered.where("call_index = 0")
    base = chosen.join(per, "trajectory_id").select("trajectory_id", F.col("group_id").alias("original_group_id"), "call_index", *KEYS, "logged_models_in_group", "observed_calls", "grouping_status")
    base = base.withColumn("eligible_for_modeling", trajectory.eligible(F.col("grouping_status"))).withColumn("needs_manual_group_review", 1 - F.col("eligible_for_modeling"))
    seen = trajectory.opening_features(logs.requests, logs.items, openings=scope != "call").drop("request_items")
    return base.join(seen, KEYS).join(prior_calls(logs.items, scope != "call"), KEYS, "left").na.fill(0)


def prior_calls(items: DataFrame, openings: bool) -> DataFrame:
    """x_prior_ columns: calls, names, errors and repeated calls in the features' input. Openings hold no calls by definition."""
    if openings:
        items = items.join(trajectory.opening_lengths(items, KEYS).select(*KEYS, "opening_len"), KEYS).where("pos < opening_len")
    calls = items.where(F.col("type").isin(traces.CALL_TYPES)).select(*KEYS, "pos", "call_id", "name", "arguments")
    outputs = items.where(F.col("type").isin(traces.OUTPUT_TYPES)).select(*KEYS, "pos", "call_id", "output")
    c = outcomes.with_outputs(calls, outputs, KEYS)
    c = c.select(*KEYS, "name", outcomes.canonical_arguments("arguments").alias("arguments"), outcomes.output_failed("output").alias("failed"))
    d = outcomes.duplicate_surplus(c, KEYS)
    return d.select(*KEYS, F.col("calls").alias("x_prior_tool_calls"), F.col("names").alias("x_prior_unique_tools"), F.col("errors").alias("x_prior_tool_errors"), F.col("duplicates").alias("x_prior_exact_duplicate_calls"))


def evaluation_table(logs: Logs, feature_table: DataFrame) -> DataFrame:
    """feature_table with the outcome columns of its requests; a request that is missing from the logs is an error."""
    found = outcomes.outcome_features(logs.items)
    joined = feature_table.join(found.withColumn("found__", F.lit(True)), KEYS, "left")
    known = logs.requests.select(*KEYS, F.lit(True).alias("known__"))
    joined = joined.join(known, KEYS, "left")
    checked = joined.withColumn("known__", F.when(F.col("known__"), True).otherwise(F.raise_error("a feature row has no request").cast("boolean")))
    return checked.where("known__").drop("known__", "found__").na.fill("UNKNOWN", ["y_outcome_label"]).na.fill(0)


def reviews(logs: Logs, judgments: DataFrame) -> DataFrame:
    """judgments (with KEYS) and what a reviewer sees: ends of the opening's routing text and of the last tool output, start of the last assistant text.

    Texts are looked up for the judged requests alone; a request that is missing from the logs has empty ones.
    """
    asked = judgments.select(*KEYS).distinct()
    items = logs.items.join(asked, KEYS, "left_semi")
    opened = items.join(trajectory.opening_lengths(items, KEYS).select(*KEYS, "opening_len"), KEYS)
    own = F.col("is_object")
    task = trajectory.joined_text(F.col("content_text"), F.col("pos"), own & (F.col("pos") < F.col("opening_len")) & (F.col("role") == "user"))
    later = own & (F.col("pos") >= F.col("opening_len"))
    answer = outcomes.last_text(F.col("content_text"), F.col("pos"), later & (F.col("role") == "assistant"))
    output = later & F.col("type").isin(traces.OUTPUT_TYPES)
    last = F.coalesce(F.max_by(F.when(output, F.col("output_text")), F.when(output, F.col("pos"))), F.lit(""))
    e = opened.groupBy(*KEYS).agg(task.alias("t"), answer.alias("a"), last.alias("o"))
    cut = {"review_task_excerpt": F.right(T.routing_text(F.col("t")), F.lit(700)), "review_final_assistant_excerpt": F.left("a", F.lit(1200)), "review_last_tool_output_excerpt": F.right("o", F.lit(1200))}
    return judgments.join(e.select(*KEYS, *(c.alias(k) for k, c in cut.items())), KEYS, "left").na.fill("", list(cut))


def modelling_rows(logs: Logs, calibrated: DataFrame) -> DataFrame:
    """Usable rows with workload and friction signals, terms and the template key."""
    calls = logs.items.where(F.col("type").isin(traces.CALL_TYPES)).groupBy(*KEYS).agg(F.count_distinct(F.coalesce("name", F.lit("unknown"))).alias("distinct_tools"))
    full = logs.items.groupBy(*KEYS).agg(F.floor((2 * F.count("*") + F.sum("chars")) / 4).alias("full_tokens"))
    rows = calibrated.where("evaluation_outcome_usable = 1").join(full, KEYS, "left").join(calls, KEYS, "left").na.fill(0, ["full_tokens", "distinct_tools"])
    rows = rows.withColumns({
        "continuation_tokens": F.greatest(F.lit(0.0), F.col("full_tokens") - F.col("x_input_tokens_est")).cast("double"),
        "tool_calls": F.col("y_observed_tool_calls").cast("double"),
        "distinct_tools": F.col("distinct_tools").cast("double"),
        "friction": outcomes.friction(F.col("y_tool_errors"), F.col("y_unrecovered_tool_errors"), F.col("y_user_correction"), F.col("y_duplicate_successful_side_effects")),
    })
    return prepared(rows.withColumn("risk_target", (F.col("friction") > 0).cast("double")))


def prepared(rows: DataFrame) -> DataFrame:
    """rows with the columns that scoring needs: action, terms, template key and numbers."""
    m = T.model_text(F.when(F.coalesce("x_task_text_sanitized", F.lit("")) != "", F.col("x_task_text_sanitized")).otherwise(F.col("task_preview")))
    rows = rows.withColumn("model_text", m).withColumn("incumbent_action", canonical_action(F.col("logged_model")))
    numbers = {f"n_{f}": F.log1p(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) if f in LOGGED else F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in OPENING}
    return rows.withColumns({"terms": T.terms(F.col("model_text")), "template": T.template_key(F.col("model_text")), **numbers})


@dataclass
class Encoder:
    means: dict[str, float]
    scales: dict[str, float]
    vocabulary: list[str] = field(default_factory=list)
    idf: list[float] = field(default_factory=list)
    text_means: list[float] = field(default_factory=list)
    text_scales: list[float] = field(default_factory=list)

    def text(self) -> Column:
        """Sub-linear TF-IDF over the vocabulary, of length 1 or all zero; in the row, without a join."""
        terms = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(i)).alias("idf")) for t, i in zip(self.vocabulary, self.idf, strict=True)))
        # a text's terms are met once; what is counted for each term of the vocabulary are the few that it has
        known = F.filter("terms", lambda t: t.isin(self.vocabulary))
        weights = T.let(known, lambda own: F.transform(terms, lambda v: T.let(F.size(F.filter(own, lambda t: t == v["t"])), lambda n: F.when(n > 0, (1 + F.log(n.cast("double"))) * v["idf"]).otherwise(0.0))))
        return T.let(weights, self._unit)

    @staticmethod
    def _unit(weights: Column) -> Column:
        norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x * x))
        return T.let(norm, lambda n: F.transform(weights, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    def vector(self) -> Column:
        numeric = [(F.col(f"n_{f}") - self.means[f]) / self.scales[f] for f in OPENING]
        hot = [(F.col("x_task_category") == c).cast("double") for c in T.CATEGORIES] + [(F.col("x_risk_level").cast("string") == r).cast("double") for r in RISKS]
        whole = F.array(F.lit(1.0), *numeric, *hot)
        if not self.vocabulary:
            return whole
        scale = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(self.text_means, self.text_scales, strict=True)))
        return F.concat(whole, F.zip_with("text_vector", scale, lambda x, p: (x - p["m"]) / p["s"]))

    def encode(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("text_vector", self.text()) if self.vocabulary else rows
        return rows.withColumn("vector", self.vector()).drop("text_vector")


def fit_encoder(rows: DataFrame, text_features: int = TEXT_FEATURES) -> Encoder:
    m = rows.agg(F.count("*").alias("rows"), *(F.avg(f"n_{f}").alias(f"m_{f}") for f in OPENING), *(stats.zscale(f"n_{f}").alias(f"s_{f}") for f in OPENING)).first()
    e = Encoder({f: m[f"m_{f}"] for f in OPENING}, {f: m[f"s_{f}"] for f in OPENING})
    vocab = fit.vocabulary(rows, "terms", m["rows"], text_features).collect()
    e.vocabulary, e.idf = [r["term"] for r in vocab], [r["idf"] for r in vocab]
    if vocab:
        w = rows.select(F.posexplode(e.text()).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), stats.zscale("x").alias("s")).orderBy("k").collect()
        e.text_means, e.text_scales = [r["m"] for r in w], [r["s"] for r in w]
    return e


def _dot(coefficients: list[float], vector: str = "vector") -> Column:
    c = F.array(*(F.lit(float(x)) for x in coefficients))
    return F.aggregate(F.zip_with(vector, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _clip(x: Column, top: float) -> Column:
    return F.least(F.lit(top), F.greatest(F.lit(0.0), x))


@dataclass
class Artifact:
    encoder: Encoder
    workload: list[float]
    risk: list[float]
    workload_blocks: list[tuple[float, float]] = field(default_factory=list)
    risk_blocks: list[tuple[float, float]] = field(default_factory=list)
    block_paths: dict[str, str] = field(default_factory=dict)  # tables of the blocks, where there are more than stats.STEPS
    quality: list[float] = field(default_factory=list)
    quality_means: list[float] = field(default_factory=list)
    quality_scales: list[float] = field(default_factory=list)
    slope: float = 0.0
    losses: dict[str, float] = field(default_factory=dict)
    support: list[tuple[str, str, str, list[float]]] = field(default_factory=list)  # action, stratum, id, features
    support_path: str | None = None  # a table of the same, where there are more than SUPPORT_ROWS
    calipers: dict[str, float] = field(default_factory=dict)
    propensities: list[tuple[str, str, float]] = field(default_factory=list)
    tolerance: float = 0.025
    min_stratum: int = policy.MIN_STRATUM
    fallback: str = policy.FALLBACK
    floor: float = policy.PROPENSITY_FLOOR
    profiles: list[dict] = field(default_factory=policy.profile_table)
    prices: list | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Artifact:
        d = json.loads(text)
        return Artifact(**d | {"encoder": Encoder(**d["encoder"])})

    def keep_support(self, table: DataFrame, path: str | None = None) -> None:
        """All rows of policy.support_table(): in the artifact up to SUPPORT_ROWS, beyond that as a table at path or in the shared folder."""
        if table.count() <= SUPPORT_ROWS:
            self.support, self.support_path = [tuple(r) for r in table.select("action", "key", "id", "x").collect()], None
            return
        path = path or new_path(table.sparkSession, "support")
        table.write.mode("overwrite").parquet(path)
        self.support, self.support_path = [], path

    def support_rows(self, spark: SparkSession) -> DataFrame:
        schema = "action string, key string, id string, x array<double>"
        return spark.read.schema(schema).parquet(self.support_path) if self.support_path else spark.createDataFrame(self.support, schema)

    def stage_one(self, rows: DataFrame) -> DataFrame:
        """rows with predicted_complexity (0 to 100) and predicted_risk (0 to 1)."""
        e = self.encoder.encode(rows).withColumns({"predicted_complexity": _clip(_dot(self.workload), 100.0), "predicted_risk": _clip(_dot(self.risk), 1.0)}).drop("vector")
        e = self.calibrated(e, {"predicted_complexity": "predicted_complexity", "predicted_risk": "predicted_risk"})
        return e.withColumns({"predicted_complexity": _clip(F.col("predicted_complexity"), 100.0), "predicted_risk": _clip(F.col("predicted_risk"), 1.0)})

    def keep_blocks(self, name: str, blocks: DataFrame) -> None:
        """The steps of one calibration (workload or risk): in the artifact up to stats.STEPS, beyond that as a table."""
        few = blocks.limit(stats.STEPS + 1).collect()
        if len(few) <= stats.STEPS:
            setattr(self, f"{name}_blocks", sorted(map(tuple, few)))
        else:
            self.block_paths[name] = new_path(blocks.sparkSession, f"{name}-blocks")
            blocks.write.parquet(self.block_paths[name])

    def calibrated(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """rows with calibrated predictions: columns are those of the raw workload and risk, and what the results are called."""
        for name, (raw, out) in zip(("workload", "risk"), columns.items(), strict=True):
            if name in self.block_paths:
                steps = rows.sparkSession.read.schema("upper double, value double").parquet(self.block_paths[name])
                rows = stats.step_lookup(rows, raw, steps, "step__").withColumn(out, F.col("step__")).drop("step__")
            else:
                rows = rows.withColumn(out, stats.step(F.col(raw), getattr(self, f"{name}_blocks")))
        return rows

    def base_quality(self) -> Column:
        scaled = F.array(F.lit(1.0), *((x - m) / s for x, m, s in zip(_quality_terms(), self.quality_means, self.quality_scales, strict=True)))
        return F.aggregate(F.zip_with(scaled, F.array(*(F.lit(float(c)) for c in self.quality)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def supported(self, rows: DataFrame) -> DataFrame:
        """rows with supported: the actions with enough support near enough."""
        spark = rows.sparkSession
        near = policy.nearest(rows, self.support_rows(spark), [f"n_{f}" for f in OPENING], {f"n_{f}": self.encoder.scales[f] for f in OPENING})
        caliper = spark.createDataFrame(list(self.calipers.items()), "action string, caliper double")
        return rows.join(policy.supported_actions(near, caliper, self.min_stratum), "trajectory_id", "left").withColumn("supported", F.coalesce("supported", F.array().cast("array<string>")))

    def priced(self, rows: DataFrame) -> DataFrame:
        """rows (stage_one and supported done) with their candidates."""
        return policy.candidates(rows, self.base_quality(), self.slope, F.col("supported"), profiles=self.profiles, prices=self.prices)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """rows (stage_one done) with supported and their candidates."""
        return self.priced(self.supported(rows))

    def propensity_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.propensities, "exact_key string, action string, propensity double")


def _quality_terms() -> list[Column]:
    """The quality model's features, by name."""
    named = {"predicted_complexity": F.col("predicted_complexity") / 100.0, "predicted_execution_risk": F.col("predicted_risk")}
    named |= {q: F.coalesce(F.col(q).cast("double"), F.lit(0.0)) for q in QUALITY}
    named |= {f"category_{c}": (F.col("x_task_category") == c).cast("double") for c in T.CATEGORIES}
    named |= {f"risk_{r}": (F.col("x_risk_level").cast("string") == r).cast("double") for r in RISKS}
    return [named[k] for k in sorted(named)]


def with_targets(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """rows with workload_target: percentiles of each signal among the reference rows, weighted."""
    out = rows.withColumn("workload_target", F.lit(0.0))
    for signal, weight in WORKLOAD.items():
        out = stats.ranks_among(out, reference, signal, "below__").withColumn("workload_target", F.col("workload_target") + 100 * weight * F.col("below__")).drop("below__")
    return out


def fit_stage_one(rows: DataFrame, penalty: float = STAGE_ONE_PENALTY, text_features: int = TEXT_FEATURES) -> Artifact:
    e = fit_encoder(rows, text_features)
    c = fit.ridge(e.encode(rows), "vector", ["workload_target", "risk_target"], penalty)
    return Artifact(e, c[:, 0].tolist(), c[:, 1].tolist())


def out_of_fold(rows: DataFrame, o: Options) -> DataFrame:
    """rows with stage-one predictions of models that did not see their fold; encoders are fitted anew for each fold."""
    folded = stash(fit.grouped_folds(rows, "template", o.folds, "oof_fold"), "folds")
    parts = []
    for k in range(o.folds):
        train, held = folded.where(F.col("oof_fold") != k), folded.where(F.col("oof_fold") == k)
        if train.isEmpty() or held.isEmpty():
            continue
        parts.append(fit_stage_one(train, o.stage_one_penalty, o.text_features).stage_one(held))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stash(out.withColumnsRenamed({"predicted_complexity": "oof_complexity", "predicted_risk": "oof_risk"}).drop("oof_fold"), "out-of-fold")


def _calibrated_rows(rows: DataFrame, a: Artifact) -> DataFrame:
    return a.calibrated(rows, {"oof_complexity": "predicted_complexity", "oof_risk": "predicted_risk"})


def fit_quality(a: Artifact, own: DataFrame, o: Options, scenario: str = "base") -> Artifact:
    """a with the quality model that a scenario's profiles give: capabilities, slope and coefficients are fitted anew.

    own: the rows with calibrated out-of-fold predictions and quality_fold.
    """
    a = replace(a, profiles=policy.profile_table(scenario, o.profiles), prices=o.prices)
    own = policy.candidates(own, F.lit(0.0), 0.0, profiles=a.profiles, prices=a.prices).withColumn("capability", policy.candidate(F.col("incumbent_action"))["fit"]).drop("candidates")
    names = [f"q{k}" for k in range(len(_quality_terms()))]
    own = own.withColumns(dict(zip(names, _quality_terms(), strict=True)))
    a.slope, losses = fit.cross_validated_slope(own, names, "quality_fold", "evaluation_outcome_score", "capability", o.quality_penalty)
    a.losses = {str(k): v for k, v in losses.items()}
    m = own.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(stats.zscale(n).alias(f"s_{n}") for n in names)).first()
    a.quality_means, a.quality_scales = [m[f"m_{n}"] for n in names], [m[f"s_{n}"] for n in names]
    vector = F.array(F.lit(1.0), *((F.col(n) - x) / y for n, x, y in zip(names, a.quality_means, a.quality_scales, strict=True)))
    target = own.withColumn("target", F.col("evaluation_outcome_score") - a.slope * (F.col("capability") - fit.REFERENCE_CAPABILITY))
    a.quality = fit.ridge(target.withColumn("vector", vector), "vector", ["target"], o.quality_penalty)[:, 0].tolist()
    return a


def quality_rows(rows: DataFrame, a: Artifact) -> DataFrame:
    return stash(fit.grouped_folds(_calibrated_rows(rows.drop("terms"), a), "template", QUALITY_FOLDS, "quality_fold"), "quality-rows")


def fit_artifact(rows: DataFrame, o: Options, scenario: str = "base") -> Artifact:
    """All fits over rows that out_of_fold() gave."""
    a = fit_stage_one(rows, o.stage_one_penalty, o.text_features)
    a.min_stratum, a.fallback, a.floor = o.min_stratum, o.fallback, o.floor
    a.keep_blocks("workload", fit.isotonic(rows, "oof_complexity", "workload_target"))
    a.keep_blocks("risk", fit.isotonic(rows, "oof_risk", "risk_target"))
    own = quality_rows(rows, a)
    a = fit_quality(a, own, o, scenario)
    cols, scales = [f"n_{f}" for f in OPENING], {f"n_{f}": a.encoder.scales[f] for f in OPENING}
    support = stash(policy.support_table(own, cols), "support")
    a.keep_support(support)
    found = {r["action"]: r["caliper"] for r in policy.calipers(own, support, cols, scales, o.caliper_quantile).collect()}
    a.calipers = {r[0]: found.get(r[0]) or 0.0 for r in support.select("action").distinct().collect()}
    a.propensities = [tuple(r) for r in policy.propensities(own).collect()]
    return a


def placed(rows: DataFrame, a: Artifact) -> DataFrame:
    """rows with stage one's predictions and supported, as a table: what all of an artifact's scenarios have in common."""
    return stash(a.supported(a.stage_one(rows)), "placed")


def scored_policies(rows: DataFrame, a: Artifact, tolerances: list[float] | None = None) -> DataFrame:
    """Details of the learned policy at each tolerance, the heuristic and the incumbent, over rows that placed() gave."""
    spark = rows.sparkSession
    c = stash(a.priced(rows), "candidates")
    ways = [F.struct(F.lit(f"learned_{t:.3f}").alias("policy"), F.lit(t).alias("tolerance"), policy.choose(F.lit(t), a.fallback).alias("action")) for t in tolerances or policy.TOLERANCES]
    ways += [F.struct(F.lit(k).alias("policy"), F.lit(None).cast("double").alias("tolerance"), v.alias("action")) for k, v in (("heuristic", policy.heuristic()), ("incumbent", F.col("incumbent_action")))]
    wide = c.withColumn("way", F.explode(F.array(*ways))).select("*", "way.policy", "way.tolerance", F.col("way.action").alias("picked"))
    return evaluation.details(wide, F.col("picked"), a.propensity_table(spark), a.floor)


@dataclass
class Training:
    artifact: Artifact
    tolerance: float
    feasible: bool
    frontier: DataFrame
    test: DataFrame
    test_metrics: DataFrame
    summary: dict
    decisions: DataFrame
    complexity: DataFrame


def fitted(rows: DataFrame, o: Options) -> Artifact:
    """The whole chain of fits: targets, out-of-fold stage one, calibration, quality, support, propensities."""
    return fit_artifact(out_of_fold(with_targets(rows, rows), o), o)


def decisions(details: DataFrame, a: Artifact) -> DataFrame:
    """The details of one policy as an output: predicted beside observed, both costs, and why each action was chosen."""
    model = F.element_at(F.create_map(*(x for p in a.profiles for x in (F.lit(p["action"]), F.lit(p["route_model"])))), F.col("chosen_action"))
    return details.select(
        "trajectory_id", "logged_model", "incumbent_action", "chosen_action", model.alias("chosen_model"), (F.col("chosen_action") != F.col("incumbent_action")).cast("int").alias("changed"),
        policy.decision_reason().alias("decision_reason"), F.round("workload_target", 6).alias("observed_complexity"), F.round("predicted_complexity", 6).alias("predicted_complexity"),
        F.col("risk_target").cast("int").alias("observed_execution_risk"), F.round("predicted_risk", 6).alias("predicted_execution_risk"), F.round("direct_policy_quality", 6).alias("predicted_quality"),
        F.col("evaluation_outcome_score").alias("observed_quality"), "direct_policy_quality", F.col("matched").alias("matched_observed_action"), "inverse_propensity", F.col("residual").alias("outcome_residual"),
        F.col("incumbent_cost").alias("incumbent_opening_cost_usd_est"), F.col("policy_cost").alias("policy_opening_cost_usd_est"), F.array_join("supported", "|").alias("supported_actions"),
    )


def train(rows: DataFrame, o: Options | None = None) -> Training:
    """Splits by template, chooses the tolerance on validation rows, tests once, and fits all rows again."""
    o = o or Options()
    split = stash(fit.three_way(rows, "template", o.validation_share, o.test_share), "split")
    part = lambda *k: split.where(F.col("part").isin(*k)).drop("part")
    first = fitted(part(0), o)
    v = scored_policies(placed(part(1), first), first, o.tolerances)
    frontier = stash(evaluation.metrics(v.where("tolerance is not null"), ["tolerance"]), "frontier")
    chosen = evaluation.select_tolerance(frontier, o.quality_loss, o.direct_loss, o.ess_share).first()
    held = fitted(part(0, 1), o)
    test = stash(scored_policies(placed(with_targets(part(2), part(0, 1)), held), held, o.tolerances), "test")
    own = test.where(F.col("tolerance") == chosen["tolerance"])
    summary = evaluation.summary(own, "trajectory_id", chosen["tolerance"], o.bootstrap, o.seed)
    counts = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    summary |= {f"{name}_n": counts.get(k, 0) for k, name in enumerate(("initial_train", "validation", "test"))}
    everything = fitted(rows, o)
    everything.tolerance = chosen["tolerance"]
    scores = everything.stage_one(with_targets(rows, rows)).select("trajectory_id", "logged_model", F.round("workload_target", 6).alias("observed_complexity"), F.round("predicted_complexity", 6).alias("predicted_complexity"), F.col("risk_target").cast("int").alias("observed_execution_risk"), F.round("predicted_risk", 6).alias("predicted_execution_risk"))
    return Training(everything, chosen["tolerance"], chosen["feasible"], frontier, test, evaluation.metrics(test, ["policy"]), summary, decisions(own, held), scores)


def route(feature_table: DataFrame, a: Artifact) -> DataFrame:
    """The routes of each trajectory's calls: one decision, repeated."""
    rows = a.candidates(a.stage_one(prepared(feature_table)))
    chosen = rows.withColumn("routing_action", policy.choose(F.lit(a.tolerance), a.fallback))
    model = F.element_at(F.create_map(*(x for p in a.profiles for x in (F.lit(p["action"]), F.lit(p["route_model"])))), F.col("routing_action"))
    quality = policy.candidate(F.col("routing_action"))["quality"]
    return chosen.select(F.col("trajectory_id").alias("trajectory"), F.col("observed_calls").alias("n_calls"), F.col("logged_model").alias("incumbent_model"), F.array_repeat(model, F.col("observed_calls").cast("int")).alias("route"), "predicted_complexity", F.col("predicted_risk").alias("predicted_execution_risk"), quality.alias("predicted_quality"), "routing_action", F.col("supported").alias("supported_actions"), policy.decision_reason().alias("decision_reason"))


def route_request(spark: SparkSession, request: dict, a: Artifact) -> dict:
    """The decision for one request: the same functions over one row."""
    if not isinstance(request.get("input"), list) or not isinstance(request.get("tools", []), list):
        raise ValueError("a request has the lists input and tools")
    line = spark.createDataFrame([("request", 1, json.dumps({"model": PROFILES[2][1]} | request))], "source_chunk string, source_line int, request string")
    logs = Logs(traces.requests(line), traces.items(line))
    f = trajectory.opening_features(logs.requests, logs.items).withColumns({"trajectory_id": F.lit("request"), "observed_calls": F.lit(1)})
    return route(f, a).first().asDict()


# Fixed values
SCENARIOS = ["base", "compressed", "expanded", "gpt_sol_luna_swapped"]


@dataclass
class Evaluation:
    comparison: DataFrame
    scenarios: DataFrame
    caps: DataFrame
    tolerance: float
    details: DataFrame


def evaluate(rows: DataFrame, o: Options | None = None, tolerance: float | None = None) -> Evaluation:
    """All policies over test rows that no fit has seen, with intervals; weight caps; and the quality model refitted for each scenario of profiles.

    Rows are split by template. Targets, out-of-fold predictions, calibration, support and propensities come from the train and
    validation rows alone, once; only what depends on profiles is fitted for each scenario. The interval of the incumbent is zero by definition.
    """
    o = o or Options()
    spark = rows.sparkSession
    tolerance = Artifact.tolerance if tolerance is None else tolerance
    tolerances = sorted({*o.tolerances, tolerance})
    name = f"learned_{tolerance:.3f}"
    split = stash(fit.three_way(rows, "template", o.validation_share, o.test_share), "split")
    development, held = split.where("part < 2").drop("part"), split.where("part = 2").drop("part")
    folded = out_of_fold(with_targets(development, development), o)
    a = fit_artifact(folded, o)
    test = placed(with_targets(held, development), a)
    details = stash(scored_policies(test, a, tolerances), "evaluated")

    others = [*(f"learned_{t:.3f}" for t in tolerances), "heuristic"]
    ci = evaluation.bootstrap_intervals(details, "trajectory_id", others, o.bootstrap, o.seed)
    incumbent = F.col("policy") == "incumbent"
    zero = lambda c, x: F.when(incumbent, x).otherwise(F.col(c)).alias(c)
    m = evaluation.metrics(details, ["policy", "tolerance"]).join(evaluation.route_counts(details, ["policy"]), "policy").join(ci, "policy", "left")
    kind = F.when(incumbent, "incumbent").when(F.col("policy") == "heuristic", "heuristic").otherwise("learned")
    comparison = m.select("policy", kind.alias("policy_type"), (F.col("policy") == name).cast("int").alias("validation_selected"), "n", "changed_routes", "incumbent_cost", "policy_cost", "savings", "observed_quality", "direct_quality", zero("dr_quality", F.col("observed_quality")), zero("dr_delta", F.lit(0.0)), zero("ci_low", F.lit(0.0)), zero("ci_high", F.lit(0.0)), "matched_actions", "ess", "route_counts")

    own = details.where(F.col("policy") == name)
    caps = spark.createDataFrame([(f"{c:g}" if c else "unclipped", c) for c in evaluation.CAPS], "weight_cap string, cap double")
    s = evaluation.stabilised(F.least("inverse_propensity", F.coalesce("cap", "inverse_propensity")))
    by_cap = own.crossJoin(F.broadcast(caps)).groupBy("weight_cap").agg(*(c.alias(k) for k, c in s.items()), (s["dr_value"] - F.avg("evaluation_outcome_score")).alias("dr_delta"))

    base = own.select("trajectory_id", F.col("chosen_action").alias("base_action"))
    fitting, parts = quality_rows(folded, a), None
    for scenario in SCENARIOS:
        mine = scored_policies(test, fit_quality(a, fitting, o, scenario), [tolerance]).where(F.col("policy") == name)
        mine = mine.join(base, "trajectory_id").withColumn("scenario", F.lit(scenario))
        parts = mine if parts is None else parts.unionByName(mine)
    parts = stash(parts, "scenarios")
    ci = evaluation.bootstrap_intervals(parts.withColumn("policy", F.col("scenario")), "trajectory_id", SCENARIOS, o.bootstrap, o.seed).withColumnRenamed("policy", "scenario")
    differs = parts.groupBy("scenario").agg(F.avg((F.col("chosen_action") != F.col("base_action")).cast("double")).alias("route_disagreement_vs_base"))
    scenarios = evaluation.metrics(parts, ["scenario"]).join(ci, "scenario").join(differs, "scenario").join(evaluation.route_counts(parts, ["scenario"]), "scenario")
    return Evaluation(stash(comparison, "comparison"), stash(scenarios, "scenario-metrics"), stash(by_cap, "cap-metrics"), tolerance, own)
