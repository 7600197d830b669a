"""Off-policy evaluation: details of decisions, stabilised doubly-robust values, overlap, guardrails, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.operators import policy, stats

CAPS = [2.0, 5.0, 10.0, 20.0, None]


def details(rows: DataFrame, chosen: Column, propensity: DataFrame, floor: float = policy.PROPENSITY_FLOOR) -> DataFrame:
    """rows with chosen_action, both costs and qualities, the match, its inverse propensity and the residual.

    rows carry candidates, incumbent_action and evaluation_outcome_score.
    """
    r = rows.withColumn("chosen_action", chosen)
    picked, incumbent = policy.candidate(F.col("chosen_action")), policy.candidate(F.col("incumbent_action"))
    r = r.withColumns({"direct_policy_quality": picked["quality"], "policy_cost": picked["cost"], "incumbent_quality": incumbent["quality"], "incumbent_cost": incumbent["cost"], "matched": (F.col("chosen_action") == F.col("incumbent_action")).cast("int")})
    r = policy.with_propensity(r, propensity, "incumbent_action", floor)
    return r.withColumn("inverse_propensity", F.when(F.col("matched") == 1, 1 / F.col("propensity")).otherwise(0.0)).withColumn("residual", F.col("evaluation_outcome_score") - F.col("incumbent_quality"))


def stabilised(weight: Column | None = None) -> dict[str, Column]:
    """Aggregates: raw and clipped self-normalised doubly-robust value, effective sample size, largest weight."""
    w = F.when(F.col("matched") == 1, F.col("inverse_propensity") if weight is None else weight)
    raw = F.avg("direct_policy_quality") + F.coalesce(F.try_divide(F.sum(w * F.col("residual")), F.sum(w)), F.lit(0.0))
    return {
        "dr_raw": raw,
        "dr_value": F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)),
        "ess": F.coalesce(F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w)), F.lit(0.0)),
        "max_weight": F.coalesce(F.max(w), F.lit(0.0)),
    }


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each policy (the columns of ``by``) over details()."""
    s = stabilised()
    saving = F.coalesce(F.try_divide(F.sum("incumbent_cost") - F.sum("policy_cost"), F.sum("incumbent_cost")), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum((F.col("chosen_action") != F.col("incumbent_action")).cast("long")).alias("changed_routes"),
        F.avg("evaluation_outcome_score").alias("observed_quality"),
        F.avg("direct_policy_quality").alias("direct_quality"),
        s["dr_value"].alias("dr_quality"),
        (s["dr_value"] - F.avg("evaluation_outcome_score")).alias("dr_delta"),
        s["ess"].alias("ess"),
        F.sum("matched").alias("matched_actions"),
        F.sum("incumbent_cost").alias("incumbent_cost"),
        F.sum("policy_cost").alias("policy_cost"),
        saving.alias("savings"),
    )


def prediction_errors(rows: DataFrame, observed: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(observed)
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("brier"), stats.correlation(F.col(observed), F.col(predicted)).alias("correlation"), F.avg(observed).alias("prevalence"))


def feasible(frontier: DataFrame, loss: float = 0.02, direct_loss: float = 0.02, least_ess: float = 0.2) -> DataFrame:
    """The rows of a frontier that keep the guardrails."""
    return frontier.where((F.col("dr_delta") >= -loss) & (F.col("direct_quality") >= F.col("observed_quality") - direct_loss) & (F.col("ess") >= least_ess * F.col("n")) & (F.col("savings") >= 0))


def select_tolerance(frontier: DataFrame, loss: float = 0.02, direct_loss: float = 0.02, least_ess: float = 0.2) -> DataFrame:
    """The feasible tolerance with most savings, the lowest of equals; else the one with the best delta, then savings."""
    ok = feasible(frontier, loss, direct_loss, least_ess).agg(F.max_by("tolerance", F.struct("savings", -F.col("tolerance"))).alias("best"))
    other = frontier.agg(F.max_by("tolerance", F.struct("dr_delta", "savings", -F.col("tolerance"))).alias("fallback"))
    return ok.crossJoin(other).select(F.coalesce("best", "fallback").alias("tolerance"), F.col("best").isNotNull().alias("feasible"))


def bootstrap_delta(rows: DataFrame, key: str, iterations: int, seed: int, draw=stats.resampled) -> DataFrame:
    """iteration and delta (stabilised value less observed quality) of bootstrap samples, see stats.resampled and stats.bootstrap."""
    w = F.when(F.col("matched") == 1, F.col("inverse_propensity")).otherwise(0.0)
    b = draw(rows, key, iterations, seed, {"direct": F.col("direct_policy_quality"), "weight": w, "weighted": w * F.coalesce("residual", F.lit(0.0)), "observed": F.col("evaluation_outcome_score")})
    return b.select("iteration", _delta(*(F.col(k) for k in ("direct", "weight", "weighted", "observed"))).alias("delta"))


def _delta(direct: Column, weight: Column, weighted: Column, observed: Column) -> Column:
    raw = direct / F.col("n__") + F.coalesce(F.try_divide(weighted, weight), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)) - observed / F.col("n__")


def bootstrap_intervals(rows: DataFrame, key: str, policies: list[str], iterations: int, seed: int) -> DataFrame:
    """policy, ci_low and ci_high of each policy's delta over details() of a few policies: the same samples of rows for all of them."""
    w = F.when(F.col("matched") == 1, F.col("inverse_propensity")).otherwise(0.0)
    parts = {"direct": F.col("direct_policy_quality"), "weight": w, "weighted": w * F.coalesce("residual", F.lit(0.0)), "observed": F.col("evaluation_outcome_score")}
    wide = rows.groupBy(key).agg(*(F.sum(F.when(F.col("policy") == p, c)).alias(f"{k}_{j}") for j, p in enumerate(policies) for k, c in parts.items()))
    b = stats.bootstrap(wide, key, iterations, seed, {f"{k}_{j}": F.col(f"{k}_{j}") for j in range(len(policies)) for k in parts})
    deltas = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), _delta(*(F.col(f"{k}_{j}") for k in parts)).alias("delta")) for j, p in enumerate(policies)))).alias("d")
    return b.select(deltas).select("d.*").groupBy("policy").agg(F.percentile("delta", F.lit(0.025)).alias("ci_low"), F.percentile("delta", F.lit(0.975)).alias("ci_high"))


def route_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and route_counts: how often each action is chosen, as canonical JSON."""
    counted = rows.groupBy(*by, "chosen_action").agg(F.count("*").alias("n"))  # a row for each action
    entries = F.array_sort(F.collect_list(F.concat(F.lit('"'), "chosen_action", F.lit('": '), F.col("n").cast("string"))))
    return counted.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).alias("route_counts"))


def summary(rows: DataFrame, key: str, tolerance: float, iterations: int, seed: int) -> dict:
    """What a held-out set says of the estimators and of one policy, over its details(): errors, risk scores, routes, qualities, costs."""
    errors = prediction_errors(rows, "workload_target", "predicted_complexity").first()
    risk = prediction_errors(rows, "risk_target", "predicted_risk").first()
    m = metrics(rows, ["policy"]).join(route_counts(rows, ["policy"]), "policy").first()
    ci = stats.interval(bootstrap_delta(rows, key, iterations, seed, stats.bootstrap), "delta").first()
    raw = rows.agg(stabilised()["dr_raw"].alias("raw")).first()["raw"]
    return {
        "quality_tolerance": tolerance, "holdout_n": m["n"], "complexity_mae": errors["mae"], "complexity_rmse": errors["rmse"], "complexity_correlation": errors["correlation"],
        "execution_risk_prevalence": risk["prevalence"], "execution_risk_brier": risk["brier"], "execution_risk_auc": stats.auc(rows, "risk_target", "predicted_risk").first()["auc"],
        "changed_routes": m["changed_routes"], "route_counts": m["route_counts"], "observed_quality": m["observed_quality"], "direct_policy_quality": m["direct_quality"],
        "dr_policy_quality": m["dr_quality"], "dr_policy_quality_unbounded": raw, "dr_quality_delta": m["dr_delta"], "dr_quality_delta_ci_low": ci["ci_low"], "dr_quality_delta_ci_high": ci["ci_high"],
        "matched_actions": m["matched_actions"], "overlap_effective_sample_size": m["ess"], "incumbent_opening_cost_usd_est": m["incumbent_cost"], "policy_opening_cost_usd_est": m["policy_cost"], "cost_savings_pct_est": m["savings"],
    }
