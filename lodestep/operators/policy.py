"""Policies: candidates, capability, support, quality, choice, propensities.

The actions are a fixed handful, so a row carries its candidates as an array and chooses among them in place: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.functions.money import DIMENSIONS, PRICES, PROFILES
from lodestep.operators import stats
from lodestep.operators.nearest import Tree, pivot_join
from lodestep.session import ship, stash

# Fixed values
HEURISTIC_TOKENS = 15_000
MIN_STRATUM = 3
CALIPER_QUANTILE = 0.95
PROPENSITY_FLOOR = 0.03
FALLBACK = "sonnet"
TOLERANCES = [0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05]
#: Bytes of support up to which it goes to every task; a larger one is searched in shards.
LOCAL_BYTES = 32 << 20


def exact_key() -> Column:
    return F.concat_ws("|", "x_task_category", F.col("x_risk_level").cast("string"), F.col("x_has_image").cast("string"))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def capability_weights(complexity: Column, risk: Column) -> dict[str, Column]:
    """The weight of each capability for a task."""
    # Fixed values
    return {
        "tool_use": 1.0 + 2.0 * _number("x_requires_external_action"),
        "coding": 1.0 + 3.0 * _number("x_is_coding"),
        "reasoning": 1.0 + 2.0 * complexity / 100.0 + _number("x_is_research"),
        "instruction_following": 1.0 + 2.0 * _number("x_requires_multiple_steps") + _number("x_high_risk_language") + risk,
        "long_context": 1.0 + 2.0 * F.least(F.lit(1.0), _number("x_total_context_tokens_est") / 50_000),
        "multimodal": 0.25 + 3.0 * _number("x_has_image"),
    }


def capability(weights: dict[str, Column], profile: dict[str, float]) -> Column:
    total = sum(weights.values(), F.lit(0.0))
    return sum((weights[d] * F.lit(float(profile[d])) for d in DIMENSIONS), F.lit(0.0)) / total


def profile_table(scenario: str = "base", profiles: list[dict] | None = None) -> list[dict]:
    """The profiles (those of money unless others are given) under a scenario: base, compressed, expanded, or with sol and luna swapped."""
    rows = profiles or [dict(zip(["action", "route_model", "family", *DIMENSIONS], p, strict=True)) | {"ordinal": k} for k, p in enumerate(PROFILES)]
    if scenario in ("compressed", "expanded"):
        by = 0.5 if scenario == "compressed" else 1.25
        return [r | {d: min(1.0, max(0.0, 0.80 + by * (r[d] - 0.80))) for d in DIMENSIONS} for r in rows]
    if scenario == "gpt_sol_luna_swapped":
        named = {r["action"]: r for r in rows}
        other = {"sol": "luna", "luna": "sol"}
        return [r | {d: named[other.get(r["action"], r["action"])][d] for d in DIMENSIONS} for r in rows]
    if scenario != "base":
        raise ValueError(f"unknown scenario {scenario}")
    return rows


def uncached_price(model: str, prices: list | None = None) -> float:
    """As money.prices_of, for the few models of the profiles. prices: rows as those of money.PRICES."""
    prices = prices or PRICES
    own = [p for p in prices if p[0] != "_default" and model.startswith(p[0])]
    return max(own, key=lambda p: (p[0] == model, len(p[0])))[1] if own else next(p[1] for p in prices if p[0] == "_default")


def candidates(rows: DataFrame, base_quality: Column, slope: float, supported: Column | None = None, scenario: str = "base", complexity: str = "predicted_complexity", risk: str = "predicted_risk", profiles: list[dict] | None = None, prices: list | None = None) -> DataFrame:
    """rows with candidates: action, ordinal, fit, quality, cost and supported for each profile.

    supported: an array of actions, or None where all are. profiles and prices: other ones than money's.
    """
    weights = capability_weights(F.col(complexity), F.col(risk))
    made = []
    for p in profile_table(scenario, profiles):
        fit = capability(weights, p)
        quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base_quality + F.lit(slope) * (fit - 0.80)))
        cost = _number("x_total_context_tokens_est") * F.lit(uncached_price(p["route_model"], prices)) / 1_000_000
        ok = F.lit(True) if supported is None else F.array_contains(supported, p["action"])
        made.append(F.struct(F.lit(p["action"]).alias("action"), F.lit(p["ordinal"]).alias("ordinal"), fit.alias("fit"), quality.alias("quality"), cost.alias("cost"), ok.alias("supported")))
    return rows.withColumn("candidates", F.array(*made))


def candidate(action: Column) -> Column:
    """The candidate of an action."""
    return F.get(F.filter("candidates", lambda c: c["action"] == action), F.lit(0))


def choose(tolerance: Column, fallback: str = FALLBACK) -> Column:
    """The cheapest supported candidate within tolerance of the best quality; the fallback where none is supported."""
    open_ = F.filter("candidates", lambda c: c["supported"])
    best = F.array_max(F.transform(open_, lambda c: c["quality"]))
    fine = F.filter(open_, lambda c: c["quality"] >= best - tolerance)
    cheapest = F.array_min(F.transform(fine, lambda c: F.struct(c["cost"].alias("cost"), (-c["quality"]).alias("q"), c["ordinal"].alias("ordinal"), c["action"].alias("action"))))["action"]
    return F.coalesce(cheapest, F.lit(fallback))


def decision_reason() -> Column:
    return F.when(F.exists("candidates", lambda c: c["supported"]), "learned_selection").otherwise("fixed_fallback_no_support")


def heuristic() -> Column:
    """The cheaper action of the incumbent's family for small contexts, where supported."""
    claude = [p[0] for p in PROFILES if p[2] == "claude"]
    target = F.when(F.col("incumbent_action").isin(claude), "sonnet").otherwise("luna")
    may = F.exists("candidates", lambda c: (c["action"] == target) & c["supported"])
    return F.when((_number("x_total_context_tokens_est") < HEURISTIC_TOKENS) & may, target).otherwise(F.col("incumbent_action"))


def propensities(rows: DataFrame) -> DataFrame:
    """exact_key, action and Laplace-smoothed propensity for every action in each stratum that has rows."""
    keyed = rows.select(exact_key().alias("exact_key"), "incumbent_action")
    total = keyed.groupBy("exact_key").agg(F.count("*").alias("n"), *(F.count_if(F.col("incumbent_action") == p[0]).alias(p[0]) for p in PROFILES))
    pairs = F.explode(F.array(*(F.struct(F.lit(p[0]).alias("action"), F.col(p[0]).alias("k")) for p in PROFILES))).alias("a")
    return total.select("exact_key", "n", pairs).select("exact_key", "a.action", ((F.col("a.k") + 1) / (F.col("n") + len(PROFILES))).alias("propensity"))


def with_propensity(rows: DataFrame, table: DataFrame, action: str, floor: float = PROPENSITY_FLOOR) -> DataFrame:
    """rows with the propensity of their action; an unseen stratum has equal shares. Strata are few (category, risk, image)."""
    t = F.broadcast(table.select(F.col("exact_key").alias("p_key"), F.col("action").alias("p_action"), F.col("propensity").alias("p")))
    keyed = rows.withColumn("key__", exact_key())
    joined = keyed.join(t, (keyed["key__"] == t["p_key"]) & (keyed[action] == t["p_action"]), "left")
    return joined.withColumn("propensity", F.greatest(F.lit(floor), F.coalesce("p", F.lit(1 / len(PROFILES))))).drop("key__", "p_key", "p_action", "p")


def support_table(rows: DataFrame, features: list[str]) -> DataFrame:
    """action, key (stratum), id and x (the features) of rows that support their own actions."""
    return rows.select(F.col("incumbent_action").alias("action"), exact_key().alias("key"), F.col("trajectory_id").alias("id"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))


NEAR = "trajectory_id string, action string, n long, distance double"


def nearest(rows: DataFrame, support: DataFrame, features: list[str], scales: dict[str, float], exclude_self: bool = False, local_bytes: int = LOCAL_BYTES, **shards: int) -> DataFrame:
    """trajectory_id, action, n and distance: the support of each action in the row's stratum, and the nearest of it.

    support: as support_table gives it, all of whose rows count. Up to local_bytes it goes to every task, where rows search the trees of their
    stratum and nothing is shuffled. Beyond, a pivot join searches shards of it, see nearest.py, which shards is for.
    """
    ship(rows.sparkSession)
    size = support.agg(F.count("*") * (8 * len(features) + 64) + F.coalesce(F.sum(F.length("id")), F.lit(0))).first()[0]
    scale = np.array([scales[f] for f in features])
    root = len(features) ** 0.5
    if size > local_bytes:
        return _nearest_in_shards(rows, support, features, scale, exclude_self, shards)
    found: dict[tuple[str, str], list] = {}
    for r in support.collect():
        found.setdefault((r["action"], r["key"]), []).append((r["id"], r["x"]))
    scaled = {g: ([x[0] for x in v], np.array([x[1] for x in v], float) / scale) for g, v in found.items()}
    actions = sorted({a for a, _ in scaled})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown: dict[tuple[str, str], tuple] = {}

        def tree(group: tuple[str, str]) -> tuple[Tree, pd.Index, np.ndarray]:
            if group not in grown:
                ids, x = scaled[group]
                codes = pd.Index(pd.unique(np.array(ids, object)))
                own = codes.get_indexer(ids)
                grown[group] = Tree(x, own), codes, np.bincount(own)
            return grown[group]

        for b in batches:
            for key, part in b.groupby("key"):
                x, ids = np.stack(part["x"].to_list()).astype(float) / scale, part["trajectory_id"].to_numpy()
                for action in actions:
                    if (action, key) in scaled:
                        t, codes, many = tree((action, key))
                        own = codes.get_indexer(ids) if exclude_self else np.full(len(ids), -1)
                        best, _ = t.search(x, np.where(own < 0, -2, own), np.full(len(x), np.inf))
                        seen = len(t.x) - np.where(own < 0, 0, many[own])
                        keep = np.isfinite(best)
                        yield pd.DataFrame({"trajectory_id": ids[keep], "action": action, "n": seen[keep], "distance": best[keep] / root})

    own = rows.select("trajectory_id", exact_key().alias("key"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    return own.mapInPandas(run, NEAR)


def _nearest_in_shards(rows: DataFrame, support: DataFrame, features: list[str], scale: np.ndarray, exclude_self: bool, shards: dict[str, int]) -> DataFrame:
    one = F.array(*(F.col(f).cast("double") / F.lit(float(s)) for f, s in zip(features, scale, strict=True)))
    asked = stash(rows.select(exact_key().alias("key"), F.col("trajectory_id").alias("id"), one.alias("x")), "asked-rows")
    scaled = F.transform(F.arrays_zip("x", F.array(*(F.lit(float(s)) for s in scale)).alias("s")), lambda v: v["x"] / v["s"])
    own = stash(support.select("action", "key", "id", scaled.alias("x")), "support-rows")
    found = pivot_join(asked, own, exclude_self, **shards)
    # a row for each action and stratum
    sizes = own.groupBy("action", "key").agg(F.count("*").alias("n"))
    met = found.join(asked.select("id", "key").distinct(), "id").join(F.broadcast(sizes), ["action", "key"])
    if exclude_self:
        mine = own.groupBy("action", "key", "id").agg(F.count("*").alias("mine"))
        met = met.join(mine, ["action", "key", "id"], "left").withColumn("n", F.col("n") - F.coalesce("mine", F.lit(0)))
    return met.select(F.col("id").alias("trajectory_id"), "action", "n", (F.col("distance") / len(features) ** 0.5).alias("distance"))


def calipers(rows: DataFrame, support: DataFrame, features: list[str], scales: dict[str, float], quantile: float = CALIPER_QUANTILE, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """action, reference_n and caliper: the quantile of distances to the nearest other row of the same action and stratum."""
    near = nearest(rows, support, features, scales, exclude_self=True, local_bytes=local_bytes)
    own = stash(near.join(rows.select("trajectory_id", F.col("incumbent_action").alias("action")), ["trajectory_id", "action"]).select("action", "distance"), "own-distances")
    n = own.groupBy("action").agg(F.count("*").alias("reference_n"))
    return n.join(stats.percentiles(own, "distance", {"caliper": quantile}, ["action"]), "action").select("action", "reference_n", "caliper")


def supported_actions(near: DataFrame, caliper: DataFrame, min_stratum: int = MIN_STRATUM) -> DataFrame:
    """trajectory_id and supported: the actions with enough support near enough, sorted."""
    met = near.where(F.col("n") >= min_stratum).join(F.broadcast(caliper), "action").where(F.col("distance") <= F.col("caliper"))
    return met.groupBy("trajectory_id").agg(F.sort_array(F.collect_set("action")).alias("supported"))
