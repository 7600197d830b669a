"""Trajectories: openings, groups, call order, growing histories, splits and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.functions.money import prices_of
from lodestep.operators import stats
from lodestep.session import stash
from lodestep.sources.traces import CALL_TYPES


def stops_opening(type_: Column, role: Column) -> Column:
    """Whether an item ends the opening: a call, reasoning, or the assistant."""
    return F.coalesce(type_.isin([*CALL_TYPES, "reasoning"]), F.lit(False)) | F.coalesce(role == "assistant", F.lit(False))


def opening_lengths(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_items and opening_len (items before the first that ends the opening). An item that is no object ends it too."""
    stop = stops_opening(F.col("type"), F.col("role"))
    if "is_object" in items.columns:
        stop = stop | ~F.col("is_object")
    return items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.coalesce(F.min(F.when(stop, F.col("pos"))), F.max("pos") + 1).cast("int").alias("opening_len"))


def joined_text(text: Column, pos: Column, condition: Column, separator: str = "\n") -> Column:
    """An aggregate: the texts of the items that meet condition, in order."""
    found = F.array_sort(F.collect_list(F.when(condition, F.struct(pos, F.coalesce(text, F.lit(""))))))
    return F.array_join(F.transform(found, lambda x: x["col2"]), separator)


def first_text(text: Column, pos: Column, condition: Column) -> Column:
    """An aggregate: the text of the first item that meets condition, or an empty text."""
    return F.coalesce(F.min_by(F.when(condition, text), F.when(condition, pos)), F.lit(""))


def group_key(system: Column, user: Column) -> Column:
    """16 hex digits of the SHA-1 of the first system and user texts."""
    return F.left(F.sha1(F.concat(system, F.lit("\n"), F.left(user, F.lit(T.OPENING_CHARS)))), F.lit(16))


def grouping_status(n: Column, models: Column) -> Column:
    return F.when(n == 1, "singleton").when(models > 1, "mixed_model_conflict").otherwise("provisional_multi_same_model")


def eligible(status: Column) -> Column:
    return status.isin("singleton", "audited_split").cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Leading characters that two texts share."""
    n = F.least(F.length(a), F.length(b))

    # the longest k with equal k-prefixes, by halving: as many steps as n can have bits
    def halve(s: Column, _: Column) -> Column:
        middle = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        equal = F.left(a, middle) == F.left(b, middle)
        up, down = F.struct(middle.alias("lo"), s["hi"].alias("hi")), F.struct(s["lo"].alias("lo"), (middle - 1).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(equal, up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])


def audit(requests: DataFrame, group: str, model: str, text: str) -> DataFrame:
    """For each group of two requests or more: counts, models, distinct openings and their common prefix.

    The common prefix of a set of texts is that of its least and greatest. Groups of one request are set aside by their counts
    before any text is shuffled, and texts are told apart by two hashes.
    """
    several = requests.groupBy(group).agg(F.count("*").alias("request_count")).where("request_count > 1").select(F.col(group).alias("several__"))
    g = requests.join(several, requests[group] == several["several__"], "left_semi").groupBy(group).agg(
        F.count("*").alias("request_count"),
        F.array_join(F.sort_array(F.collect_set(model)), "|").alias("models"),
        F.count_distinct(model).alias("n_models"),
        F.count_distinct(F.xxhash64(text), F.xxhash64(F.lit(1), text)).alias("full_first_user_unique"),
        F.min(text).alias("least__"),
        F.max(text).alias("greatest__"),
    )
    return g.select(group, "request_count", "models", (F.col("n_models") > 1).cast("int").alias("mixed_models"), "full_first_user_unique", common_prefix(F.col("least__"), F.col("greatest__")).alias("common_first_user_prefix_chars"))


def corrected_id(group: Column, chunk: Column, line: Column) -> Column:
    """The id of a request that is split off; line counts from 1, in the hash from 0."""
    return F.concat(group, F.lit("-"), F.left(F.sha1(F.concat(chunk, F.lit(":"), (line - 1).cast("string"))), F.lit(8)))


def split_groups(requests: DataFrame, overrides: DataFrame, group: str = "group_id") -> DataFrame:
    """requests with trajectory_id and grouping_status: groups with an override are split, others stay.

    overrides: original_group_id and decision. Another decision than split_all_requests is an error.
    """
    groups = requests.groupBy(F.col(group).alias("group__")).agg(grouping_status(F.count("*"), F.count_distinct("model")).alias("status__"))
    counted = requests.join(groups, requests[group].eqNullSafe(groups["group__"])).drop("group__")
    o = overrides.select("original_group_id", "decision")
    joined = counted.join(o, counted[group] == o["original_group_id"], "left")
    fine = F.when(F.col("decision").isNull() | (F.col("decision") == "split_all_requests"), F.col("decision").isNotNull()).otherwise(F.raise_error(F.concat(F.lit("unsupported decision "), F.col("decision"))).cast("boolean"))
    split = joined.withColumn("split__", fine)
    return split.withColumn("trajectory_id", F.when(F.col("split__"), corrected_id(F.col(group), F.col("source_chunk"), F.col("source_line"))).otherwise(F.col(group))).withColumn("grouping_status", F.when(F.col("split__"), "audited_split").otherwise(F.col("status__"))).drop("status__", "split__", "original_group_id", "decision")


def call_order(requests: DataFrame, group: str, *ties: str) -> DataFrame:
    """requests with call_index: by growing history within the group, ties in scan order. Counted over ranges, so no task gets a whole group."""
    counted = stats.prefix_sums(requests.withColumn("one__", F.lit(1)), [group], ["n_items", *ties], {"upto__": "one__"})
    return counted.withColumn("call_index", (F.col("upto__") - 1).cast("int")).drop("one__", "upto__")


def with_previous(calls: DataFrame, group: str, order: str) -> DataFrame:
    """Each call with the history, its length and the model of the call before it in its group. order: consecutive numbers."""
    before = calls.select(F.col(group).alias("group__"), (F.col(order) + 1).alias("order__"), F.col("history").alias("previous_history"), F.col("n_items").alias("previous_items"), F.col("model").alias("previous_model"))
    return calls.join(before, calls[group].eqNullSafe(before["group__"]) & (calls[order] == before["order__"]), "left").drop("group__", "order__")


#: Whole numbers whose sums over the items of a history are its prefix hash, of 31 bits each, so that sums stay exact.
PARTS = ["p0", "p1", "p2", "p3"]


def prefixes(items: DataFrame, digests: list[str]) -> DataFrame:
    """history, length, tokens and PARTS of each prefix of each history: running sums, not arrays.

    items: history, pos, tokens and two 64-bit digests of each item. An item counts with its place in its history, so equal sums
    mean equal prefixes. Items of one place (repeated rows) come as one step.
    """
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1))), (lambda c: F.shiftrightunsigned(F.col(c), 33))
    placed = items.where("pos is not null").select("history", "pos", "tokens", *(F.xxhash64(F.lit(k), "pos", c).alias(f"d{k}__") for k, c in enumerate(digests)))
    parts = {"p0": low("d0__"), "p1": high("d0__"), "p2": low("d1__"), "p3": high("d1__")}
    steps = placed.groupBy("history", "pos").agg(F.count("*").alias("own__"), F.sum("tokens").alias("tokens__"), *(F.sum(c).alias(f"{k}__") for k, c in parts.items()))
    summed = stats.prefix_sums(steps, ["history"], ["pos"], {"length": "own__", "tokens": "tokens__", **{k: f"{k}__" for k in PARTS}})
    return stash(summed.select("history", "pos", F.col("own__").alias("at_pos"), F.col("length").cast("int").alias("length"), "tokens", *PARTS), "prefixes")


def _prefix(prefix: DataFrame, history: str, length: str, names: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """The prefixes under names of their own, and what joins them to a history and a length."""
    own = prefix.select(F.col("history").alias(f"{history}__h"), F.col("length").alias(f"{history}__l"), *(F.col(c).alias(n) for c, n in names.items()))
    return own, (F.col(history) == F.col(f"{history}__h")) & (F.col(length) == F.col(f"{history}__l"))


def shared_lengths(pairs: DataFrame, prefix: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """pairs (columns history, n_items, previous_history, previous_items and others) with shared: how many leading items both have.

    One history's prefixes share the shorter one. Of two histories, the whole shorter length is tried first, which settles growing ones; the
    others try halving lengths, each round a join of those still open with the prefixes of equal hashes.
    """
    most = F.least("n_items", "previous_items")
    same = F.col("history") == F.col("previous_history")
    settled = F.col("previous_history").isNull() | same | (most == 0)
    at = stash(pairs.withColumn("hi__", most).withColumn("lo__", F.when(same, most).when(F.col("previous_history").isNull(), F.lit(None)).otherwise(0)).withColumn("open__", ~settled).withColumn("try__", most), "pairs")
    done = at.where("not open__")
    at = at.where("open__")
    while not at.isEmpty():
        left, on_left = _prefix(prefix, "history", "try__", {k: f"{k}__a" for k in PARTS})
        right, on_right = _prefix(prefix, "previous_history", "try__", {k: f"{k}__c" for k in PARTS})
        small = (lambda d: F.broadcast(d)) if at.count() <= broadcast_rows else (lambda d: d)
        asked = at.select("history", "previous_history", "try__").distinct()
        met = left.join(small(asked), on_left).select("history", "previous_history", "try__", *(f"{k}__a" for k in PARTS))
        met = right.join(small(met), on_right)
        equal = F.lit(True)
        for k in PARTS:
            equal = equal & (F.col(f"{k}__a") == F.col(f"{k}__c"))
        found = met.select(F.col("history").alias("h__"), F.col("previous_history").alias("b__"), F.col("try__").alias("t__"), equal.alias("equal__"))
        joined = at.join(found, (F.col("history") == F.col("h__")) & (F.col("previous_history") == F.col("b__")) & (F.col("try__") == F.col("t__")), "left").withColumn("equal__", F.coalesce("equal__", F.lit(False)))
        joined = joined.withColumns({"lo__": F.when(F.col("equal__"), F.col("try__")).otherwise(F.col("lo__")), "hi__": F.when(F.col("equal__"), F.col("hi__")).otherwise(F.col("try__") - 1)}).drop("h__", "b__", "t__", "equal__")
        joined = stash(joined.withColumn("try__", F.ceil((F.col("lo__") + F.col("hi__")) / 2).cast("int")).withColumn("open__", F.col("lo__") < F.col("hi__")), "pairs")
        done = done.unionByName(joined.where("not open__"))
        at = joined.where("open__")
    return done.withColumn("shared", F.col("lo__").cast("int")).drop("lo__", "hi__", "try__", "open__")


def tokens_at(calls: DataFrame, prefix: DataFrame, length: str, out: str) -> DataFrame:
    """calls with the tokens of the first items of their history, as many as length says."""
    own, on = _prefix(prefix, "history", length, {"tokens": "tokens__"})
    return calls.join(own, on, "left").withColumn(out, F.coalesce("tokens__", F.lit(0))).drop("tokens__", "history__h", "history__l")


def cached_cost(calls: DataFrame, prefix: DataFrame, group: str, order: str, sheet: DataFrame) -> DataFrame:
    """Each call's input tokens, those of its cached prefix, and its cost.

    calls: history, n_items and model beside group and order. The prefix shared with the call before is cached only where the model stays
    the same.
    """
    c = shared_lengths(with_previous(calls, group, order), prefix)
    c = c.withColumn("cached_items", F.when(F.col("previous_model") == F.col("model"), F.coalesce("shared", F.lit(0))).otherwise(0))
    c = tokens_at(tokens_at(c, prefix, "n_items", "input_tokens"), prefix, "cached_items", "cached_tokens")
    c = prices_of(c, "model", sheet)
    return c.withColumn("usd", ((F.col("input_tokens") - F.col("cached_tokens")) * F.col("uncached") + F.col("cached_tokens") * F.col("cached")) / 1e6).drop("uncached", "cached", "output", "previous_history", "previous_items", "previous_model", "shared", "cached_items")


def logged_route(calls: DataFrame, group: str, order: str) -> DataFrame:
    """Each group's models in call order."""
    return calls.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "model"))), lambda x: x["model"]).alias("route"))


def opening_features(requests: DataFrame, items: DataFrame, openings: bool = True) -> DataFrame:
    """The features of each request that were known at its opening decision, with the routing text and its masked form.

    requests and items as sources.traces gives them. With openings=False the whole input counts.
    """
    keys = ["source_chunk", "source_line"]
    if openings:
        items = items.join(opening_lengths(items, keys).select(*keys, "opening_len"), keys).where("pos < opening_len")
    role = F.col("role")
    per = items.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("chars").alias("chars"),
        *(F.count_if(role == r).alias(f"x_{r}_messages") for r in ("system", "user", "assistant")),
        F.sum("image_parts").cast("int").alias("x_image_parts"),
        joined_text(F.col("content_text"), F.col("pos"), role == "user").alias("user_text"),
    )
    r = requests.join(per, keys, "left")
    text = T.routing_text(F.coalesce("user_text", F.lit("")))
    r = r.withColumn("text", text)
    f = T.task_flags(F.col("text"))
    # a list's JSON: its items, ", " between them and two brackets
    input_chars = F.when(F.col("n") > 0, 2 * F.col("n") + F.col("chars")).otherwise(2)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = F.col("text")
    flags = {"x_is_scheduled": "scheduled", "x_is_communication": "communication", "x_is_coding": "coding", "x_is_artifact": "artifact", "x_is_research": "research", "x_is_correction": "correction", "x_requires_multiple_steps": "multistep", "x_requires_external_action": "external", "x_high_risk_language": "high_risk"}
    return r.select(
        *keys,
        F.col("model").alias("logged_model"),
        F.col("n_items").alias("request_items"),
        zero("n").alias("x_input_items"),
        F.floor(input_chars / 4).alias("x_input_tokens_est"),
        F.floor(F.col("tools_chars") / 4).alias("x_tool_schema_tokens_est"),
        (F.floor(input_chars / 4) + F.floor(F.col("tools_chars") / 4)).alias("x_total_context_tokens_est"),
        *(zero(f"x_{k}_messages").alias(f"x_{k}_messages") for k in ("system", "user", "assistant")),
        zero("x_image_parts").alias("x_image_parts"),
        (zero("x_image_parts") > 0).cast("int").alias("x_has_image"),
        F.size("tool_names").alias("x_available_tools"),
        F.length(t).alias("x_task_text_chars"),
        F.when(F.length(t) > 0, F.greatest(F.lit(1), F.floor(F.length(t) / 4))).otherwise(0).alias("x_task_text_tokens_est"),
        T.word_count(t).alias("x_task_word_count"),
        T.question_marks(t).alias("x_question_marks"),
        T.marker_count(t).alias("x_instruction_markers"),
        *(T.flag(f[v]).alias(k) for k, v in flags.items()),
        T.risk_level(f).alias("x_risk_level"),
        T.primary_category(f).alias("x_task_category"),
        *(c.alias(f"x_available_{k}_tools") for k, c in T.tool_counts(F.col("tool_names")).items()),
        F.right(t, F.lit(T.PREVIEW_CHARS)).alias("task_preview"),
        T.sanitise(t).alias("x_task_text_sanitized"),
    )
