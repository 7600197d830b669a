"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are joined by (conv_id, call_id). A call may name calls whose results it needs. ``rank`` orders everything of
a conversation on one scale, that of positions: a message, an orphan, or a call whose needs all stand before it has its
position; a call that needs a later one is released at that one's rank, and the fraction (``STEP`` a call) orders calls that are released at
one position. So a call's rank is above those of all that it needs. Calls on or behind a cycle have a null rank. Conversations without
needs that point forward need no search; others are ordered in one task each up to ``MAX_GROUP`` calls and needs, and beyond
that in rounds over tables, one for each level. Arguments are checked against
a JSON schema of the call's name (type, required, properties, additionalProperties, enum, minLength, minimum, maximum,
items). Canonical JSON has sorted keys, no white space, no escapes that aren't needed, and no NaN.

Every conversation's lines are rows of their own, with a rank to order them by, so no conversation's texts are gathered in a task.
Several results of one id: the greatest text counts, and ``n_results`` says how many there were. Results without a call are
kept as ``orphan``. Ids that are null link nothing. Repeated calls are kept. A null text is JSON null. Other columns of the inputs are
not looked at, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.session import ship, stash

STEP = 2.0**-24
MAX_GROUP = 20_000
COMPACT = 8  # rounds after which the released calls are written as one table
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys and no white space; whole floats are written as integers."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e15 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with value, by the supported part of JSON schema."""
    found = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = any(number and (k == "number" or float(value).is_integer()) if k in ("number", "integer") else isinstance(value, KINDS[k]) for k in kinds)
        if not fits:
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the values")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        found.append(f"{at}: out of range")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not expected")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{k}]")
    return found


def _released(calls: pa.Table) -> pa.Table:
    """conv_id, call_id, release and depth of one conversation's calls; rows: call_id, position, need (null: none)."""
    ids, positions, needs = (calls.column(k).to_pylist() for k in ("call_id", "position", "need"))
    state = {c: (p, 0) for c, p in zip(ids, positions, strict=True)}
    needed_by: dict[str, list[str]] = {}
    waits = dict.fromkeys(state, 0)
    for c, n in zip(ids, needs, strict=True):
        if n is not None:
            needed_by.setdefault(n, []).append(c)
            waits[c] += 1
    free, done = [c for c, k in waits.items() if not k], []
    while free:
        c = free.pop()
        done.append((c, *state[c]))
        release, depth = state[c]
        for d in needed_by.get(c, ()):
            state[d] = max(state[d], (release, depth + 1))
            waits[d] -= 1
            if not waits[d]:
                free.append(d)
    conv = calls.column("conv_id")[0].as_py()
    columns = [[conv] * len(done), *([x[k] for x in done] for k in range(3))]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv_id", "call_id", "release", "depth"])


def _rounds(left: DataFrame, needs: DataFrame) -> DataFrame:
    """As _released, for conversations of any size: each round releases the calls that wait for none, or is the last."""
    left, done, level = stash(left.select("conv_id", "call_id", F.struct(F.col("position").cast("long").alias("release"), F.lit(0).cast("long").alias("depth")).alias("state")), "open-calls"), None, 0
    while True:
        free = stash(left.join(needs.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"), "released")
        if free.isEmpty():
            return done if done is not None else free.select("conv_id", "call_id", "state.*")
        now = free.select("conv_id", "call_id", "state.*")
        done = now if done is None else done.unionByName(now)
        level += 1
        if level % COMPACT == 0:
            done = stash(done, "released-before")
        met = needs.join(free.select("conv_id", F.col("call_id").alias("need"), F.struct("state.release", (F.col("state.depth") + 1).alias("depth")).alias("after")), ["conv_id", "need"])
        met = met.groupBy("conv_id", "call_id").agg(F.max("after").alias("after"))
        left = left.join(free, ["conv_id", "call_id"], "left_anti").join(met, ["conv_id", "call_id"], "left")
        left = stash(left.select("conv_id", "call_id", F.greatest("state", F.coalesce("after", "state")).alias("state")), "open-calls")
        needs = stash(needs.join(free.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"), "open-needs")


def ranks(calls: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """conv_id, call_id and rank (null on or behind a cycle) of the calls.

    calls: conv_id, call_id, position, needs (ids). Needs that no call has are left out.
    """
    ship(calls.sparkSession)
    nodes = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("position").cast("long").alias("position"))
    edges = calls.where("size(needs) > 0").select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    edges = edges.join(nodes, ["conv_id", "call_id"]).join(nodes.select("conv_id", F.col("call_id").alias("need"), F.col("position").alias("before")), ["conv_id", "need"])
    edges = stash(edges, "call-needs")
    turned = edges.where("before >= position").select("conv_id").distinct()
    rank = F.col("position").cast("double").alias("rank")
    if turned.isEmpty():
        return nodes.select("conv_id", "call_id", rank)
    turned = stash(turned, "turned")
    left = stash(nodes.join(turned, "conv_id", "left_semi"), "turned-calls")
    needs = edges.join(turned, "conv_id", "left_semi").select("conv_id", "call_id", "need")
    rows = left.withColumn("need", F.lit(None).cast("string")).unionByName(needs.join(left, ["conv_id", "call_id"]).select("conv_id", "call_id", "position", "need"))
    large = stash(rows.groupBy("conv_id").count().where(F.col("count") > max_group).select("conv_id"), "large-conversations")
    few = rows.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_released, "conv_id long, call_id string, release long, depth long")
    if not large.isEmpty():
        few = few.unionByName(_rounds(left.join(large, "conv_id", "left_semi"), stash(needs.join(large, "conv_id", "left_semi"), "open-needs")))
    placed = left.join(few, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("release") + F.col("depth") * F.lit(STEP)).alias("rank"))
    return nodes.join(turned, "conv_id", "left_anti").select("conv_id", "call_id", rank).unionByName(placed)


LINE = "valid boolean, problems string, line string"


def _lines(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid, problems, lines = [], [], []
            rows = zip(*(b.column(k).to_pylist() for k in range(4, 9)), strict=True)
            for kind, call_id, name, arguments, output in rows:
                wrong = []
                if kind == "call":
                    try:
                        args = json.loads(arguments) if arguments is not None else None
                        wrong = violations(args, schemas[name]) if name in schemas else [f"no schema for {name}"]
                    except (ValueError, RecursionError):
                        args, wrong = arguments, ["arguments are not JSON"]
                    value = {"arguments": args, "id": call_id, "name": name, "result": output}
                else:
                    value = {"id": call_id, "result": output} if kind == "orphan" else {"content": output, "role": name}
                try:
                    line = canonical(value)
                except ValueError:
                    wrong, line = [*wrong, "a number that JSON lacks"], canonical({**value, "arguments": arguments})
                valid.append(not wrong)
                problems.append("; ".join(wrong) or None)
                lines.append(line)
            keep = [b.column(k) for k in (0, 1, 2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(problems, pa.string()), pa.array(lines, pa.string())], ["conv_id", "position", "rank", "n_results", "kind", "call_id", "valid", "problems", "line"])

    return run


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], messages: DataFrame | None = None) -> DataFrame:
    """conv_id, position, rank, n_results, kind (call, orphan or message), call_id, valid, problems and line.

    calls: conv_id, call_id, position, name, arguments (JSON), needs. results: conv_id, call_id, position, output.
    messages: conv_id, position, role, content.
    """
    ship(calls.sparkSession)
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), "position", "name", "arguments", "needs")
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), "position", "output")
    by_id = results.groupBy("conv_id", "call_id").agg(F.max("output").alias("output"), F.count("*").alias("n_results"))
    linked = calls.join(by_id, ["conv_id", "call_id"], "left").join(ranks(calls), ["conv_id", "call_id"], "left")
    linked = linked.select("conv_id", "position", "rank", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.lit("call").alias("kind"), "call_id", "name", "arguments", "output")
    known = calls.select("conv_id", "call_id").distinct()
    none = F.lit(None).cast("string")
    rank = F.col("position").cast("double").alias("rank")
    lone = results.join(known, ["conv_id", "call_id"], "left_anti").select("conv_id", "position", rank, F.lit(1).cast("long").alias("n_results"), F.lit("orphan").alias("kind"), "call_id", none.alias("name"), none.alias("arguments"), "output")
    rows = linked.unionByName(lone)
    if messages is not None:
        rows = rows.unionByName(messages.select("conv_id", "position", rank, F.lit(0).cast("long").alias("n_results"), F.lit("message").alias("kind"), none.alias("call_id"), F.col("role").alias("name"), none.alias("arguments"), F.col("content").alias("output")))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("position").cast("long").alias("position"), "rank", "n_results", "kind", "call_id", "name", "arguments", "output")
    return rows.mapInArrow(_lines(schemas), "conv_id long, position long, rank double, n_results long, kind string, call_id string, " + LINE)


#: The schema of the calls that from_turns() makes.
TURN_SCHEMAS = {"reply": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}, "after": {"type": "string"}}, "additionalProperties": False}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of plain chat turns (conv_id, turn, role, text).

    Plain chats have no tool calls, so a user's turn stands for the call ``reply``, and an assistant's turn for the result
    of the turn before it. Of each four exchanges, the first and second need the exchange before them, the third needs the
    one that follows it, and the fourth the one two before it, so that needs point both ways and have no cycles.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    exchange = F.pmod(F.floor(F.col("turn") / 2), F.lit(4))
    user = turns.where("role = 'user'").withColumn("other", F.col("turn") + F.when(exchange == 2, 2).when(exchange == 3, -4).otherwise(-2))
    there = turns.where("role = 'user'").select(F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"), F.lit(True).alias("has")).distinct()
    named = user.join(there, (user["conv_id"] == there["b_conv"]) & (user["other"] == there["b_turn"]), "left")
    after = F.when(F.col("has"), call_id(F.col("other")))
    args = F.to_json(F.struct(after.alias("after"), F.col("text").alias("prompt")))
    calls = named.select("conv_id", call_id(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"), args.alias("arguments"), F.when(F.col("has"), F.array(after)).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("output"))
    others = turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    return calls, results, others


def format_turns(turns: DataFrame) -> DataFrame:
    """link() over plain chat turns."""
    calls, results, others = from_turns(turns)
    return link(calls, results, TURN_SCHEMAS, others)
