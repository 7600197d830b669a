"""Request logs: JSON lines files, and stand-ins for them made of plain tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestep.functions.json_semantics import serialised_length
from lodestep.functions.money import PROFILES
from lodestep.session import ship, stash, table

CALL_TYPES = ["function_call", "custom_tool_call"]
OUTPUT_TYPES = ["function_call_output", "custom_tool_call_output"]
REQUESTS = "source_chunk string, source_line int, model string, n_items int, tools_chars long, tool_names array<string>"
ITEM = "pos int, is_object boolean, type string, role string, name string, call_id string, content_text string, opening_text string, image_parts int, arguments string, output string, output_text string, chars long"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """source_chunk, source_line (from 1; blank lines keep their number) and request of each line of the folder's *.jsonl files.

    Files are split as any text is. Lines are numbered within their split as they are read, and a split's first number
    comes from the counts of the splits before it in its file: a row for each split.
    """
    raw = spark.read.text(folder, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_chunk"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("request"))
    if not raw.inputFiles():
        raise FileNotFoundError(f"no *.jsonl files in {folder}")
    raw = stash(raw, "lines")
    splits = raw.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("path", "start", (before - F.col("first") + 1).alias("offset"))
    lines = raw.join(offsets, ["path", "start"]).select("source_chunk", (F.col("at") + F.col("offset")).cast("int").alias("source_line"), "request")
    return lines.where(F.trim(F.regexp_replace("request", r"\s", " ")) != "")


def _text(content, separator: str, kind: str | None) -> str:
    if isinstance(content, str):
        return content
    parts = [p for p in content if isinstance(p, dict)] if isinstance(content, list) else []
    if kind:
        return separator.join(str(p.get("text", "")) for p in parts if p.get("type") == kind)
    return separator.join(str(p["text"]) for p in parts if p.get("text") is not None)


def _raw(d: dict, *keys: str) -> str | None:
    return next((json.dumps(d[k]) for k in keys if k in d), None)


def _string(x) -> str | None:
    return x if isinstance(x, str) or x is None else json.dumps(x)


def _item(pos: int, x) -> dict:
    d = x if isinstance(x, dict) else {}
    content = d.get("content")
    parts = content if isinstance(content, list) else []
    return {
        "pos": pos,
        "is_object": isinstance(x, dict),
        "type": _string(d.get("type")),
        "role": _string(d.get("role")),
        "name": _string(d.get("name", "unknown")),
        "call_id": None if d.get("call_id") is None else json.dumps(d["call_id"]),
        "content_text": _text(content, "\n", None),
        "opening_text": _text(content, " ", "input_text"),
        "image_parts": sum(isinstance(p, dict) and p.get("type") == "input_image" for p in parts),
        "arguments": _raw(d, "arguments", "input"),
        "output": _raw(d, "output"),
        "output_text": str(d.get("output", "")),
        "chars": serialised_length(x),
    }


def _names(tools) -> list[str]:
    found = []
    for t in tools if isinstance(tools, list) else []:
        if isinstance(t, dict):
            name = t.get("name") or (t["function"].get("name") if isinstance(t.get("function"), dict) else None)
            found += [str(name)] if name else []
    return found


def _requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for chunk, line, raw in zip(b["source_chunk"], b["source_line"], b["request"], strict=True):
            r = json.loads(raw)
            tools = r.get("tools", [])
            rows.append((chunk, line, r.get("model", "unknown"), len(r.get("input", [])), serialised_length(tools), _names(tools)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in REQUESTS.split(", ")])


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["source_chunk", "source_line", *(c.split()[0] for c in ITEM.split(", "))]
    for b in batches:
        rows = [{"source_chunk": c, "source_line": n} | _item(k, x) for c, n, raw in zip(b["source_chunk"], b["source_line"], b["request"], strict=True) for k, x in enumerate(json.loads(raw).get("input", []))]
        yield pd.DataFrame(rows, columns=names)


def requests(lines: DataFrame) -> DataFrame:
    """One row for each request of read_lines()."""
    ship(lines.sparkSession)
    return lines.mapInPandas(_requests, REQUESTS)


def items(lines: DataFrame) -> DataFrame:
    """One row for each item of each request's input. Python's JSON reading and lengths count, so this is Python."""
    ship(lines.sparkSession)
    return lines.mapInPandas(_items, "source_chunk string, source_line int, " + ITEM)


# Stand-ins: the same operators over the tables at hand


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an item: conv_id, pos, type, role, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), F.lit("message").alias("type"), "role", "text")


def conversation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as a call: conv_id, call_pos, model."""
    calls = conversation_items(spark, sf_dir).where("role = 'assistant'")
    model = F.element_at(F.array(*(F.lit(p[1]) for p in PROFILES)), (F.pmod(F.col("conv_id") + F.floor(F.col("pos") / 4), F.lit(6)) + 1).cast("int"))
    return calls.select("conv_id", F.col("pos").alias("call_pos"), model.alias("model"))


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items of histories: history (the conversation), pos, tokens (a quarter of the characters) and two digests of role and text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return conversation_items(spark, sf_dir).select(F.col("conv_id").alias("history"), "pos", F.floor(F.length(text) / 4).alias("tokens"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"))


def conversation_requests(spark: SparkSession, sf_dir: str, prefix: DataFrame) -> DataFrame:
    """The calls with history and n_items: a call's input is what came before it, so it is a length of its conversation.

    prefix: the prefixes of conversation_history().
    """
    calls = conversation_calls(spark, sf_dir)
    before = prefix.select(F.col("history").alias("of__"), F.col("pos").alias("pos__"), (F.col("length") - F.col("at_pos")).cast("int").alias("n__"))
    joined = calls.join(before, (calls["conv_id"] == before["of__"]) & (calls["call_pos"] == before["pos__"]), "left")
    return joined.select("conv_id", "call_pos", "model", F.col("conv_id").alias("history"), F.coalesce("n__", F.lit(0)).alias("n_items"))


def user_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls of their users: req, pos, call_id, name, arguments, failed, succeeded."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("req"), pos.alias("pos"), F.col("event_id").alias("call_id"), F.col("event_type").alias("name"), F.col("props").alias("arguments"), (F.coalesce(k, F.lit(0)) % 7 == 0).alias("failed"), (F.coalesce(k, F.lit(0)) % 3 == 1).alias("succeeded"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels as decided tasks.

    The action comes from the source's number, the category from the language, the outcome from the quality label.
    """
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    number = F.pmod(F.regexp_extract("source", r"([0-9]+)$", 1).cast("int"), F.lit(6))
    by = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in PROFILES)), number + 1)
    category = F.when(F.col("lang") == "en", "coding").when(F.col("lang") == "de", "artifact").when(F.col("lang") == "fr", "research").when(F.col("lang") == "es", "communication").otherwise("general")
    text = F.coalesce("text", F.lit(""))
    # texts are measured where they are read, so that the join moves numbers alone
    measured = d.select(
        "doc_id",
        "lang",
        "source",
        F.length(text).alias("chars"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double").alias("x_instruction_markers"),
        (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).cast("double").alias("x_input_items"),
    )
    rows = measured.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").cast("string").alias("trajectory_id"),
        "doc_id",
        by(1).alias("logged_model"),
        by(0).alias("incumbent_action"),
        category.alias("x_task_category"),
        F.pmod(F.col("doc_id"), F.lit(4)).cast("string").alias("x_risk_level"),
        (F.pmod(F.col("doc_id"), F.lit(5)) == 0).cast("int").alias("x_has_image"),
        F.floor(F.col("chars") * 8).cast("double").alias("x_total_context_tokens_est"),
        "x_instruction_markers",
        "x_input_items",
        (F.pmod(F.col("doc_id"), F.lit(3)) == 0).cast("int").alias("x_requires_external_action"),
        (F.pmod(F.col("doc_id"), F.lit(7)) == 0).cast("int").alias("x_requires_multiple_steps"),
        F.col("quality").cast("double").alias("evaluation_outcome_score"),
        F.coalesce("toxic", F.lit(0)).cast("int").alias("risk_label"),
        F.col("quality").isNotNull().cast("int").alias("evaluation_outcome_usable"),
    )
