import json
import random

import pytest

from lodestep.llm import tool_calls as tc

CALLS = "conv_id long, call_id string, position int, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, position int, output string"
SCHEMA = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", "y"]}, "c": {"type": "array", "items": {"type": ["string", "null"]}}}, "additionalProperties": False}}


def test_violations():
    v = lambda x: tc.violations(x, SCHEMA["f"])
    assert v({"a": 1, "b": "x", "c": ["q", None]}) == [] and v({"a": 1.0}) == []
    assert v({}) == ["$.a: missing"] and v([]) == ["$: not object"] and v({"a": True}) == ["$.a: not integer"]
    assert v({"a": -1, "b": "z", "c": [1], "d": 0}) == ["$.a: out of range", "$.b: not one of the values", "$.c[0]: not string or null", "$.d: not expected"]


def test_canonical():
    assert tc.canonical({"b": 2.0, "a": [1.5, "é\n", None]}) == '{"a":[1.5,"é\\n",null],"b":2}'
    with pytest.raises(ValueError):
        tc.canonical(float("nan"))


def test_links_order_and_cycles(spark):
    calls = [(1, "a", 0, "f", '{"a": 1}', ["b"]), (1, "b", 1, "f", "{", []), (1, "c", 2, "g", None, ["a", "zz"]), (2, "p", 0, "f", '{"a":NaN}', ["q"]), (2, "q", 1, "f", '{"a":2}', ["p"]), (3, "s", 0, "f", '{"a":3}', []), (3, "t", 4, "f", '{"a":3}', ["s"]), (None, None, 0, "f", '{"a":3}', [])]
    results = [(1, "a", 5, "1"), (1, "a", 6, "2"), (1, "x", 7, "lost"), (3, "s", 1, None)]
    got = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA).collect()
    by = {(r["conv_id"], r["call_id"], r["kind"]): r for r in got}
    assert len(got) == 9
    rank = {k: by[(1, k, "call")]["rank"] for k in "abc"}
    assert rank["b"] < rank["a"] < rank["c"]
    assert by[(2, "p", "call")]["rank"] is None and by[(3, "t", "call")]["rank"] == 4
    assert by[(1, "a", "call")]["n_results"] == 2 and json.loads(by[(1, "a", "call")]["line"])["result"] == "2"
    assert by[(1, "x", "orphan")]["line"] == '{"id":"x","result":"lost"}'
    assert by[(1, "b", "call")]["problems"] == "arguments are not JSON" and by[(1, "c", "call")]["problems"] == "no schema for g"
    assert not by[(2, "p", "call")]["valid"] and by[(3, "s", "call")]["valid"]


def test_turns_with_nulls_and_repeats(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q \"é"), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "assistant", "x"), (1, 5, "assistant", "y"), (1, 3, "user", ""), (None, None, None, None)]
    got = tc.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    kinds = sorted(r["kind"] for r in got)
    assert kinds == ["call"] * 3 + ["message"] * 2 + ["orphan"]
    first = next(r for r in got if r["call_id"] == "c1-1")
    assert json.loads(first["line"]) == {"arguments": {"prompt": "q \"é"}, "id": "c1-1", "name": "reply", "result": None}
    assert all(json.loads(r["line"])["arguments"]["after"] == "c1-1" for r in got if r["call_id"] == "c1-3" and r["kind"] == "call")
    assert tc.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chains_of_any_length_are_ordered(spark):
    n = 2 * tc.COMPACT + 1
    calls = [(1, f"k{k}", k, "f", '{"a": 1}', [f"k{k + 1}"] if k + 1 < n else []) for k in range(n)]
    got = tc.ranks(spark.createDataFrame(calls, CALLS)).collect()
    assert [r["call_id"] for r in sorted(got, key=lambda r: r["rank"])] == [f"k{k}" for k in reversed(range(n))]


def order(calls):
    """The ranks by one walk over a conversation: dict of call to (position, needs)."""
    known, out = dict(calls), {}
    while True:
        now = {c: max([(p, 0), *((out[n][0], out[n][1] + 1) for n in needs)]) for c, (p, needs) in known.items() if c not in out and all(n in out for n in needs)}
        if not now:
            return {c: out[c][0] + out[c][1] * tc.STEP if c in out else None for c in known}
        out |= now


@pytest.mark.parametrize("most", [20_000, 3])
def test_ranks_against_a_walk(spark, most):
    rng = random.Random(5)
    known = {c: {f"n{k}": (rng.randrange(12), [f"n{j}" for j in {rng.randrange(14) for _ in range(rng.randrange(3))} if j < 12 and j != k]) for k in range(12)} for c in range(6)}
    known[6] = {"a": (0, ["b"]), "b": (1, ["a"]), "c": (2, ["b"]), "d": (3, [])}
    rows = [(c, k, p, "f", None, [*needs, "lost"]) for c, calls in known.items() for k, (p, needs) in calls.items()]
    got = {(r["conv_id"], r["call_id"]): r["rank"] for r in tc.ranks(spark.createDataFrame(rows, CALLS), most).collect()}
    want = {(c, k): v for c, calls in known.items() for k, v in order(calls).items()}
    assert got == want and any(v is None for v in want.values()) and any(v and v % 1 for v in want.values())


def test_one_scale_for_calls_orphans_and_messages(spark):
    calls = spark.createDataFrame([(1, "a", 5, "f", None, ["b"]), (1, "b", 7, "f", None, []), (1, "c", 8, "f", None, ["a"])], CALLS)
    results, messages = spark.createDataFrame([(1, "x", 3, "lost")], RESULTS), spark.createDataFrame([(1, 6, "user", "m"), (1, 9, "user", "n")], "conv_id long, position int, role string, content string")
    got = tc.link(calls, results, {}, messages).orderBy("rank").collect()
    assert [(r["kind"], r["call_id"] or r["position"]) for r in got] == [("orphan", "x"), ("message", 6), ("call", "b"), ("call", "a"), ("call", "c"), ("message", 9)]


def test_clashing_columns(spark):
    calls = spark.createDataFrame([(1, "a", 0, "f", '{"a":1}', ["b"], "o", 5, 6, "k"), (1, "b", 1, "f", '{"a":1}', [], "o", 5, 6, "k")], CALLS + ", output string, n_results int, rank int, need string")
    results = spark.createDataFrame([(1, "a", 2, "r", 1, "n")], RESULTS + ", rank int, name string")
    got = {r["call_id"]: (r["n_results"], r["rank"]) for r in tc.link(calls, results, SCHEMA).collect()}
    assert got == {"a": (1, 1 + tc.STEP), "b": (0, 1.0)}
