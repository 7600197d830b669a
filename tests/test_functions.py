import json

import pytest
from pyspark.sql import functions as F

from lodestep.functions import json_semantics as js
from lodestep.functions import money
from lodestep.functions import text as T

#: Output, failed, succeeded
OUTPUTS = [
    (None, False, False), ("Exit code: 2", True, False), ("exit code 2", False, False), ("exit_code=0", False, True), ("Traceback (most recent call last)", True, False),
    ('"Traceback (most recent call last)"', False, False), ("5", False, False), ({"success": False}, True, False), ({"ok": True, "exit_code": "1"}, True, True),
    ({"exit_code": True}, True, False), ({"exit_code": 1, "returncode": 0}, True, False), ({"exit_code": None, "r": {"ok": True}}, False, True), ({"error": 0}, False, False),
    ({"error": []}, False, False), ({"error": ""}, False, False), ({"error": "x"}, True, False), ({"a": {"ok": False}}, True, False), ({"a": "exit code: 1"}, False, False),
    (["exit code: 1"], True, False), ({"exit_code": 0, "error": "x"}, True, True),
]


@pytest.mark.parametrize(("output", "failed", "succeeded"), OUTPUTS)
def test_outputs(output, failed, succeeded):
    assert (js.failed(output), js.succeeded(output)) == (failed, succeeded)
    if isinstance(output, dict):
        assert (js.failed(json.dumps(output)), js.succeeded(json.dumps(output))) == (failed, succeeded)


def test_canonical_and_lengths():
    assert js.canonical('{"b": 1.0, "a": "é"}') == '{"a":"é","b":1.0}' and js.canonical("x") == '"x"'
    assert js.serialised_length([{"role": "user", "content": "é"}]) == 39


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_masks(spark):
    t = F.col("t")
    assert one(spark, "please schedule the documentation weekly", T.sanitise(t)) == ("please id the id weekly",)
    assert one(spark, "<delivery_note>x\ny</delivery_note> see `a/b` at https://x.org/1 or me@x.org, PII_NAME_1 <PERSON> on 2024-01-02T10:00 v 3.14 [base64 image redacted] <b>", T.sanitise(t)) == ("see path at url or url , entity entity on date v number image",)
    assert one(spark, "éphémère a b\x07c", T.routing_text(t), T.sanitise(t)) == ("éphémère a b c", "éphémère a b c")
    assert one(spark, "x" * 7000, F.length(T.routing_text(t))) == (6000,)


def test_predicates_and_categories(spark):
    t = F.col("t")
    f = T.task_flags(t)
    assert one(spark, "Run the cron TEST, then delete it", T.risk_level(f), T.primary_category(f), f["multistep"]) == (3, "scheduled", True)
    assert one(spark, "postér codé", T.risk_level(f), T.primary_category(f)) == (0, "general")
    assert one(spark, None, f["coding"]) == (False,)
    assert one(spark, "é x_1? no?\n1. a\n- b", T.word_count(t), T.question_marks(t), T.marker_count(t)) == (6, 2, 2)
    assert one(spark, "find the cats find it's dogs", T.terms(t)) == (["find", "cats", "find", "dogs", "find__cats", "cats__find", "find__dogs"],)
    assert one(spark, "", T.terms(t)) == ([],)


def test_prices(spark):
    m = spark.createDataFrame([("gpt-5.6-sol-x",), ("gpt-5.6-nova",), ("foo",), (None,), ("claude-opus",)], "m string")
    got = {r["m"]: r["uncached"] for r in money.prices_of(m, "m", money.price_sheet(spark)).collect()}
    assert got == {"gpt-5.6-sol-x": 5.0, "gpt-5.6-nova": 2.0, "foo": 2.0, None: 2.0, "claude-opus": 5.0}
    assert [one(spark, x, money.canonical_action(F.col("t")))[0] for x in ("claude-fable-5", "gpt-5.6-sol")] == ["fable", "sol"]
    with pytest.raises(Exception, match="no action"):
        one(spark, "other", money.canonical_action(F.col("t")))
    assert spark.range(1).select(money.percent_change(F.lit(4.0), F.lit(3.0)), money.percent_change(F.lit(0.0), F.lit(3.0))).first()[:] == (-25.0, 0.0)


#: Raw outputs, whether they failed and succeeded, their canonical text and length.
OUTPUTS = [
    ("null", False, False, "null", 4), ('"Exit code: 2"', True, False, '"Exit code: 2"', 14), ('"exit code 2"', False, False, '"exit code 2"', 13), ('"exit_code=0"', False, True, '"exit_code=0"', 13),
    ('"Traceback (most recent call last)"', True, False, '"Traceback (most recent call last)"', 35), ("5", False, False, "5", 1), ('{"success": false}', True, False, '{"success":false}', 18),
    ('{"ok": true, "exit_code": "1"}', True, True, '{"exit_code":"1","ok":true}', 30), ('{"exit_code": true}', True, False, '{"exit_code":true}', 19), ('{"exit_code": 1, "returncode": 0}', True, False, '{"exit_code":1,"returncode":0}', 33),
    ('{"exit_code": null, "r": {"ok": true}}', False, True, '{"exit_code":null,"r":{"ok":true}}', 38), ('{"error": 0}', False, False, '{"error":0}', 12), ('{"error": []}', False, False, '{"error":[]}', 13),
    ('{"error": "x"}', True, False, '{"error":"x"}', 14), ('{"a": {"ok": false}}', True, False, '{"a":{"ok":false}}', 20), ('{"a": "exit code: 1"}', False, False, '{"a":"exit code: 1"}', 21),
    ('["exit code: 1"]', True, False, '["exit code: 1"]', 16), ('{"exit_code": 0, "error": "x"}', True, True, '{"error":"x","exit_code":0}', 30), (None, False, False, '""', 0),
]


def test_json_semantics_of_outputs(spark):
    d = spark.createDataFrame([(k, x[0]) for k, x in enumerate(OUTPUTS)], "k int, o string")
    got = d.select("k", js.output_failed("o"), js.output_succeeded("o"), js.canonical_arguments("o"), js.json_length("o")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: x[1:] for k, x in enumerate(OUTPUTS)}
