import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestep.llm import host_rules as hr

SPACED = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = SPACED.findall(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {k + j for k, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@given(st.text(alphabet="ab \n\t#é \x1c", max_size=60))
@settings(max_examples=400, deadline=None)
def test_measures(text):
    assert hr.measure(text) == brute(text)


def test_hosts_are_judged_by_shrunk_rates(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), "short"
    rows = [(k, good if k % 10 else bad, "fine") for k in range(200)] + [(1000 + k, bad if k % 10 else good, "poor") for k in range(200)] + [(5000 + k, good if k % 9 else bad, f"h{k % 5}") for k in range(100)] + [(6000, bad, "tiny"), (6001, good, None), (None, None, "fine"), (6002, "", "fine")]
    got = {r["doc_id"]: r for r in hr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert all(not got[k]["base_failed"] and not got[k]["kept"] for k in range(1000, 1200) if k % 10 == 0)
    assert got[1]["kept"] and not got[0]["kept"] and got[6001]["kept"] and not got[None]["kept"]
    whole = hr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_rows=0)
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.values()))


def test_empty_repeated_and_clashing(spark):
    schema = "doc_id long, text string, source string, host int, n_words string"
    assert hr.judge(spark.createDataFrame([], schema)).count() == 0
    assert hr.judge(spark.createDataFrame([(1, "a b", "s", 1, "x")] * 3, schema)).count() == 3
    assert hr.measure("a b c " * 200_000)[4] == 600_000
