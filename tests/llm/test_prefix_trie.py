import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lodestep.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The nodes of the rebuilt conversations, from dictionaries of prefixes."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(conv.get(c - c % 20, [])[:h] + conv[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    return sorted(map(tuple, pt.conversation_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_random_tries_against_prefixes(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 4, 9])):
            # nulls in every column, empty texts; ties only of equal turns, whose order does not matter
            rows.append((c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["a", "b", None, ""]), rng.choice(["x y", "z", " ", "", None])))
    rows += rows[:20] + [(None, 1, "a", "x")]
    assert found(spark, rows, partitions=partitions, block=3) == brute(rows)


def test_one_conversation_copied_over_all_tasks(spark):
    rows = [(c, t, "user", "the same text") for c in range(200) for t in range(3)] + [(300, 0, "user", "other")]
    assert found(spark, rows, partitions=9, block=7) == brute(rows)


def test_a_long_conversation_and_its_extension(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((20, 3000), (40, 3500), (60, 3500)) for t in range(n)] + [(41, 0, "user", "x")]
    got = found(spark, rows, partitions=3)
    want = brute_long(rows)
    assert got == want


def brute_long(rows):
    """As brute, for nested conversations: 20 is the start of 40 and 60; 41 is rebuilt from 40."""
    h = zlib.crc32(b"41") % 4
    size = {20: 3000, 40: 3500, 60: 3500, 41: h if h else 1}
    mine = {c: lambda d, c=c, n=n: ("x" if (c == 41 and h == 0) else f"turn {d - 1}") for c, n in size.items()}
    out, paths = [], defaultdict(list)
    for c, n in size.items():
        for d in range(n + 1):
            paths[(d, "root" if d == 0 else mine[c](d))].append(c)
    total = {k: (len(m) - 1) * (0 if k[0] == 0 else len(k[1].split())) for k, m in paths.items()}
    tail = defaultdict(int)
    for d in range(3500, 0, -1):
        tail[d] = tail[d + 1] + total.get((d, f"turn {d - 1}"), 0)
    for (d, word), m in paths.items():
        main = word != "x"
        ends = ",".join(map(str, sorted(c for c in m if size[c] == d)))
        kids = len({mine[c](d + 1) for c in m if size[c] > d})
        leaves = 1 + (d == 0 and h == 0) if main else 1
        parent = None if d == 0 else min(paths[(d - 1, "root" if d == 1 else f"turn {d - 2}")])
        out.append((min(m), d, parent, len(m), kids, leaves, (tail[max(d, 1)] + (total[(1, "x")] if d == 0 and h == 0 else 0)) if main else 0, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_empty_tables_extra_columns_and_turnless_conversations(spark):
    assert found(spark, []) == []
    # conversation 3 has fewer turns than it takes from conversation 0, which is absent
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    assert found(spark, [(c, 0, "user", "a")]) == brute([(c, 0, "user", "a")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, "b"), (21, 0, "user", "a", 6, "c")], f"{SCHEMA}, depth int, turns string")
    assert sorted(map(tuple, pt.conversation_trie(rows).collect()), key=str) == brute([(1, 0, "user", "a"), (21, 0, "user", "a")])


def test_the_query_against_prefixes(spark, tiny):
    from lodestep.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_prefix_trie"](spark, tiny).collect()), key=str) == brute(rows)
