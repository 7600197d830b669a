import random

import pytest
from xxhash import xxh64_intdigest

from lodestep.llm import simhash_bk as sb


def fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest id reachable over links of two differing bits or fewer, for (id, fingerprint) pairs."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(fps):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return [least.get(root(k)) for k in range(len(fps))]


def test_fingerprint_against_a_loop():
    rng = random.Random(2)
    for text in [None, "", " \n", "A", "a b", "É é\u00a0x É", *(" ".join(rng.choice(["a", "B", "cé"]) for _ in range(n)) for n in range(1, 30))]:
        assert sb.simhash(text) & (1 << 64) - 1 == fingerprint(text)
    assert sb.simhash("a b c " * 100_000) & (1 << 64) - 1 == fingerprint("a b c " * 100_000)


@pytest.mark.parametrize("limit", [20_000, 3])
def test_components_against_all_pairs(spark, limit):
    rng = random.Random(limit)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # near copies, chains among them, and groups that agree in a block
        x = rng.choice(fps)
        for _ in range(rng.choice([1, 2, 2, 3])):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps += [fps[0] & ~0xFFFFF | rng.getrandbits(20) for _ in range(60)]
    fps = sorted(set(fps))
    signed = [sb._signed(x) for x in fps]
    links = sb.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_limit=limit)
    roots = {r["node"]: r["root"] for r in sb.components(links, one_task=0).collect()}
    want = components(list(enumerate(fps)))
    groups, got = {}, {}
    for x, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(x)
        got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_long_chains_settle(spark, one_task):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1000)], "a long, b long")
    assert {r["root"] for r in sb.components(links, one_task=one_task).collect()} == {0}


def test_components_in_one_task_and_by_stars(spark):
    rng = random.Random(3)
    links = spark.createDataFrame([(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(120)], "a long, b long")
    one, many = (sorted(map(tuple, sb.components(links, one_task=n).collect())) for n in (200_000, 0))
    assert one == many and len(one) > 100
    assert sb.components(links.where("false")).count() == 0


def test_documents_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \t"), (None, "alone here now"), (9004, "Alone here now"), (9004, "Alone here now")], "doc_id long, text string")
    rows = docs.unionByName(extra).collect()
    want = components([(r["doc_id"], fingerprint(r["text"])) for r in rows])
    got = sb.near_duplicates(docs.unionByName(extra)).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == sorted(((r["doc_id"], f"{fingerprint(r['text']):016x}", c) for r, c in zip(rows, want, strict=True)), key=str)


def test_keep_one(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (7, "other words are here"), (None, "a b c d"), (None, "lone text of none"), (None, "lone text of none"), (8, None), (9, "")]
    kept = sb.keep_one(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lone_text int, gone_id int")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, "A b c d"), (7, "other words are here"), (None, "lone text of none"), (8, None)], key=str)
    assert sb.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def one_of_each(rows):
    """The (id, text) rows that stay: the smallest of each component of texts that are 0.8 alike in words of five."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, left, kept = [shingle_set(t) for _, t in rows], set(range(len(rows))), []
    while left:
        todo = [min(left)]
        kept.append(rows[todo[0]])
        left.remove(todo[0])
        while todo:
            k = todo.pop()
            near = {j for j in left if alike(sets[k], sets[j])}
            left -= near
            todo += near
    return kept


@pytest.mark.parametrize("whole, block", [(64, 2048), (3, 7)])
def test_keep_one_takes_edited_copies_as_brute_force_does(spark, monkeypatch, whole, block):
    monkeypatch.setattr(sb.shingle_sets.near_roots, "__defaults__", (sb.shingle_sets.WIDTH, whole, block, 1_000_000))
    rng = random.Random(4)
    rows = []
    for n in (3, 12, 40, 200, 200, 6000):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 1, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"v{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    hot = [f"h{k}" for k in range(100)]
    for k in range(40):  # one large group
        rows.append((1000 + k, " ".join([*hot[:50], f"k{k}", *hot[51:]])))
    kept = sb.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted(one_of_each(rows)) and len(kept) < len(rows) - 50


def test_keep_one_on_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    kept = sb.keep_one(docs).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, _ in one_of_each([tuple(r) for r in docs.collect()]))


def test_keep_one_decides_by_row_where_ids_repeat(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "these words stand alone here"), (3, "k l m n o p"), (3, "q r s t u v"), (3, "q r s t u v"), (4, "q r s t u v"), (None, "q r s t u v"), (None, "lone x"), (None, "LONE x")]
    kept = sb.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in kept if r["doc_id"] is None] in ([(None, "lone x")], [(None, "LONE x")])
    assert sorted(tuple(r) for r in kept if r["doc_id"]) == [(1, "a b c d e f"), (2, "these words stand alone here"), (3, "k l m n o p"), (3, "q r s t u v")]
