import hashlib
import random
import re

from lodestep.llm import positional_index as pi

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, pi.decontaminate(d, i, **more).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["the", "of", "a", "Éa", "éa", "B2", "x"]
    text = lambda n: rng.choice(["", " ", ".\n"]).join([""]) + " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([0, 1, 3, 9, 10, 11, 14, 30])] + [(8, None), (9, "the the the the the the the the the the")]
    docs = [(k, text(rng.randrange(60))) for k in range(40)]
    docs += [(100 + k, f"x {t} x" if t else t) for k, t in items] + [(200, None), (201, ""), (202, "the " * 3000), (202, "the " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, broadcast_rows=0) == brute(docs, items)


def test_lower_case_of_other_letters_is_not_folded(spark):
    assert run(spark, [(1, "ÉA b"), (2, "Éa B"), (3, "éa b"), (4, "İx Ⅰ"), (5, "İX Ⅰ")], [(1, "éA B"), (2, "İX Ⅰ")]) == brute([(1, "ÉA b"), (2, "Éa B"), (3, "éa b"), (4, "İx Ⅰ"), (5, "İX Ⅰ")], [(1, "éA B"), (2, "İX Ⅰ")])


def test_proximity_finds_moved_words(spark):
    item = [(1, "one two three four five six seven eight nine ten")]
    docs = [(1, "one two three four five six seven eight nine ten"), (2, "one two and three four five six seven eight nine ten"), (3, "ten nine")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")
    got = {(r["doc_id"], r["exact"]) for r in pi.proximity_matches(d, i, 2).collect()}
    assert (1, True) in got and any(d == 2 and not e for d, e in got) and all(d != 3 for d, _ in got)


def test_empty_tables_and_clean(spark):
    assert run(spark, [], [(1, "a b")]) == [] and run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    d = spark.createDataFrame([(1, "x a b c", 5), (2, "q", 6), (None, "a b c", 7)], "doc_id long, text string, n int")
    i = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert sorted(pi.clean(d, i).collect(), key=str) == [(2, "q", 6)]


def test_clean_judges_rows_by_their_text(spark):
    d = spark.createDataFrame([(1, "x a b c", 5), (2, "q", 6), (None, "a b c", 7), (None, "A b, c!", 8), (None, "a b", 9), (None, "a b", 9), (None, None, 10)], "doc_id long, text string, text_hash int")
    i = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for n in (1_000_000, 0):
        assert sorted(map(tuple, pi.clean(d, i, broadcast_rows=n).collect()), key=str) == sorted([(2, "q", 6), (None, "a b", 9), (None, "a b", 9), (None, None, 10)], key=str)


def test_shuffled_postings_hold_no_texts(spark):
    """With nothing broadcast, what the search shuffles is numbers: a text of 100,000 words without a match stays where it is."""
    long = " ".join(f"w{k}" for k in range(100_000))
    items = [(1, "w0 w1 w2 x"), (2, "w5 w6")]
    docs = [(1, long), (2, long), (3, "w0 w1 w2 x w5"), (4, None)]
    assert run(spark, docs, items, broadcast_rows=0) == brute(docs, items)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = pi.postings(d, pi.anchored(d, i, broadcast_rows=0), broadcast_rows=0)
    assert index.columns == ["t", "k1", "k2", "pos"] and index.count() == 8  # w0 w1 w2 (of the rarest) w5 w6 of one long text, and of the third


def test_clashing_columns(spark):
    names = ["k1", "k2", "t", "pos", "start", "found", "gram_id", "hit", "ids", "term", "w"]
    d = spark.createDataFrame([(1, "x a b c", *[0] * len(names)), (2, "q", *[0] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    i = spark.createDataFrame([(1, "a b c", 0, 0)], "item_id long, text string, gram int, n int")
    assert [r["doc_id"] for r in pi.clean(d, i).collect()] == [2] and pi.clean(d, i).columns == d.columns
    assert {r["doc_id"]: r["n_hit"] for r in pi.decontaminate(d, i).collect()} == {1: 3, 2: 0}
