import random
import re
import zlib
from collections import Counter

import pytest

from lodestep.llm import spelling_variants as sv


def near(a, b):
    """Edit distance one, by all edits of the shorter or equal word."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    count = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return groups({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})


def groups(v):
    by = {w: [x for x in v if abs(len(x) - len(w)) < 2 and near(w, x)] for w in v}
    form = {}
    for w, xs in by.items():
        if xs and v[best := min(xs, key=lambda x: (-v[x], x))] >= 2 * v[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(by[w]), v.get(form.get(w))) for w, n in v.items()}


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def words(seed, many):
    """Families of words: repeated letters, edits at the ends, chains of edits."""
    rng, out = random.Random(seed), set()
    while len(out) < many:
        w = "".join(rng.choice(rng.choice(["ab", "aàé", "abcdefgh"])) for _ in range(rng.randint(5, 9)))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice("abxÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k + 1 :]])
        if len(w) >= 5:
            out.add(w)
    return {w: rng.choice([3, 5, 10, 11, 40, 200]) for w in sorted(out)}


@pytest.mark.parametrize(("q", "limit", "short"), [(4, 20_000, 24), (2, 20_000, 0), (3, 30, 2)])
def test_variants_against_all_pairs(spark, q, limit, short, monkeypatch):
    monkeypatch.setattr(sv, "SHORT", short)
    v = words(q, 500)
    df = spark.createDataFrame(list(v.items()), "word string, n long")
    assert found(sv.variants(df, q, limit)) == groups(v)
    pairs = [(r["a"], r["b"]) for r in sv.near_words(df, q, limit).collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs)


@pytest.mark.parametrize("short", [0, 3, 1000])
def test_lists_with_and_without_a_heap(short, monkeypatch):
    monkeypatch.setattr(sv, "SHORT", short)
    v = sorted(words(9, 300))
    counts = [0] * sv.SLOTS
    rows = {}
    for w in v:
        for g in (keys := sv.rare(w, counts, 4)):
            rows.setdefault(g, []).append((0, w, 1, " ".join(keys)))
    got = Counter(frozenset((a, b)) for g, r in rows.items() for a, _, b, _ in sv.list_pairs(g, r, 4))
    assert set(got.values()) <= {1}
    assert set(got) == {frozenset((a, b)) for a in v for b in v if a < b and near(a, b)}


@pytest.mark.parametrize("q", [2, 4])
def test_letters_inserted_before_runs_of_one_letter(q):
    v = sorted({f"{a}{r * n}{b}" for a in ("", "a", "b", "ab") for r in "ab" for n in range(5, 10) for b in ("", "bb", "bbbbbb", "ab")})
    counts = [0] * sv.SLOTS
    for w in v:
        for s in {sv._slot(g) for g in sv.grams(w, q)}:
            counts[s] += 1
    rows = {}
    for w in v:
        for g in (keys := sv.rare(w, counts, q)):
            rows.setdefault(g, []).append((0, w, 1, " ".join(keys)))
    got = Counter(frozenset((a, b)) for g, r in rows.items() for a, _, b, _ in sv.list_pairs(g, r, q))
    assert set(got.values()) <= {1}
    assert set(got) == {frozenset((a, b)) for a in v for b in v if a < b and near(a, b)}


def test_two_blocks_of_which_one_is_empty():
    rows = [(0, w, 1, "^^^w") for w in ("words", "wordy")]
    assert list(sv.list_pairs("^^^w", rows, 4)) and not list(sv.list_pairs("^^^w", rows, 4, True))


def test_merged_candidates():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(12), rng.randint(0, 8))) for _ in range(7)]
        bound = rng.randint(1, 7)
        assert list(sv.candidates(lists, bound)) == [k for k in range(12) if sum(k in x for x in lists) >= bound]


def test_edits():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in "ab")
        assert sv.one_edit(a, b) == (a != b and near(a, b)), (a, b)


def test_documents_nulls_ties_and_clashing_columns(spark):
    texts = [(k, "Hello hello, HELLO hallo hallo hallo! hallos" if k < 4 else None if k == 4 else "" if k == 5 else "Ãstern Ãstern ãstern ×bcdef x") for k in range(9)]
    texts += [(None, "hellos hellos hellos"), (3, "hellos hello")] + texts[:2] + [(20, "verylongword" * 3000 + " hello")] * 3
    df = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in texts], "doc_id long, text string, n long, word string, h int")
    got = found(sv.spelling_groups(df))
    assert got == brute(texts)
    assert got["hallos"][0] == "hallo"
    assert sv.spelling_groups(df.limit(0)).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    forms = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(40)]
    assert {tuple(r) for r in sv.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {(w, "w040") for w, _ in forms}


def test_the_query_against_brute_force(spark, tiny):
    from lodestep.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_spelling_variants"](spark, tiny)) == brute(rows)
