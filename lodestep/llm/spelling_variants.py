"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word of n code points, padded by q - 1 marks at each end, has n + q - 1 grams of q, and one edit destroys q of them at most. Words
x and y one edit apart therefore share max(|x|, |y|) - 1 grams or more, and of the q + 1 rarest grams of each one is shared. A shared gram
stands at the same position, or one further on in the longer word, and the edit is on one side of it: what stands on its other side
is the same, too. Rarity is the number of words in a gram's slot of a table of SLOTS counts, so what goes to every task is of fixed
size; any order of grams gives the same pairs.

Spark deals the index by gram: a word goes to its q + 1 rarest grams. There its lists are those of (gram, length, position, text on one
side). A list is an inverted index of its own: its members' postings by (gram, position), in ascending order. For a word looked
up, the shortest of these postings are merged by a heap, which gives the members that may reach the bound; the longest, bound - 1 of
them, are only probed. Lists of up to SHORT members are counted member by member. What reaches the bound is compared letter by
letter, and a pair that several grams give comes from the least of them. Grams with more than ``limit`` words are cut into blocks, and each
pair of blocks has a task of its own: no list has a cap. A word has fewer than 130 near words for each letter of its length, so
pairs grow with the words.

Null texts have no words; a null doc_id counts as an empty one; extra columns are ignored; repeated rows count repeatedly. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import count, groupby, repeat
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.session import ship, stash

Q = 4
SLOTS = 1 << 18
#: Members of one gram's lists that a task holds at once; members up to which a list is counted member by member.
LIMIT, SHORT = 20_000, 24
LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 5, 3, 2
#: Of this many (document, word) pairs one loses a letter in the query's contract.
DROP = 97
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, drop: int | None = DROP, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of all texts that are long and frequent enough.

    drop: where it divides the CRC-32 of "doc_id:word", the word loses the letter at that CRC-32 modulo its length.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(LETTERS), F.lit(0))).alias("word"))
    if drop:
        runs = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        runs = runs.select(F.when(F.col("h") % drop == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def grams(word: str, q: int) -> list[str]:
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    return [padded[k : k + q] for k in range(len(word) + q - 1)]


def _slot(gram: str) -> int:
    return crc32(gram.encode()) % SLOTS


def slot_counts(words: DataFrame, q: int = Q) -> np.ndarray:
    """How many words have a gram in each slot: SLOTS numbers, whatever the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SLOTS, np.int64)
        for b in batches:
            for w in b.column(0).to_pylist():
                for s in {_slot(g) for g in grams(w, q)}:
                    found[s] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for slot, n in words.select("word").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[slot] = n
    return counts


def rare(word: str, counts, q: int) -> list[str]:
    """The different grams among a word's q + 1 rarest."""
    return list({g for _, g in sorted([(counts[_slot(g)], g) for g in grams(word, q)])[: q + 1]})


LISTS = "gram string, word string, n long, keys string"


def _postings(counts: list[int], q: int):
    """Each word as a member of the lists of its rarest grams; keys are all these grams, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, words, ns, keys = [], [], [], []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = rare(word, counts, q)
                lists += found
                words += repeat(word, len(found))
                ns += repeat(n, len(found))
                keys += repeat(" ".join(found), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(keys, pa.string())], ["gram", "word", "n", "keys"])

    return run


def one_edit(x: str, y: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    k = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


def first_list(x: str, y: str, keys_x: str, keys_y: str, q: int) -> tuple[str, int, int]:
    """The least (gram, position in y, shift) of the lists in which x finds y: no shift up to the edit, the longer word's after it."""
    gx, gy = grams(x, q), grams(y, q)
    both = {*keys_x.split()} & {*keys_y.split()}
    longer = len(gy) - len(gx)
    # in a run of one letter a gram also stands at its old place behind the edit, but there neither side is the same
    head = next((k for k, (a, b) in enumerate(zip(gx, gy, strict=False)) if a != b), len(gx))
    tail = next((k for k, (a, b) in enumerate(zip(reversed(gx), reversed(gy), strict=False)) if a != b), len(gx))
    before = ((gx[p], p, 0) for p in range(head) if gx[p] in both)
    after = ((gx[p], p + longer, longer) for p in range(len(gx) - tail, len(gx)) if gx[p] in both)
    return min((*before, *after))


def candidates(lists: list[list[int]], bound: int) -> Iterator[int]:
    """Positions that bound or more of the ascending lists hold: the shortest lists are merged by a heap, the bound - 1 longest are probed."""
    lists = sorted(filter(None, lists), key=len)
    if len(lists) < bound:
        return
    cut = len(lists) - (bound - 1)
    short, long = lists[:cut], lists[cut:]
    for at, same in groupby(merge(*short) if cut > 1 else short[0]):
        seen = sum(1 for _ in same)
        for k, x in enumerate(long):
            if seen >= bound or seen + len(long) - k < bound:
                break
            j = bisect_left(x, at)
            seen += j < len(x) and x[j] == at
        if seen >= bound:
            yield at


class _List:
    """The members of one list of the index: (grams, word, n, keys, side) each."""

    __slots__ = ("index", "members")

    def __init__(self, first: tuple):
        self.members, self.index = [first], None

    def near(self, gs: list[str], longer: bool, bound: int) -> Iterator[int]:
        """Positions of members that share bound grams or more with those of a word, at its positions or, if they are longer, one further on."""
        if len(self.members) <= SHORT:  # as many lists of one or two members each: counted without a heap
            for k, m in enumerate(self.members):
                other = m[0]
                if sum(map(eq, gs, other)) + (longer and sum(map(eq, gs, other[1:]))) >= bound:
                    yield k
            return
        if self.index is None:
            self.index = {}
            for k, m in enumerate(self.members):
                for p, g in enumerate(m[0]):
                    self.index.setdefault((g, p), []).append(k)
        lists = list(map(self.index.get, zip(gs, count(), strict=False)))
        if longer:
            lists += map(self.index.get, zip(gs, count(1), strict=False))
        yield from candidates(lists, bound)


def list_pairs(gram: str, rows: list[tuple], q: int, both: bool = False) -> Iterator[tuple]:
    """word, n, other, n of near words of one gram, each pair once. rows: side, word, n, keys; both: of two blocks, where only pairs across sides count."""
    at: dict[tuple, _List] = {}
    mine = []
    for side, word, n, keys in rows:
        gs, size = grams(word, q), len(word)
        k = -1
        for _ in range(gs.count(gram)):
            k = gs.index(gram, k + 1)
            left, right, me = word[: max(0, k - q + 1)], word[k + 1 :], (gs, word, n, keys, side)
            mine.append((size, k, left, right, me))
            for place in ((size, k, 0, left), (size, k, 1, right)):
                if place in at:
                    at[place].members.append(me)
                else:
                    at[place] = _List(me)
    for size, k, left, right, (gs, word, n, keys, side) in mine:
        # the edit is right of the gram, or left of it: what is on the other side is the same
        for longer, shift, place in ((0, 0, (size, k, 0, left)), (0, 0, (size, k, 1, right)), (1, 0, (size + 1, k, 0, left)), (1, 1, (size + 1, k + 1, 1, right))):
            other = at.get(place)
            if other is None or not longer and len(other.members) < 2:
                continue
            for j in other.near(gs, bool(longer), size + longer - 1):
                _, word_j, n_j, keys_j, side_j = other.members[j]
                if (longer or word < word_j) and not (both and side == side_j) and one_edit(word, word_j) and first_list(word, word_j, keys, keys_j, q) == (gram, k + shift, shift):
                    yield word, n, word_j, n_j


PAIRS = "a string, n_a long, b string, n_b long"


def _searched(q: int):
    """Rows come sorted by gram and the numbers of one or two blocks of its list."""

    def taken(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["a", "n_a", "b", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards():
            key, rows = None, []
            for b in batches:
                for gram, one, two, *row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                    if (gram, one, two) != key:
                        if len(rows) > 1:
                            yield key, rows
                        key, rows = (gram, one, two), []
                    rows.append(row)
            if len(rows) > 1:
                yield key, rows

        out: list[tuple] = []
        for (gram, one, two), rows in shards():
            for pair in list_pairs(gram, rows, q, one != two):
                out.append(pair)
                if len(out) >= 20_000:
                    yield taken(out)
                    out = []
        yield taken(out)

    return run


def near_words(words: DataFrame, q: int = Q, limit: int = LIMIT) -> DataFrame:
    """a, n_a, b, n_b: each pair of different words (word, n; every word once) that are one edit apart, once."""
    ship(words.sparkSession)
    lists = stash(words.select("word", "n").mapInArrow(_postings(slot_counts(words, q).tolist(), q), LISTS), "gram-lists")
    # each has over limit members: at most (q + 1) / limit as many as there are words
    hot = stash(lists.groupBy("gram").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks")).where("blocks > 1"), "hot-lists")
    dealt = lists.withColumns({"one": F.lit(0), "two": F.lit(0), "side": F.lit(0)})
    if not hot.isEmpty():
        met = lists.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        met = met.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = met.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")})
    key = ["gram", "one", "two"]
    return dealt.select(*key, "side", "word", "n", "keys").repartition(*key).sortWithinPartitions(*key).mapInArrow(_searched(q), PAIRS)


def roots(forms: DataFrame, limit: int = 64) -> DataFrame:
    """word and root for each row of word and form: forms are followed to the last, by doubling. A form's n is at least twice its word's, so rounds are few."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(limit):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.select("word", "root")
    raise RuntimeError(f"forms did not end in {limit} rounds")


def variants(words: DataFrame, q: int = Q, limit: int = LIMIT, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of word and n."""
    words = stash(words, "vocabulary")
    pairs = stash(near_words(words, q, limit), "near-words")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    fits = F.col("best.near_n") >= dominance * F.col("n")
    found = stash(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, q: int = Q, limit: int = LIMIT) -> DataFrame:
    """The variants of all words of docs, a letter of some deleted as vocabulary says."""
    return variants(vocabulary(docs), q, limit)
