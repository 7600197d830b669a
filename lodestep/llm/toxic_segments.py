"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are runs of letters, in lower case, counted once a text, and texts that repeat are counted once. A token's score is its
log-odds between toxic and other labelled texts, less ``Z`` standard deviations. The odds have a Dirichlet prior from the counts of its
first letters, which have a flat one. Tokens without enough texts have the score of their first letters, and those whose first letters have not enough either
that of the prior alone. So every token of a text has a score, below 0 for all but toxic ones. A text's maximal scoring segments (no
part of which could be extended or cut for more) are found in one pass over its tokens.

The segments of texts without toxicity follow an extreme-value distribution, fitted on all segments of clean labelled texts that gave
no counts: a segment of score s is expected K * n * exp(-lambda * s) times in n tokens. Segments expected less than
``SIGNIFICANT`` times are toxic passages. A text's evidence takes them together: for the r best segments, the sum of their
normalised scores (lambda * s - log(K * n)) has the tail exp(-x) * x ** (r - 1) / (r! (r - 1)!), doubled for each further segment,
and the least over r counts. A logistic curve over its logarithm, with 0.7 at the cut that parts the same held-back texts best (F1), gives the score. The model in
use is the one that was calibrated: a third of the learnable texts, by hash, calibrates, the rest gives counts.

Labels are learned from at most ``MAX_FIT_ROWS`` labelled texts, taken by hash; this also bounds the token table that goes
to the tasks. A text without a toxic token has score 0, so null and empty ones too. A null doc_id is never learned from.
Null labels are no labels; a doc_id with several labels has the largest. Without labels of both kinds every score is 0.
Other columns are not looked at, whatever their names; reject() keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.llm.hd_language import held_out
from lodestep.session import ship, stash

#: The setting that toxicity_settings prefers on learnable rows.
STEM = 5
Z = 2.5
PRIOR = 2.0
LEAST_TEXTS = 3  # texts that must have a token, or its first letters, for their own score; toxic ones for one above 0
SIGNIFICANT = 0.01
CUT = 0.7
MAX_FIT_ROWS = 200_000
BROADCAST_ROWS = 500_000
MEMO = 100_000
_tokens = re.compile(r"[^\W\d_]+").findall


def segments(scores: Iterable[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, last token, score), in order. Linear in the number of scores."""
    left: list[float] = []  # sums before each segment
    right: list[float] = []  # sums after it
    span: list[tuple[int, int]] = []
    back: list[int] = []  # the nearest earlier segment with a smaller sum before it
    total = 0.0
    for at, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        lo, hi, a = total, total + score, at
        total = hi
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                span.append((a, at))
                back.append(j)
                break
            lo, a = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
    return [(a, b, hi - lo) for (a, b), lo, hi in zip(span, left, right, strict=True)]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    prior: float = -1.0
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    cut: float | None = None
    letters: int = STEM

    def scores(self, tokens: list[str], memo: dict[str, float]) -> list[float]:
        """The score of each token; memo, which the caller keeps, holds those of frequent forms."""
        words, stems, prior, letters = self.words, self.stems, self.prior, self.letters
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for w in tokens:
            s = memo.get(w)
            if s is None:
                s = words.get(w)
                if s is None:
                    s = stems.get(w[:letters], prior)
                memo[w] = s
            out.append(s)
        return out

    def normalised(self, score: float, n: int) -> float:
        """The negative logarithm of how many segments of that score are expected in n tokens."""
        return self.rate * score - math.log(self.scale * max(n, 1))

    def evidence(self, scores: list[float], n: int) -> float:
        """The least logarithm of the expectation over the r best of a text's segment scores (one at least), for each r."""
        least, total = math.inf, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            x = self.normalised(s, n)
            if r > 1 and x <= 0:
                break
            total += x
            tail = (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2.0)
            least = min(least, tail - total)
        return least

    def toxicity(self, scores: list[float], n: int) -> float:
        if self.cut is None or not scores:
            return 0.0
        x = self.cut - self.evidence(scores, n) + math.log(CUT / (1 - CUT))
        return 1 / (1 + math.exp(-min(max(x, -700.0), 700.0)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: dict) -> Iterator[pa.RecordBatch]:
        for toxic, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["token", "toxic", "n"])

    counts: dict[int, Counter] = {}
    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            counts.setdefault(toxic, Counter()).update(set(_tokens((text.as_py() or "").lower())))
            if sum(map(len, counts.values())) > MEMO:
                yield from rows(counts)
                counts = {}
    yield from rows(counts)


def _log_odds(counts: DataFrame) -> Model:
    """The scores of words and first letters, from summed counts (token, toxic, n)."""
    words = counts.groupBy("token").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"y{k}") for k in (0, 1)))
    words = stash(words.withColumn("stem", F.left("token", F.lit(STEM))), "token-counts")
    n0, n1 = words.agg(F.sum("y0"), F.sum("y1")).first()
    if not n0 or not n1:
        return Model()
    base = math.log(n0 / n1)
    stems = stash(words.groupBy("stem").agg(F.sum("y0").alias("s0"), F.sum("y1").alias("s1")).where(f"s0 + s1 >= {LEAST_TEXTS}"), "stem-counts")
    few = stems.count() <= BROADCAST_ROWS  # words then stay where they are, however many share their first letters

    def bound(a: str, b: str, x: str, y: str):
        return F.log(F.expr(a) / F.expr(b)) + F.lit(base) - Z * F.sqrt(1 / (F.col(x) + 0.5) + 1 / (F.col(y) + 0.5))

    def known(score: Column, toxic: str) -> Column:
        return F.when(F.col(toxic) >= LEAST_TEXTS, score).otherwise(F.least(score, F.lit(0.0)))

    scored = stash(stems.withColumn("stem_score", known(bound("s1 + 0.5", "s0 + 0.5", "s1", "s0"), "s1")), "stem-scores")
    share = "(s1 + 0.5) / (s0 + s1 + 1)"
    own = words.join(F.broadcast(scored) if few else scored, "stem").withColumn("score", known(bound(f"y1 + {PRIOR} * {share}", f"y0 + {PRIOR} * (1 - {share})", "y1", "y0"), "y1"))
    model = Model(prior=base - 2 * Z, letters=STEM)
    model.stems = {r[0]: r[1] for r in scored.select("stem", "stem_score").collect()}
    # a word needs an entry where it counts as toxic itself, or its first letters do; else theirs serves as well
    kept = own.where(f"score > 0 or (stem_score > 0 and y0 + y1 >= {LEAST_TEXTS})").select("token", "score")
    model.words = {r[0]: r[1] for r in kept.collect()}
    return model


def _scan(model: Model, extra: list[str]):
    """(extra columns, n, best score, passages, score, evidence, segments and the sum of their scores) of each text; text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        limit = -math.log(SIGNIFICANT)
        for b in batches:
            ns, best, passages, score, evidence, number, total = [], [], [], [], [], [], []
            for x in b.column(len(extra)):
                tokens = _tokens((x.as_py() or "").lower())
                found, n = segments(model.scores(tokens, memo)), len(tokens)
                scores = [s for *_, s in found]
                ns.append(n)
                best.append(max(scores, default=0.0))
                passages.append([{"first": i, "last": j, "score": s} for i, j, s in found if model.normalised(s, n) > limit])
                number.append(len(scores))
                total.append(math.fsum(scores))
                score.append(model.toxicity(scores, n))
                evidence.append(model.evidence(scores, n) if scores else None)
            arrays = [pa.array(ns, pa.int64()), pa.array(best, pa.float64()), pa.array(passages, PASSAGES), pa.array(score, pa.float64()), pa.array(evidence, pa.float64()), pa.array(number, pa.int64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(extra))), *arrays], [*extra, "n_tokens", "best", "passages", "score", "evidence", "n_segments", "summed"])

    return run


PASSAGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
SCANNED = "n_tokens long, best double, passages array<struct<first: long, last: long, score: double>>, score double, evidence double, n_segments long, summed double"


def learnable(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic and calibrates of the labelled texts that may be learned from."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id")))
    rows = marks.count()
    if rows > max_fit_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_fit_rows / rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most max_fit_rows of 12 bytes; of texts that repeat, the one with the smallest id stays
    marks = texts.join(F.broadcast(marks), "doc_id").groupBy(F.xxhash64("text"), F.length("text")).agg(F.min_by(F.struct("doc_id", "toxic"), "doc_id").alias("first")).select("first.*").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stash(marks, "labelled")
    return texts.join(F.broadcast(marks), "doc_id").withColumn("calibrates", calibrates(F.col("doc_id")))


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """The model of labels.toxic over the texts of docs that are not held out."""
    ship(docs.sparkSession)
    own = learnable(docs, labels, max_fit_rows)
    counts = stash(own.where("not calibrates").select("toxic", "text").mapInArrow(_count, "token string, toxic int, n long").groupBy("token", "toxic").agg(F.sum("n").alias("n")), "labelled-tokens")
    model = _log_odds(counts)
    if not any(s > 0 for s in model.stems.values()) and not any(s > 0 for s in model.words.values()):
        return Model()
    held = own.where("calibrates").select("toxic", "text")
    scanned = stash(held.mapInArrow(_scan(model, ["toxic"]), "toxic int, " + SCANNED).drop("passages"), "calibration")
    # the tail of clean texts' segments: their mean gives lambda, their number gives K
    clean, tokens, over, excess = scanned.where("toxic = 0").agg(F.count("*"), F.sum("n_tokens"), F.sum("n_segments"), F.sum("summed")).first()
    if not clean or not tokens:
        return Model()
    model.rate = (over + 1) / (excess + 2.0)
    model.scale = (over + 1) / (tokens + 1)
    # again, with the tail that has been fitted
    scanned = held.mapInArrow(_scan(model, ["toxic"]), "toxic int, " + SCANNED)
    evidence = F.coalesce("evidence", F.lit(200.0))
    bins = scanned.select("toxic", F.round(F.least(F.greatest(evidence, F.lit(-200.0)), F.lit(200.0)) * 4).cast("int").alias("bin")).groupBy("toxic", "bin").count().collect()
    model.cut = _best_cut({(r["toxic"] > 0, r["bin"]): r["count"] for r in bins})
    return model


def calibrates(doc_id: Column) -> Column:
    """Whether a learnable row calibrates the model instead of giving counts."""
    return F.floor(F.crc32(doc_id.cast("string")) / 3) % 3 == 0


def _best_cut(bins: dict[tuple[bool, int], int]) -> float | None:
    """The cut, in quarters, below which F1 is largest; the middle of the cuts that do equally well."""
    toxic = sum(n for (t, _), n in bins.items() if t)
    if not toxic or toxic == sum(bins.values()):
        return None
    best, edges, hit, false = -1.0, [], 0, 0
    places = sorted({b for _, b in bins})
    for k, b in enumerate(places):
        hit, false = hit + bins.get((True, b), 0), false + bins.get((False, b), 0)
        f1 = 2 * hit / (hit + false + toxic)
        if f1 > best:
            upper = places[k + 1] if k + 1 < len(places) else b + 1
            best, edges = f1, [b, upper]
    return (edges[0] + edges[1]) / 8


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, best and passages (first and last token, score) of each row of docs."""
    ship(docs.sparkSession)
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scan(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, " + SCANNED)
    return scanned.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "best", "passages")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    model = fit(docs, labels)
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for b in batches:
            keep = []
            for x in b.column(at):
                tokens = _tokens((x.as_py() or "").lower())
                keep.append(model.toxicity([s for *_, s in segments(model.scores(tokens, memo))], len(tokens)) < CUT)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
