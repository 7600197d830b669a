"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a seed; other letters than a-z share a fixed number of vectors
by code point. An n-gram's vector binds (multiplies) its letters' vectors, each permuted (rotated) by its place. A text's
vector bundles (adds) those of its n-grams, and a language's prototype those of all its training texts. A text gets the
language whose prototype has the largest cosine with it. Words are set off by one boundary symbol; case does not count.

Prototypes are summed exactly, in integers, before the shuffle and after it; the driver gets one vector a language, and a
closure carries them to the tasks, so their size follows the number of languages, not of texts. The common part of all
prototypes is taken off first (their mean), since it says nothing about a language.

A null text, or one without letters, is ``und`` with score 0, as is every text when nothing was learned. A null lang or
doc_id is not learned from. Ties go to the first language by name. Repeated rows count as often as they are there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.session import ship, stash

DIMENSIONS = 1024
ORDER = 3
SYMBOLS = 128  # 0 is the boundary, 1 to 26 are a to z, the rest are shared by all other letters
SEED = 7
UNKNOWN = "und"
CHUNK = 4096
HELD = 500_000  # n-grams of texts that are held before they are merged and bundled


@functools.cache
def symbols() -> np.ndarray:
    """The symbol of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if 97 <= cp <= 122:
            out[cp] = cp - 96
        elif cp > 127 and chr(cp).isalpha():
            out[cp] = 27 + cp * 2654435761 % (1 << 32) % (SYMBOLS - 27)
    return out


@functools.cache
def letters() -> tuple[np.ndarray, ...]:
    """Each symbol's vector, permuted for each place in an n-gram."""
    base = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (SYMBOLS, DIMENSIONS), np.int8) * np.int8(2) - np.int8(1)
    return tuple(np.roll(base, ORDER - 1 - k, 1) for k in range(ORDER))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, as numbers, and how often each occurs."""
    code = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    code = np.concatenate([[0], code, [0]])
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    if len(code) < ORDER:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    key = code[: len(code) - ORDER + 1]
    for k in range(1, ORDER):
        key = key * SYMBOLS + code[k : len(code) - ORDER + 1 + k]
    return np.unique(key, return_counts=True)


def bundle(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The summed vectors of n-grams; whole numbers, exact in a double."""
    out, places = np.zeros(DIMENSIONS), letters()
    for at in range(0, len(key), CHUNK):
        part = key[at : at + CHUNK]
        bound = None
        for k in range(ORDER - 1, -1, -1):
            v = places[k][part % SYMBOLS]
            part = part // SYMBOLS
            bound = v if bound is None else bound * v
        # sums of up to 2 ** 24 are exact in a float; more, from texts of many millions of letters, take doubles
        c = count[at : at + CHUNK]
        kind = np.float32 if c.sum() < 1 << 24 else np.float64
        out += c.astype(kind) @ bound.astype(kind)
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per language; each text's n-grams are its own, so that batches and partitions do not matter."""
    sums: dict[str, np.ndarray] = {}
    own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def merge() -> None:
        for lang, parts in own.items():
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            count = np.bincount(at, np.concatenate([c for _, c in parts]), len(key))
            sums[lang] = sums.get(lang, 0) + bundle(key, count)
        own.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = grams(text.as_py())
            own.setdefault(lang, []).append(part)
            held += len(part[0])
            if held > HELD:
                merge()
                held = 0
        if len(sums) > 256:
            yield from _vectors(sums)
            sums.clear()
    merge()
    yield from _vectors(sums)


def _vectors(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(v.astype(np.int64))], ["lang", "d", "x"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """A prototype for each lang of labelled (text, lang), of length 1, less the prototypes' mean."""
    ship(labelled.sparkSession)
    sums = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_learn, "lang string, d int, x long").groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in stash(sums, "language-sums").toLocalIterator():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["x"]
    found = {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}
    if len(found) > 1:
        mean = sum(found.values()) / len(found)
        found = {k: v - mean for k, v in found.items()}
    return {k: v / np.linalg.norm(v) for k, v in found.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score (how far the best cosine lies above 0, at most 1) and margin (to the second)."""
    ship(docs.sparkSession)
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names]).reshape(-1, DIMENSIONS).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, margin = [], [], []
            for x in b.column(2):
                key, count = grams(x.as_py() or "")
                v = bundle(key, count).astype(np.float32) if len(names) else np.zeros(0)
                size = float(np.linalg.norm(v))
                if not size or not key.any():
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                cosine = (matrix @ v / size).tolist()
                best = max(range(len(names)), key=cosine.__getitem__)
                pred.append(names[best])
                score.append(min(1.0, max(0.0, cosine[best])))
                margin.append(cosine[best] - max([c for k, c in enumerate(cosine) if k != best], default=0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of docs that are not held out and predicts all."""
    return predict(docs, fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))))
