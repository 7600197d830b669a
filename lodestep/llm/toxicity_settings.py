"""Compares settings of toxic_segments by the F1 of learnable rows: python -m lodestep.llm.toxicity_settings FOLDER.

Held-out rows are never read. Counts and tail are fitted as toxic_segments does; the cut comes from half of the calibrating rows
and F1 from the other half, and the other way round.
"""

from __future__ import annotations

import sys
from collections import Counter
from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestep.llm import toxic_segments as ts
from lodestep.session import stash, table

GRID = {"STEM": (4, 5, 6), "Z": (2.0, 2.5, 3.0), "LEAST_TEXTS": (2, 3)}


def compare(spark: SparkSession, folder: str) -> list[tuple[float, dict]]:
    """F1 and setting, the best first."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").where(~ts.held_out(F.col("doc_id")))
    docs = stash(docs.where(~ts.held_out(F.col("doc_id"))).select("doc_id", "text"), "learnable")
    held = ts.learnable(docs, labels).where("calibrates").select("doc_id", "toxic", "text")
    kept, found = {k: getattr(ts, k) for k in GRID}, []
    for values in product(*GRID.values()):
        for k, v in zip(GRID, values, strict=True):
            setattr(ts, k, v)
        model = ts.fit(docs, labels)
        rows = held.mapInArrow(ts._scan(model, ["doc_id", "toxic"]), "doc_id long, toxic int, " + ts.SCANNED).select("doc_id", "toxic", "evidence").orderBy("doc_id").collect()
        halves = [[(r["toxic"] > 0, 200.0 if r["evidence"] is None else r["evidence"]) for r in rows[k::2]] for k in (0, 1)]
        hit = false = toxic = 0
        for one, other in (halves, halves[::-1]):
            cut = ts._best_cut(dict(Counter((t, round(min(max(e, -200), 200) * 4)) for t, e in one)))
            said = [(t, cut is not None and e <= cut) for t, e in other]
            hit, false, toxic = hit + sum(t and p for t, p in said), false + sum(p and not t for t, p in said), toxic + sum(t for t, _ in said)
        found.append((2 * hit / max(hit + false + toxic, 1), dict(zip(GRID, values, strict=True))))
    for k, v in kept.items():
        setattr(ts, k, v)
    return sorted(found, key=lambda x: -x[0])


if __name__ == "__main__":
    for f1, setting in compare(SparkSession.builder.getOrCreate(), sys.argv[1]):
        print(f"{f1:.4f}", setting)
