"""Host-level quality rules: failures by host, shrunk with an empirical beta prior, joined back to documents.

Each text is measured whole. Per host (``source``) and rule the failures are counted, with partial sums before the shuffle,
and a beta prior is fitted to the hosts' rates by moments (weighted by their documents). A host whose shrunk rate reaches
``max_rate`` for some rule is rejected, with all its documents; a document that fails the base rule goes anyway.

A null text has no words. A null source is no host: its documents stand for themselves. Repeated rows count as often as
they are there. Hosts are broadcast up to ``broadcast_rows`` and shuffled beyond, where AQE splits a hot host's documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.session import ship, stash

WIDTH = 3
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MAX_RATE = 0.5
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > word_chars",
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = WIDTH) -> int:
    """Words that lie in a window of width words which is in the text twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    key = at[: n - width + 1]
    for k in range(1, width):  # numbers of pairs, then of triples: never beyond n * n
        _, key = np.unique(key * len(ids) + at[k : n - width + 1 + k], return_inverse=True)
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines and repeated words of a text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else []
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.array([measure(t.as_py()) for t in b.column(2)], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, k]) for k in range(5))], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five measures of each row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text").mapInArrow(_measured, "doc_id long, host string, " + MEASURES)


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n, the shrunk rate of each rule, and rejected."""
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()))
    hosts = stash(hosts, "hosts")
    mean = {r: F.sum(f"f_{r}") / F.sum("n") for r in RULES}
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *(x.alias(r) for r, x in mean.items())).first()
    if not total["n"]:
        return hosts.select("host", "n", *(F.lit(0.0).alias(f"rate_{r}") for r in RULES), F.lit(False).alias("rejected"))
    spread = hosts.agg(*(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.lit(total[r]), F.lit(2.0))).alias(r) for r in RULES)).first()
    rates = []
    for r in RULES:
        m = total[r]
        within = m * (1 - m)
        between = spread[r] / total["n"] - within * total["hosts"] / total["n"]
        strength = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6  # hosts that differ by chance alone share one rate
        rates.append(((F.col(f"f_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{r}"))
    return hosts.select("host", "n", *rates).withColumn("rejected", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) >= max_rate)


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, the measures, base_failed and kept of each row of docs."""
    measured = stash(measures(docs, host), "measures")
    bad = stash(host_verdicts(measured, max_rate).where("rejected").select("host", F.lit(True).alias("rejected")), "bad-hosts")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    failed = F.expr(f"{RULES['short']} or {RULES['repetitive']}")
    return measured.join(bad, "host", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected").isNull()).alias("kept"))
