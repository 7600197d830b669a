"""The corpus pipeline: stages that each take the documents which the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestep.llm import poisson_mix, positional_index, simhash_bk, token_store, toxic_segments
from lodestep.llm.queries import tokenizer_path
from lodestep.session import fresh, stash, table


#: Words that a tokenizing worker keeps: beside what the stages before have left in an executor there is less room than a single query has.
CACHE = 150_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxic_segments.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash_bk.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return positional_index.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate makes it, in a random order. Columns that mix() would replace go along under other names."""
    names = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in poisson_mix.COLUMNS}
    own = [names.get(c, c) for c in docs.columns]
    return poisson_mix.mix(docs.withColumnsRenamed(names)).select(*own).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Block files of token ids in the order that mixing has written, and what is read back from them: a row for each copy of a document."""
    return token_store.round_trip(docs, tokenizer_path(), as_is=True, cache=CACHE)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The tokenizer, the segment search and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
