"""The operators applied to whole tables, one query each, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.llm import feistel_pii, hd_language, host_rules, lattice_hash, poisson_mix, positional_index, prefix_trie, simhash_bk, spelling_variants, token_store, tool_calls, toxic_segments, url_rules
from lodestep.session import table

#: The rules of the URL filter: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Keys the pseudonyms; a deployment passes its own secret.
PII_KEY = "pseudonym-key-1"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer, which every machine has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_language.identify(table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.format_turns(table(spark, sf_dir, "conversations"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "source", "copies", "copy", F.round("rate", 6).alias("rate"), "order_key")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_segments.score(docs, toxic_segments.fit(docs, table(spark, sf_dir, "labels")))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_groups(table(spark, sf_dir, "documents"))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_hash.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_feistel_pii": pseudonyms,
    "op2_hd_language": languages,
    "op3_decontamination": decontamination,
    "op4_host_rules": host_quality,
    "op5_tool_calls": chat_lines,
    "op6_poisson_mix": mixture,
    "op7_token_store": token_ids,
    "op8_toxic_segments": toxicity,
    "op9_simhash_bk": simhash,
    "op10_url_rules": url_filter,
    "op11_prefix_trie": conversation_trie,
    "op12_spelling_variants": spelling,
    "op13_lattice_hash": embedding_copies,
}
