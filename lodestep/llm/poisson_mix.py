"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output divided by its share of the input, times ``epochs``. Each document draws
a number from (seed, doc_id) and inverts the Poisson distribution of its source's rate: that many copies are made, none
included. The copies are dealt to partitions by a hash of (seed, doc_id, copy) and sorted by it there, so the order has
nothing to do with the input's and is the same at each run. Counts per source are summed before their shuffle.

Null sources are one source. A null doc_id draws as the text ``null``. Rows that repeat a doc_id draw the same number. A
source without a weight, or with weight 0, has rate 0. A rate above ``PART`` is drawn in equal parts with numbers of their own, since a sum of
Poisson draws is one of the summed rate, and doubles hold exp(-rate) only so far. The columns ``copies``, ``copy``,
``rate`` and ``order_key`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.session import fresh, stash

SEED = 20
TEMPERATURE = 0.7
PART = 500.0
BROADCAST_ROWS = 200_000
#: What mix() adds.
COLUMNS = ("copies", "copy", "rate", "order_key")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """The cumulative distribution from 0 up to where it is 1 within a double's precision."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    fold = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda a, j: F.struct((a["p"] * rate / j).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * rate / j)).alias("cdf")),
        lambda a: a["cdf"],
    )
    return fold


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """source, n, rate, parts and the cdf of a part of each source.

    weights: source and weight, at any scale. Without them a source's weight is its number of documents to the power
    ``temperature``.
    """
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("mix_n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("mix_n").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double").alias("weight")).groupBy("w_source").agg(F.sum("weight").alias("weight"))
        counts = counts.join(w, counts["mix_source"].eqNullSafe(w["w_source"]), "left").select("mix_source", "mix_n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    counts = stash(counts, "source-counts")
    total = counts.agg(F.sum("mix_n").alias("n"), F.sum("weight").alias("w")).first()
    if not total["w"]:
        return counts.select("mix_source", "mix_n", F.lit(0.0).alias("rate"), F.lit(1).alias("parts"), F.array(F.lit(1.0)).alias("cdf"))
    rate = F.col("weight") / F.lit(total["w"]) * F.lit(float(total["n"]) * epochs) / F.col("mix_n")
    return counts.select("mix_source", "mix_n", rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED, source: str = "source", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, each as often as drawn, in a random order, with copies, copy (from 0), rate and order_key."""
    rates = source_rates(docs, weights, temperature, epochs, source)
    rates = F.broadcast(rates) if rates.count() <= broadcast_rows else rates
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs = docs.drop(*COLUMNS)
    origin, cdf, u, parts = fresh(docs, "mix_source"), fresh(docs, "mix_cdf"), fresh(docs, "mix_u"), fresh(docs, "mix_parts")
    rates = rates.select(F.col("mix_source").alias(origin), "rate", F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    joined = docs.join(rates, docs[source].eqNullSafe(rates[origin])).withColumn(u, uniform(seed, key))
    drawn = lambda x: F.size(F.filter(cdf, lambda c: c <= x))
    more = F.aggregate(F.sequence(F.lit(2), F.col(parts)), drawn(F.col(u)), lambda n, k: n + drawn(uniform(seed, key, F.lit("part"), k.cast("string"))))
    joined = joined.withColumn("copies", F.when(F.col(parts) > 1, more).otherwise(drawn(F.col(u))))
    made = joined.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    made = made.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("copy").cast("string"))))
    return made.select(*docs.columns, "copies", "copy", "rate", "order_key").repartition("order_key").sortWithinPartitions("order_key")
