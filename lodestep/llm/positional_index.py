"""Benchmark decontamination over a stored positional inverted index, with DataFrame functions only.

Each phrase (a window of an item's words) is searched by its three rarest terms. Their frequencies in the corpus come first;
then the postings of these terms, a row (text, term, position) for each place of each different text, are written as a table.
Lists are intersected rarest first: a posting of the first term at p gives the start p - o1, which stays where the second term's
list has start + o2 and the third's start + o3 in the same text. Texts with a start that is left are read again, and
the words at each start are compared with the phrase: exact matches have them all, proximity matches have the rare terms
within ``slop`` words of their offsets. Texts are known by 128 bits of hashes, so copies are searched once, and no row of
docs is shuffled. Terms, phrases and matches are broadcast up to a stated number of rows and shuffled beyond; a shuffled
posting is four numbers.

Null and empty texts have no words: their documents have zero counts, and items without words match nothing. Repeated
rows are judged one by one, by their text, whatever their ids. An item that is repeated, or shares a phrase with others, is listed once. Other
columns are not looked at, and clean() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.session import fresh, stash

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts words before A-Z become lower case.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(text: Column) -> Column:
    """A-Z in lower case. lower() does the same, faster, where no other letter has a lower case."""
    return F.when(text.rlike(r"[^\x00-\x7F&&[\p{javaUpperCase}\p{javaTitleCase}]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), GAP), "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram (words), n and items (ids) for each different window of the items' texts."""
    w = items.select("item_id", words(F.col("text")).alias("w"))
    size = F.size("w")
    grams = F.when(size >= window, F.transform(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).when(size > 0, F.array("w")).otherwise(F.array().cast("array<array<string>>"))
    return w.select("item_id", F.explode(grams).alias("gram")).groupBy("gram").agg(F.collect_set("item_id").alias("items")).withColumn("n", F.size("gram"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def corpus_frequency(docs: DataFrame, terms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """term and its occurrences in the texts of docs, for each of the terms that occurs.

    Words meet terms that go to every task before they are counted; more terms meet the counts, so that no frequent word is shuffled.
    """
    said = docs.select(F.explode(words(F.col("text"))).alias("term"))
    if terms.count() <= broadcast_rows:
        return said.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("cf"))
    return said.groupBy("term").agg(F.count("*").alias("cf")).join(terms, "term")


def text_key(text: str = "text") -> list[Column]:
    """128 bits that stand for a text, as the columns k1 and k2."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def anchored(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """gram_id, gram, n and items of each phrase, its three rarest terms (t1 to t3, hashed) and their offsets (o1 to o3; null in shorter phrases)."""
    grams = stash(phrases(items, window), "phrases").withColumn("gram_id", F.monotonically_increasing_id())
    grams = stash(grams, "numbered-phrases")
    terms = grams.select("gram_id", F.posexplode("gram").alias("off", "term"))
    cf = stash(corpus_frequency(docs, terms.select("term").distinct(), broadcast_rows), "term-frequencies")
    rank = terms.join(cf, "term").groupBy("gram_id").agg(F.array_sort(F.collect_list(F.struct("cf", "off", F.xxhash64("term").alias("t")))).alias("by"))
    picked = rank.select("gram_id", F.size("by").alias("known"), *(x for k in range(3) for x in (F.get("by", F.lit(k))["t"].alias(f"t{k + 1}"), F.get("by", F.lit(k))["off"].alias(f"o{k + 1}"))))
    # a phrase with a term that the corpus lacks is nowhere
    return stash(picked.join(grams, "gram_id").where("known = n").drop("known"), "anchors")


def postings(docs: DataFrame, anchors: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The index of the anchors' terms, written: k1, k2, t and pos, once for each place in each different text."""
    own = anchors.select(F.explode(F.array("t1", "t2", "t3")).alias("t")).where("t is not null").distinct()
    places = docs.select(*text_key(), F.posexplode(words(F.col("text"))).alias("pos", "term")).select("k1", "k2", F.xxhash64("term").alias("t"), "pos")
    return stash(places.join(_small(own, broadcast_rows), "t").distinct(), "postings")


def starts(index: DataFrame, anchors: DataFrame, slop: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """k1, k2, gram_id and start where the lists of a phrase's rare terms meet at their offsets, or within slop words of them."""
    keys = _small(anchors.select("gram_id", *(c for k in (1, 2, 3) for c in (f"t{k}", f"o{k}"))), broadcast_rows)
    found = index.join(keys, index["t"] == keys["t1"]).withColumn("start", F.col("pos") - F.col("o1")).where("start >= 0").drop("t", "pos", "t1", "o1")
    place = lambda k, bit: F.struct(F.lit(bit).alias("bit"), F.col(f"t{k}").alias("t"), (F.col("start") + F.col(f"o{k}")).alias("at"))
    need = F.filter(F.array(place(2, 1), place(3, 2)), lambda x: x["t"].isNotNull())
    found = found.select("k1", "k2", "gram_id", "start", need.alias("need"))
    bits = F.aggregate("need", F.lit(0), lambda s, x: s + x["bit"])
    asked = found.where("size(need) > 0").select("k1", "k2", "gram_id", "start", bits.alias("bits"), F.explode("need").alias("x")).select("k1", "k2", "gram_id", "start", "bits", "x.*")
    if slop:
        asked = asked.withColumn("at", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)))
    asked = asked.withColumnRenamed("at", "pos")
    met = asked.join(index, ["k1", "k2", "t", "pos"]).groupBy("k1", "k2", "gram_id", "start", "bits").agg(F.bit_or("bit").alias("met")).where("met = bits")
    return stash(found.where("size(need) = 0").select("k1", "k2", "gram_id", "start").unionByName(met.select("k1", "k2", "gram_id", "start")).distinct(), "starts")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """k1, k2 and found (start, n, items and exact, by start) of each text with a match."""
    anchors = anchored(docs, items, window, broadcast_rows)
    met = starts(postings(docs, anchors, broadcast_rows), anchors, slop, broadcast_rows)
    by_text = met.join(_small(anchors.select("gram_id", "gram", "n", "items"), broadcast_rows), "gram_id").groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "items", "gram")).alias("tried"))
    by_text = stash(by_text, "tried")
    hashed = docs.select(*text_key(), "text")
    texts = hashed.join(_small(by_text.select("k1", "k2"), broadcast_rows), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    read = texts.select("k1", "k2", words(F.col("text")).alias("w")).join(by_text, ["k1", "k2"])
    checked = F.transform("tried", lambda x: F.struct(x["start"].cast("long").alias("start"), x["n"].cast("long").alias("n"), x["items"].alias("items"), (F.slice("w", x["start"] + 1, x["n"]) == x["gram"]).alias("exact")))
    kept = checked if slop else F.filter(checked, lambda x: x["exact"])
    return stash(read.select("k1", "k2", F.array_sort(kept).alias("found")).where("size(found) > 0"), "matches")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start and exact: places where an item's window has its three rarest terms within slop words of their offsets."""
    found = _small(matches(docs, items, window, slop), BROADCAST_ROWS)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key()).join(found, ["k1", "k2"])
    return met.select("doc_id", F.explode("found").alias("x")).select("doc_id", F.explode("x.items").alias("item_id"), "x.start", "x.exact").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    zero = F.lit(0).cast("long")
    covered = F.aggregate("found", F.struct(zero.alias("hit"), zero.alias("reach")), lambda a, s: F.struct((a["hit"] + F.greatest(zero, s["start"] + s["n"] - F.greatest(s["start"], a["reach"]))).alias("hit"), F.greatest(a["reach"], s["start"] + s["n"]).alias("reach")), lambda a: a["hit"])
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.transform(x["items"], lambda i: i.cast("string"))))))
    hits = _small(matches(docs, items, window, 0, broadcast_rows).select("k1", "k2", covered.alias("hit"), ids.alias("ids")), broadcast_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), RAW_GAP), "")).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.join(hits, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("hit", zero).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose texts have no match, with or without an id."""
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    gone = _small(matches(docs, items, window).select(F.col("k1").alias("g1"), F.col("k2").alias("g2")), broadcast_rows)
    k1, k2 = text_key()
    marked = docs.withColumns({a: k1, b: k2})
    return marked.join(gone, (marked[a] == gone["g1"]) & (marked[b] == gone["g2"]), "left_anti").drop(a, b)
