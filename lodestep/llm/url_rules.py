"""URL filter: host-suffix and path-prefix expressions, matched by short hash prefixes, confirmed by full digests.

A rule is a host and a path; its expression is both together, like ``example.com/en/``. A URL is expanded into the suffixes of
its host and the prefixes of its path that have as many labels and characters as some rule has. Expressions meet rules by
the first 8 hex digits of their SHA-256 alone, the key of the join; rules that share such a prefix come as one list, in which
the full digest and both lengths then confirm. The longest rule wins (the longer host first where two are as long, then block
before allow). Each different URL is judged once. The rules are broadcast up to ``broadcast_rows`` and shuffled beyond.

A null URL, or one without ``://``, has an empty host and path and no rule; without a rule the verdict is ``default``.
Repeated rows are kept. Rules with a null host or path are left out. Other columns of pages and rules are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestep.llm.positional_index import LOWER, UPPER

BROADCAST_ROWS = 500_000
PREFIX = 8


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.expr("substring(after__, char_length(raw__) + 1)")
    return (
        pages.withColumn("after__", F.coalesce(after, F.lit("")))
        .withColumn("raw__", F.regexp_extract("after__", r"^[^/?#]*", 0))
        .withColumn("host", F.translate("raw__", UPPER, LOWER))
        .withColumn("path", F.regexp_extract(rest, r"^[^?#]*", 0))
        .drop("after__", "raw__")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages.

    rules: host, path (with its leading slash) and action (allow or block).
    """
    made = rules.where("host is not null and path is not null").select(F.concat("host", "path").alias("rule"), "action", F.length("host").alias("host_n"), F.length("path").alias("path_n"), F.size(F.split("host", r"\.")).alias("labels"))
    made = made.withColumn("digest", F.sha2("rule", 256))
    shapes = made.agg(F.sort_array(F.collect_set(F.struct("labels", "path_n"))).alias("shapes"))  # as many as rules have shapes
    buckets = made.groupBy(F.left("digest", F.lit(PREFIX)).alias("prefix")).agg(F.collect_list(F.struct("digest", "host_n", "path_n", "rule", "action")).alias("bucket"))
    urls = split_url(pages.select("url").where("url is not null").distinct())
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    fitting = F.filter("shapes", lambda x: (x["labels"] <= labels) & (x["path_n"] <= F.length("path")))
    wide = urls.withColumn("shapes", shapes.scalar()).select("url", "host", "path", F.explode(fitting).alias("x")).select("url", "host", "path", "x.*")
    tried = wide.select("url", F.expr("substring_index(host, '.', -labels)").alias("suffix"), F.expr("left(path, path_n)").alias("start"))
    tried = tried.select("url", F.sha2(F.concat("suffix", "start"), 256).alias("full"), F.length("suffix").alias("sn"), F.length("start").alias("pn"))
    side = F.broadcast(buckets) if rules.count() <= broadcast_rows else buckets
    met = tried.join(side, F.left("full", F.lit(PREFIX)) == F.col("prefix"))
    confirmed = F.filter("bucket", lambda r: (r["digest"] == F.col("full")) & (r["host_n"] == F.col("sn")) & (r["path_n"] == F.col("pn")))
    ranked = F.array_max(F.transform(confirmed, lambda r: F.struct((r["host_n"] + r["path_n"]).alias("size"), r["host_n"].alias("host_n"), (r["action"] == "block").alias("blocks"), r["rule"].alias("rule"), r["action"].alias("action"))))
    best = met.select("url", ranked.alias("r")).where("r is not null").groupBy("url").agg(F.max("r").alias("best"))
    named = best.select(F.col("url").alias("judged"), F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    p = split_url(pages.select("page_id", "url"))
    return p.join(named, p["url"] == named["judged"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
