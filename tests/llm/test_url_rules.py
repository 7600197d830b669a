import random
import re
import re

from lodestep.llm import url_rules as ur
from lodestep.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match("[^/?#]*", after)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match("[^?#]*", after[len(raw) :])[0]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def run(spark, urls, rules, **more):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    r = spark.createDataFrame(rules, "host string, path string, action string")
    return {x["page_id"]: tuple(x)[1:] for x in ur.judge(pages, r, **more).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "https://xexample.com/en/a", "http://u@É.net:80/es/q", "http://x.net?/es/", "a://b://c.net/fr/"]
    urls += ["http://" + rng.choice(["", "www.", "a.b."]) + rng.choice(["example.com", "t.net", "com", "net.com"]) + rng.choice(["", "/", "/en", "/en/", "/es/a", "/fr/x?en"]) for _ in range(200)]
    more = [*URL_RULES, (None, "/", "block"), ("net", None, "block"), ("t.net", "/e", "block"), ("t.net", "/e", "allow"), ("com", "", "block"), ("", "/", "block"), ("www.t.net", "/", "allow")]
    for rules in (URL_RULES, more):
        assert run(spark, urls, rules) == {k: brute(u, rules) for k, u in enumerate(urls)}
    assert run(spark, urls, more, broadcast_rows=0, default="block") == {k: brute(u, more, "block") for k, u in enumerate(urls)}


def test_repeats_long_urls_and_empty_tables(spark):
    long = "http://" + "a." * 200 + "com/" + "x/" * 5000
    assert run(spark, [long, long], URL_RULES)[1] == brute(long, URL_RULES)
    assert run(spark, [], URL_RULES) == {} and run(spark, ["http://com/"], [])[0][3] == "allow"


def test_hosts_of_many_labels_and_the_key_of_the_join(spark):
    urls = ["http://" + "a." * 60_000 + "net/es/x", "http://" + "." * 20_000 + "example.com/en/"]
    assert run(spark, urls, URL_RULES) == {k: brute(u, URL_RULES) for k, u in enumerate(urls)}
    pages = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    r = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    plan = ur.judge(pages, r)._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert re.search(r"BroadcastHashJoin \[(substring|left)\(full#\d+, 1, 8\)\], \[prefix#\d+\], Inner", join)


def test_rules_whose_hash_prefixes_collide(spark, monkeypatch):
    monkeypatch.setattr(ur, "PREFIX", 0)
    urls = ["http://a.example.com/en/", "http://com/", "http://q.net/fr/", None]
    assert run(spark, urls, URL_RULES) == {k: brute(u, URL_RULES) for k, u in enumerate(urls)}


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/", 5, 6, 7)], "page_id long, url string, path int, bucket int, rule int")
    rules = spark.createDataFrame([("net", "/es/", "block", 1, 2)], "host string, path string, action string, digest int, url int")
    assert tuple(ur.judge(pages, rules).first()) == (1, "x.net", "/es/", "net/es/", "block")
