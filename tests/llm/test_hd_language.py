import numpy as np

from lodestep.llm import hd_language as hd
from lodestep.llm.queries import languages


def test_grams_and_bundles_against_a_loop():
    key, count = hd.grams("ab  A-b")
    s = hd.symbols()
    codes = [0, s[ord("a")], s[ord("b")], 0, s[ord("a")], 0, s[ord("b")], 0]
    want, places = np.zeros(hd.DIMENSIONS), hd.letters()
    for t in zip(codes, codes[1:], codes[2:], strict=False):
        want += np.prod([places[k][c] for k, c in enumerate(t)], axis=0)
    assert count.sum() == 6 and (hd.bundle(key, count) == want).all()


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = languages(spark, small).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_ignores_held_out_rows(spark, tiny):
    import zlib

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(hd.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: r for r in hd.identify(d).collect()} for d in (docs, spoiled))
    assert a == b
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in a.items())


def test_nulls_empties_and_no_labels(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(1, None, "aa", 1), (2, "", "aa", 1), (3, "12 #", None, 1), (None, "abc", "bb", 1), (4, "hello there", "aa", 1), (4, "hello there", "aa", 1)]
    got = hd.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    none = hd.identify(spark.createDataFrame([(1, "abc", None, 1)], schema)).first()
    assert none["lang_pred"] == "und" and none["score"] == 0
    assert hd.identify(spark.createDataFrame([], schema)).count() == 0
    assert hd.grams("é" * 500_000)[1].sum() == 500_000


def test_partitions_and_merging_do_not_matter(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("text", "lang")
    a, b = hd.fit(docs.repartition(1)), hd.fit(docs.repartition(7))
    assert list(a) == list(b) and all((a[k] == b[k]).all() for k in a)
    batch = docs.select("lang", "text").where("lang is not null and text is not null").toArrow().to_batches()

    def total():
        sums = {}
        for r in hd._learn(iter(batch)):
            lang = r.column(0)[0].as_py()
            sums[lang] = sums.get(lang, 0) + r.column(2).to_numpy()
        return sums

    whole = total()
    monkeypatch.setattr(hd, "HELD", 1000)
    parts = total()
    assert whole.keys() == parts.keys() and all((whole[k] == parts[k]).all() for k in whole)


def test_the_query_against_plain_python(spark, tmp_path):
    """Vectors made letter by letter and text by text, for the query as a whole."""
    import random
    import zlib

    rng = random.Random(4)
    words = {"aa": ["the", "then", "there", "shell"], "bb": ["der", "das", "über", "schön"], "cc": ["el", "niño", "está", "ola"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randrange(1, 9))), lang) for k, lang in enumerate(rng.choices(list(words), k=60))]
    rows += [(100, None, "aa"), (101, "12 !", "bb"), (102, "Über ÜBER 3 niños", None), (None, "the", "bb")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, score int, margin int, x int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    code = lambda ch: ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) * 2654435761 % 2**32 % (hd.SYMBOLS - 27) if ord(ch) > 127 and ch.isalpha() else 0
    base = np.random.Generator(np.random.PCG64(hd.SEED)).integers(0, 2, (hd.SYMBOLS, hd.DIMENSIONS), np.int8).astype(int) * 2 - 1

    def vector(text):
        codes = [0]
        for c in [*map(code, (text or "").lower()), 0]:
            codes += [c] if c or codes[-1] else []
        out = np.zeros(hd.DIMENSIONS)
        for at in range(len(codes) - 2):
            out += np.roll(base[codes[at]], 2) * np.roll(base[codes[at + 1]], 1) * base[codes[at + 2]]
        return out, any(codes)

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    sums = {}
    for d, t, lang in rows:
        if d is not None and not held(d) and lang and t is not None:
            sums[lang] = sums.get(lang, 0) + vector(t)[0]
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    mean = sum(unit.values()) / len(unit)
    proto = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in unit.items()}
    got = languages(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {d: t for d, t, _ in rows}
    for r in got:
        v, letters = vector(want[r["doc_id"]])
        cosine = {k: float(p @ v / np.linalg.norm(v)) for k, p in proto.items()} if letters else {"und": 0.0}
        best = max(sorted(cosine), key=cosine.__getitem__)
        assert (r["held_out"], r["lang_pred"]) == (held(r["doc_id"]), best) and abs(r["score"] - min(1, max(0, cosine[best]))) < 1e-5
