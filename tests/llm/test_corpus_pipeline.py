import os
import subprocess
import sys

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestep.llm import poisson_mix, toxic_segments
from lodestep.llm.queries import QUERIES, tokenizer_path
from lodestep.session import stash
from test_poisson_mix import draw
from test_positional_index import brute as contamination
from test_simhash_bk import one_of_each


def test_stages_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = toxic_segments.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    left = sorted(docs.collect(), key=lambda r: r["doc_id"])
    toxic = {r["doc_id"] for r in toxic_segments.score(docs, model).collect() if r["predicted"]}
    left = [r for r in left if r["doc_id"] not in toxic]
    single = {d for d, _ in one_of_each([(r["doc_id"], r["text"]) for r in left])}
    left = [r for r in left if r["doc_id"] in single]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    dirty = {x[0] for x in contamination([(r["doc_id"], r["text"]) for r in left], items) if x[5]}
    left = [r for r in left if r["doc_id"] not in dirty]
    n = {}
    for r in left:
        n[r["source"]] = n.get(r["source"], 0) + 1
    w = sum(c**poisson_mix.TEMPERATURE for c in n.values())
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in left:
        size = len(t.encode(r["text"], add_special_tokens=False).ids) + 1
        rate = n[r["source"]] ** poisson_mix.TEMPERATURE / w * len(left) / n[r["source"]]
        want += [(r["doc_id"], size)] * draw(r["doc_id"], rate)
    got = sorted(corpus_pipeline.run(spark, tiny).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted(want)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert toxic and dirty and len(corpus_pipeline.STAGES) == 5


def test_filters_leave_the_columns_and_clean_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert stage(spark, docs.where("false"), tiny).count() == 0


def test_queries_are_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES)
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(f"{top}/lodestep"):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "lodestep.llm" not in f.read()


def test_entry_without_the_subpackage():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True)


def test_decontamination_takes_rows_without_an_id(spark, tiny):
    text = spark.read.parquet(f"{tiny}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, text), (None, "own words")], "doc_id long, text string")
    assert [r["text"] for r in corpus_pipeline.decontamination(spark, docs, tiny).collect()] == ["own words"]


def test_files_keep_the_order_of_mixing(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    mixed = stash(corpus_pipeline.mixing(spark, docs, tiny), "mixed")
    rows = [r["doc_id"] for r in mixed.collect()]
    got = [r["doc_id"] for r in sorted(corpus_pipeline.token_ids(spark, mixed, tiny).collect(), key=lambda r: r["start"])]
    assert got == rows and rows != sorted(rows)
    copies = {d for d in rows if rows.count(d) > 1}
    beside = sum(a == b for a, b in zip(rows, rows[1:], strict=False))
    assert copies and beside < len(copies) / 2


def test_mixing_keeps_columns_of_its_own_names(spark, tiny):
    docs = spark.createDataFrame([(k, f"text {k}", "s", k * 10, "own") for k in range(60)], "doc_id long, text string, source string, Copies long, rate string")
    out = corpus_pipeline.mixing(spark, docs, tiny)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r["Copies"] == 10 * r["doc_id"] and r["rate"] == "own" for r in rows)
