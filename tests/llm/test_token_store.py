import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestep.llm import token_store as ts
from lodestep.llm.queries import tokenizer_path
from lodestep.session import new_path

PATH = tokenizer_path()
ODD = ["", None, " ", "it's we'll DON'T 'S", "İ ǅ ŉ ſ K Σς ΑΣ ½ ²", "a\x1cb\x85c\xa0d\u2028e", "e\u0301 \u212b ﬁ", "<|startoftext|> x <|endoftext|>", "日本語 텍스트 😀👍🏽 ٣", "x" * 5000, "a1b2 3.14 $$$ ### thoner$$$", "\x00\x7f\xad", "Élan ÜBER Straße ñandú"]


def direct(text):
    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids


def test_both_ways_of_encoding_agree():
    enc, t = ts.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("aàÀbZ '.1½é\n-ſıß") for _ in range(30)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
@settings(deadline=None)
def test_pack_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = ts.pack(v)
    assert len(control) == (len(v) + 3) // 4 and (ts.unpack(control, data, len(v)) == v).all()


def test_damaged_blocks_are_refused():
    raw = ts.block_bytes(np.array([7], "<i8").tobytes(), b"\0", np.array([2], "<u8").tobytes(), np.array([5, 70000], "<u4"), 3)
    ids, nulls, lengths, before, ranked = ts.read_block(raw)
    assert (ids[0], nulls[0], lengths[0], before, ranked.tolist()) == (7, 0, 2, 3, [5, 70000])
    for bad in (raw[:-1], raw[:60] + b"\xff" + raw[61:], b"LSVB0000" + raw[8:]):
        with pytest.raises(ValueError):
            ts.read_block(bad)


@pytest.mark.parametrize("block", [1, 50, 10**6])
def test_files_hold_every_document_in_order(spark, block):
    rows = [(k * 3 % 41, t) for k, t in enumerate(ODD * 3)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = new_path(spark, "store")
    ts.write_store(docs, PATH, path, block_ids=block)
    got = sorted(ts.read_store(spark, path).collect(), key=lambda r: r["start"])
    digests = sorted(ts.read_digests(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r, g in zip(got, digests, strict=True):
        assert r["start"] == g["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == ts.END_ID
        assert g["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == sorted(r[0] for r in rows[:-1])
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got[1:]) == sorted((d, (*direct(t), ts.END_ID)) for d, t in rows[:-1])


def test_frequent_ids_have_low_ranks_and_empty_tables_work(spark):
    path = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([(1, "zebra " * 50)], "doc_id long, text string"), PATH, path)
    raw = spark.read.format("binaryFile").load(f"{path}/ranks.bin").first()["content"]
    assert np.frombuffer(bytes(raw), "<u4")[0] == direct("zebra")[0]
    empty = new_path(spark, "store")
    ts.write_store(spark.createDataFrame([], "doc_id long, text string"), PATH, empty)
    assert ts.read_digests(spark, empty).count() == 0


def test_unpacking_in_steps_and_words_of_two_generations(monkeypatch):
    monkeypatch.setattr(ts, "STEP", 8)
    v = np.random.default_rng(1).integers(0, 1 << 32, 45, dtype=np.uint32) >> np.arange(45, dtype=np.uint32) % 32
    assert (ts.unpack(*ts.pack(v), len(v)) == v).all() and len(ts.unpack(b"", b"", 0)) == 0
    texts = [f"alpha beta{chr(97 + k % 7)} gamma{chr(97 + k % 3)}" for k in range(40)]
    whole = [ts.Encoder(PATH).encode(t) for t in texts]
    monkeypatch.setattr(ts, "CACHE", 3)
    few = ts.Encoder(PATH)
    assert [few.encode(t) for t in texts] == whole and few.kept.old


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "a b", 1, 2, 3, 4), (1, None, 1, 2, 3, 4)], "doc_id long, text string, start int, ids int, n_tokens int, shard int")
    got = ts.round_trip(docs, PATH).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(1, 0, 1), (2, 1, 3)]
