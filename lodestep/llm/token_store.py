"""Token ids in binary block files: frequency-ranked ids, byte-aligned, with separate control bytes.

Documents are dealt by ranges of doc_id (and of their texts' hashes, so that no id is too large for a task), sorted and tokenised once; the ids go to the shared folder as blocks of whole
documents, with each task's id counts beside them. The counts of the whole corpus rank the ids (1 byte for the 256 most
frequent ones). Each block then becomes one file, coded by numpy; block files are named after their place, written under
another name and renamed, so a task that is run again leaves the same file. Reading decodes by table lookup.

A block file, little-endian: magic, 5 uint64 (documents, ids, ids before the block, control bytes, data bytes), doc_ids
(int64), null marks of doc_ids (uint8), numbers of ids (uint64), control bytes (2 bits for each id: its bytes less 1),
data bytes, and the CRC-32 of all that follows the magic. ``ranks.bin`` holds the id of each rank (uint32).

A null or empty text has only the end id. A null doc_id comes first. Rows that repeat a doc_id are kept, ordered by their
texts' hashes. A document longer than a block has a block of its own.
"""

from __future__ import annotations

import functools
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestep.session import new_path, ship, stash

MAGIC = b"LSVB0001"
END_ID = 1
BLOCK_IDS = 2_000_000
CACHE = 450_000  # words of each of two generations

#: Texts of these characters only are NFC already, and lower-case alike character by character.
PLAIN = r"[\t\n\r\x20-\x7e¡-¬®-įı-ňŊ-ſ]*"
#: The word pattern of tokenizers whose words end at white space, and the rest of their settings.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRETOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: Byte-level symbols: printable bytes stand for themselves, the others for the code points from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _OWN]
_SYMBOL = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(_REST)}


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``.

    Where a tokenizer lower-cases and splits at white space, words are encoded once and kept; unusual characters and
    other tokenizers take the library's own way over the whole text. Both give the same ids.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = parts.get("normalizer") == NORMALIZER and parts.get("pre_tokenizer") == PRETOKENIZER and not parts["model"].get("dropout")
        self.specials = [t["content"] for t in parts.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.typecode = next(c for c in "HILQ" if array(c).itemsize == self.dtype.itemsize)
        self.plain, self.word, self.model = regex.compile(PLAIN).fullmatch, regex.compile(WORD).findall, self.tokenizer.model
        encoder = self

        class Kept(dict):
            """Two generations: what the older one has comes back from there, the rest is encoded."""

            old: dict = {}

            def __missing__(self, chunk: str) -> bytes:
                if (got := self.old.get(chunk)) is not None:
                    self[chunk] = got
                    return got
                pieces = [chunk] if chunk.isalpha() else encoder.word(chunk)
                if len(pieces) == 1:
                    got = encoder.piece(pieces[0])
                else:
                    got = b"".join([self.get(p) or self.setdefault(p, encoder.piece(p)) for p in pieces])
                self[chunk] = got
                return got

        self.kept = Kept()

    def piece(self, word: str) -> bytes:
        symbols = word if word.isascii() else "".join([_SYMBOL[b] for b in word.encode()])
        ids = array(self.typecode, [t.id for t in self.model.tokenize(symbols)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if self.by_word and self.plain(text) and not any(s in text for s in self.specials):
            if len(self.kept) > self.cache:
                self.kept.old = dict(self.kept)
                self.kept.clear()
            return b"".join(map(self.kept.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


@functools.cache
def encoder(path: str, cache: int = CACHE) -> Encoder:
    return Encoder(path, cache)


# Coding


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros((len(v) + 3) // 4 * 4, np.uint8)
    four[: len(v)] = size
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]].tobytes()


#: The four sizes that each control byte stands for.
SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


#: Values that are unpacked at a time, a multiple of four: bounds what a large block needs besides its values.
STEP = 1 << 18


def unpack(control: bytes | memoryview, data: bytes | memoryview, n: int) -> np.ndarray:
    """The n values of pack()."""
    codes, raw, out, at = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.empty(n, np.uint32), 0
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        size = SIZES[codes[lo // 4 : (hi + 3) // 4]].reshape(-1)[: hi - lo]
        ends = np.cumsum(size, dtype=np.int64) + at
        begin, at = ends - size, int(ends[-1])
        part = raw[begin].astype(np.uint32)
        for k in range(1, 4):
            if len(more := np.flatnonzero(size > k)):
                part[more] |= raw[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[lo:hi] = part
    return out


def block_bytes(doc_ids: bytes, nulls: bytes, lengths: bytes, ranked: np.ndarray, before: int) -> bytes:
    control, data = pack(ranked)
    body = b"".join([struct.pack("<5Q", len(nulls), len(ranked), before, len(control), len(data)), doc_ids, nulls, lengths, control, data])
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


def read_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """doc_ids, their null marks, numbers of ids, ids before the block, and ranked ids. Raises ValueError on a damaged block."""
    view = memoryview(raw)
    if view[:8] != MAGIC or zlib.crc32(view[8:-4]) != struct.unpack("<I", view[-4:])[0]:
        raise ValueError("not a whole block of token ids")
    docs, n, before, n_control, n_data = struct.unpack_from("<5Q", view, 8)
    ends = np.cumsum([48, 8 * docs, docs, 8 * docs, n_control, n_data]).tolist()
    part = [view[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return np.frombuffer(part[0], "<i8"), np.frombuffer(part[1], np.uint8), np.frombuffer(part[2], "<u8"), before, unpack(part[3], part[4], n)


# Files


def put(uri: str, content: bytes) -> None:
    """Writes a whole file, or none: under another name first, then renamed."""
    local = uri.removeprefix("file://") if uri.startswith(("file://", "/")) else uri.removeprefix("file:") if uri.startswith("file:") else None
    mark = f".{os.getpid()}-{os.urandom(4).hex()}.part"
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local + mark, "wb") as f:
            f.write(content)
        os.replace(local + mark, local)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path + mark) as f:
        f.write(content)
    store.move(path + mark, path)


BLOCK = "shard int, block int, before long, n long, doc_ids binary, nulls binary, lengths binary, ids binary, counts binary"


def _tokenise(path: str, end_id: int, block_ids: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, cache)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        shard, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        counts = np.zeros(max(enc.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        ids, doc_ids, nulls, lengths = [], [], [], []

        def row(last: bool = False) -> pa.RecordBatch:
            raw = b"".join(ids)
            counts[:] += np.bincount(np.frombuffer(raw, enc.dtype), minlength=len(counts))
            values = [shard, block, before, held, np.array(doc_ids, "<i8").tobytes(), bytes(nulls), np.array(lengths, "<u8").tobytes(), raw, counts.tobytes() if last else None]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = enc.encode(text.as_py() or "") + end
                if held and held + len(raw) // width > block_ids:
                    yield row()
                    block, before, held = block + 1, before + held, 0
                    ids, doc_ids, nulls, lengths = [], [], [], []
                ids.append(raw)
                doc_ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                lengths.append(len(raw) // width)
                held += len(raw) // width
        if held:
            yield row(True)

    return run


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, as_is: bool = False, cache: int = CACHE) -> None:
    """Writes the block files of docs in ascending order of doc_id, and ranks.bin; as_is: in the order of docs' partitions and rows.

    The order as it is must be that of stored rows, which come again in the same partitions. cache: words that a generation holds. The driver
    gets the counts of each id (as many as the vocabulary has) and a number for each task.
    """
    spark = docs.sparkSession
    ship(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not as_is:
        ordered = ordered.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = stash(ordered.mapInArrow(_tokenise(tokenizer, end_id, block_ids, cache), BLOCK), "token-blocks")
    enc = encoder(tokenizer)
    width = max(enc.tokenizer.get_vocab_size(), end_id + 1)
    counts = np.zeros(width, np.int64)
    per_id = blocks.where("counts is not null").select("counts").mapInArrow(_summed(width), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in per_id.toLocalIterator():
        counts[r["id"]] = r["n"]
    id_of = np.lexsort((np.arange(width), -counts)).astype("<u4")
    rank_of = np.empty(width, "<u4")
    rank_of[id_of] = np.arange(width)
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    first, at = {}, 0
    for shard in sorted(totals):
        first[shard], at = at, at + totals[shard]
    dtype = enc.dtype.str

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, block, before, doc_ids, nulls, lengths, ids = (b.column(c)[k].as_py() for c in range(7))
                put(f"{path}/{shard:06d}-{block:06d}.lsvb", block_bytes(doc_ids, nulls, lengths, rank_of[np.frombuffer(ids, dtype)], first[shard] + before))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    put(f"{path}/ranks.bin", id_of.tobytes())
    blocks.select("shard", "block", "before", "doc_ids", "nulls", "lengths", "ids").mapInArrow(write, "n long").agg(F.sum("n")).first()


def _summed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "n"])

    return run


def _read(spark: SparkSession, path: str, columns: dict, value) -> DataFrame:
    ship(spark)
    raw = spark.read.format("binaryFile").load(f"{path}/ranks.bin").select("content").first()
    id_of = np.frombuffer(bytes(raw[0]), "<u4")
    names = ["doc_id", "start", "n_tokens", *columns]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                doc_ids, nulls, lengths, before, ranked = read_block(x.as_py())
                ids = id_of[ranked]
                ends = np.cumsum(lengths.astype(np.int64))
                begin = ends - lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(begin + before), pa.array(ends - begin), value(ids, begin, ends)], names)

    schema = "doc_id long, start long, n_tokens long, " + ", ".join(f"{k} {v}" for k, v in columns.items())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lsvb").load(path).select("content")
    return files.mapInArrow(decode, schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document in the block files under path."""

    def lists(ids: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(begin, ends[-1:] if len(ends) else [0]), pa.int32()), pa.array(ids, pa.int64()))

    return _read(spark, path, {"ids": "array<long>"}, lists)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document."""

    def digests(ids: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> pa.Array:
        raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.int64())

    return _read(spark, path, {"ids_crc32": "long"}, digests)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, as_is: bool = False, cache: int = CACHE) -> DataFrame:
    """Writes docs to new block files in the shared folder and returns the digests that are read back from them."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write_store(docs, tokenizer, path, end_id, block_ids, as_is, cache)
    return read_digests(spark, path)
