"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector in its top four bits and as many ids as fit at the selector's
width in the other sixty. Selector 0 is the escape: the next word is one id as it stands, for
values of sixty bits and more. A block holds whole documents, a list of their lengths, its
words, and for every 256th word how many ids come before it, so that any part decodes without
the rest and a whole block decodes in a few array operations.

Files are Parquet, written by Spark with one block a row, so a lost executor leaves no half
file. Documents stand in ascending order of (id, hash of the text): `part` numbers the ranges,
`block` the blocks in one. Null texts are empty and hold only the end id; null document ids
come first; repeated ids are separate documents. No documents give no blocks.
Other columns, whatever their names, are left out. `read_range` decodes a stretch of the whole
sequence of ids: of a block it unpacks only the words from the last offset before the stretch on.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, rows_of, shared_dir, table, whole
from .vocab import LETTERS, NUMBERS, SAFE, Memo, byte_chars, kept, public

#: Fixed by the coding: ids in a word and bits of each, by selector; 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
EVERY = 256  # words between two offsets
BLOCK_IDS = 1 << 16
END = 2

SCHEMA = "part long, block long, first long, n_ids long, doc_ids array<long>, counts array<long>, words binary, offsets binary"

#: The alternatives that most pieces take stand first; no two of the first three can begin alike.
_PIECES = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+")
_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def packed(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit ids; each word takes as many as it can."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    high = int(ids.max()).bit_length()
    top = min((k for k in range(1, 16) if BITS[k] >= high), default=15)  # all fit at this width
    best = np.full(n, top, np.int8)
    if high > 60:
        best[ids >= 1 << 60] = 0
    fits = best > 0
    for s in range(top - 1, 0, -1):  # a narrower selector fits only where the next wider one does
        wide = np.zeros(n + COUNTS[s] + 1, np.int32)
        np.cumsum(ids >= 1 << int(BITS[s]), dtype=np.int32, out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        fits &= wide[COUNTS[s] : n + COUNTS[s]] == wide[:n]
        if not fits.any():
            break
        best[fits] = s
    step = COUNTS.astype(np.uint8)[best].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    ids = ids.astype(np.uint64)
    at = np.array(at)
    sel = best[at]
    room = 1 + (sel == 0)
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(120, np.uint64)])
    for s in np.unique(sel).tolist():
        own = sel == s
        if s == 0:
            out[place[own] + 1] = ids[at[own]]
            continue
        word = np.full(int(own.sum()), np.uint64(s) << np.uint64(60))
        if BITS[s]:
            for j in range(COUNTS[s]):
                word |= padded[at[own] + j] << np.uint64(j * BITS[s])
        out[place[own]] = word
    return out


def offsets(words: np.ndarray, n: int) -> np.ndarray:
    """Ids before every 256th word; an escape's second word counts as none."""
    count = _counts(words)
    return np.minimum(np.concatenate([[0], np.cumsum(count)])[:-1][::EVERY], n).astype(np.int32)


def _raw(words: np.ndarray) -> np.ndarray:
    """Which words are an escape's second."""
    top = words >> np.uint64(60) == 0
    if not top.any():
        return top
    # in a run of words with an empty top, every second one follows an escape
    place = np.arange(len(words))
    start = np.maximum.accumulate(np.where(top & ~np.concatenate([[False], top[:-1]]), place, -1))
    raw = top & ((place - start) % 2 == 1)
    after = np.concatenate([[False], (top & ~raw)[:-1]])
    return raw | after


def _counts(words: np.ndarray) -> np.ndarray:
    return np.where(_raw(words), 0, COUNTS[(words >> np.uint64(60)).astype(np.int64)])


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that packed() coded."""
    raw = _raw(words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(raw, 0, COUNTS[sel])
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel[~raw]).tolist():
        own = np.flatnonzero((sel == s) & ~raw)
        if s == 0:
            out[place[own]] = words[own + 1]
        elif BITS[s]:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                out[place[own] + j] = words[own] >> np.uint64(j * BITS[s]) & mask
    return out[:n]


class Encoder:
    """The library's ids; a text of common characters is split here and each piece goes through the library's model once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chars = byte_chars()
        self.ascii = {b: c for b, c in enumerate(self.chars[:128])}
        self.pieces = Memo(self._piece, most=1_200_000)

    def _piece(self, piece: str) -> bytes:
        shown = piece.translate(self.ascii) if piece.isascii() else "".join([self.chars[b] for b in piece.encode()])
        return array("I", [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def coded(self, text: str) -> bytes:
        """The text's ids, four bytes each."""
        if SAFE.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, (_ASCII if text.isascii() else _PIECES).findall(text)))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.coded(text), "<u4")


@kept
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _blocks(path: str, end: int):
    def run(batches):
        own, part, block, first = encoder(path), TaskContext.get().partitionId(), 0, 0
        docs, lists, n = [], [], 0

        def row():
            ids = np.frombuffer(b"".join(lists), "<u4")
            words = packed(ids)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), pa.array([first]), pa.array([len(ids)]), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in lists]], pa.list_(pa.int64())), pa.array([words.tobytes()]), pa.array([offsets(words, len(ids)).tobytes()])], names=["part", "block", "first", "n_ids", "doc_ids", "counts", "words", "offsets"])

        tail = np.array([end], "<u4").tobytes()
        for doc, text in rows_of(batches, ("doc_id", "text")):
            docs.append(doc)
            lists.append(own.coded(text) + tail)
            n += len(lists[-1]) // 4
            if n >= BLOCK_IDS:
                yield row()
                block, first = block + 1, first + n
                docs, lists, n = [], [], 0
        if docs:
            yield row()

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, to: str, end: int = END) -> None:
    """Encode all texts and write their ids, each document's followed by `end`, in order of doc_id."""
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie").mapInArrow(lean(_blocks(tokenizer, end)), SCHEMA).write.parquet(to)


def _checked(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = unpacked(np.frombuffer(r["words"], np.uint64), r["n_ids"]).astype("<u4").tobytes()
            count = np.array(r["counts"], np.int64)
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(count), r["part"]), "doc_id": pa.array(r["doc_ids"], pa.int64()), "place": r["first"] + ends - count, "n_tokens": count,
                "ids_crc32": pa.array([zlib.crc32(ids[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)], pa.int64()),
            })


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    bounded_batches(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    base = spark.createDataFrame(_bases(files), "part long, base long")
    docs = files.mapInArrow(lean(_checked), "part long, doc_id long, place long, n_tokens long, ids_crc32 long")
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _spans(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = unpacked(np.frombuffer(r["words"], np.uint64), r["n_ids"]).astype(np.int64)
            ends = np.cumsum([0, *r["counts"]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "token_ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids, the end id included."""
    bounded_batches(spark)
    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(lean(_spans), "doc_id long, token_ids array<long>")


def _bases(files: DataFrame) -> list[tuple[int, int]]:
    """Ids before each part, which is a range of documents: a row for each."""
    totals = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *(r["n"] for r in totals)]).tolist()
    return [(r["part"], b) for r, b in zip(totals, before, strict=False)]


def stretch(words: np.ndarray, before: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    """Ids [lo, hi) of a block of n ids, from its words and offsets; words outside are not looked at."""
    lo, hi = max(lo, 0), min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint64)
    a = int(np.searchsorted(before, lo, "right")) - 1
    b = int(np.searchsorted(before, hi, "left"))
    own = words[a * EVERY : b * EVERY]
    first = int(before[a])
    if a and int(_raw(words[: a * EVERY + 1])[-1]):  # an escape's second word; its id counts before
        own = own[1:]
    if b * EVERY < len(words) and len(own) and own[-1] >> np.uint64(60) == 0:
        own = np.append(own, words[b * EVERY])
    return unpacked(own, (int(before[b]) if b < len(before) else n) - first)[lo - first : hi - first]


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """start, ids: ids [start, end) of all documents end to end, in rows of neighbours; other blocks are not read."""
    bounded_batches(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    base = spark.createDataFrame(_bases(files), "part long, base long")
    near = files.join(F.broadcast(base), "part").withColumn("from", F.col("base") + F.col("first")).where((F.col("from") < end) & (F.col("from") + F.col("n_ids") > start))

    def run(batches):
        for n, words, before, at in rows_of(batches, ("n_ids", "words", "offsets", "from")):
            ids = stretch(np.frombuffer(words, np.uint64), np.frombuffer(before, np.int32), n, start - at, end - at)
            yield pa.RecordBatch.from_arrays([pa.array([max(start, at)], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return near.select("n_ids", "words", "offsets", "from").mapInArrow(lean(run), "start long, ids array<long>")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/shardloom-{uuid.uuid4().hex}/tokens"
    write_tokens(spark, table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"), to)
    return read_tokens(spark, to)
