"""BPE encoding and decoding for vocabularies with word ends.

A word's symbols form a doubly linked list; a heap holds the possible merges by rank, then
place. A popped merge is stale, and skipped, when its two symbols no longer stand there side by
side. Decoding joins the strings of the vocabulary.

Results equal those of the tokenizers library for the same file: normalisation (NFC, white
space to one blank, lower case), splitting into words and special tokens inside texts
included. Null texts are empty; an empty text has no ids. Words may be of any length. An empty
table gives an empty result; further columns are kept by encode() and decode() unless they
bear the name of the new column, which they then yield to.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, table, whole
from .vocab import LETTERS, NUMBERS, SAFE, Memo, byte_chars, kept, public

_WORDS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{LETTERS}{NUMBERS}]+")


class Codec:
    """Of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_file(path)  # for rare characters' normalisation only
        self.chars = byte_chars()
        self.inner = [ids[c] for c in self.chars]
        self.last = [ids[c + end] for c in self.chars]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.byte_of = {c: b for b, c in enumerate(self.chars)}
        self.words = Memo(lambda w: np.array(self.merged(w.encode()), "<u4").tobytes())

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word."""
        own = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        n, merges = len(own), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(own, own[1:], strict=False)) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = right[i]
            if own[i] != a or j < 0 or own[j] != b:
                continue  # stale
            own[i], own[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((new, own[k])):
                    heapq.heappush(heap, (*m, i, new, own[k]))
            h = left[i]
            if h >= 0 and (m := merges.get((own[h], new))):
                heapq.heappush(heap, (*m, h, own[h], new))
        return [x for x in own if x >= 0]

    def _plain(self, text: str) -> bytes:
        if SAFE.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self.words[bytes(self.byte_of[c] for c in w).decode("utf-8")] for w, _ in found if w)

    def encode(self, text: str) -> np.ndarray:
        if "<|" not in text:
            return np.frombuffer(self._plain(text), "<u4")
        parts = [np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(self.split.split(text))]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@kept
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)))


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != column.lower()]).add(column, kind)


def _put(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    keep = [k for k, name in enumerate(batch.schema.names) if name.lower() != column.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), values], names=[*(batch.schema.names[k] for k in keep), column])


def encode(spark: SparkSession, df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with the ids of each text."""
    bounded_batches(spark)

    def run(batches):
        own = codec(path)
        for b in batches:
            yield _put(b, out, _lists([own.encode(t or "") for t in b.column(text).to_pylist()]))

    return df.mapInArrow(lean(run), _with(df, out, T.ArrayType(T.IntegerType())))


def decode(spark: SparkSession, df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the text that each list of ids stands for; null ids give null."""
    bounded_batches(spark)

    def run(batches):
        own = codec(path)
        for b in batches:
            yield _put(b, out, pa.array([None if x is None else own.decode(np.array(x, "<u4")) for x in b.column(ids).to_pylist()], pa.string()))

    return df.mapInArrow(lean(run), _with(df, out, T.StringType()))


def encode_decode(spark: SparkSession, df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass, which takes one Python worker where two passes take two."""
    bounded_batches(spark)

    def run(batches):
        own = codec(path)
        for b in batches:
            found = [own.encode(t or "") for t in b.column(text).to_pylist()]
            yield _put(_put(b, ids, _lists(found)), out, pa.array([own.decode(x) for x in found], pa.string()))

    first = T.StructType([f for f in df.schema.fields if f.name.lower() not in (ids.lower(), out.lower())])
    return df.mapInArrow(lean(run), first.add(ids, T.ArrayType(T.IntegerType())).add(out, T.StringType()))


def round_trips(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, in one pass."""
    bounded_batches(spark)

    def run(batches):
        own = codec(path)
        for b in batches:
            ids = [own.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in ids],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(spark, table(spark, sf_dir, "documents"), public("word_bpe_49k.json"))
