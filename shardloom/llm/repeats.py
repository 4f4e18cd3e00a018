"""Removal of byte strings that repeat, by a distributed difference cover.

A byte goes if it lies in a string of WINDOW bytes that also starts anywhere else. The
difference cover of period V makes the sample: positions whose residue is in D. For any two
starts i and j there is a k < V with i + k and j + k both sampled, so two equal windows hold
two equal tuples of TUPLE = WINDOW - V + 1 bytes at sampled places. With V = 3 these would be
the triples of the skew algorithm; as only prefixes of WINDOW bytes are ever compared, a wider
period needs no more than one level of names.

1. Sampled tuples are named (a fingerprint) and sorted by name in buckets. Names that stand
   alone end here. If all places of a name have one residue, only the first residue of D stays:
   the pairs meet there as well. A name with more than LOCAL places among those that a task holds at a time
   is settled as repeated there: its places go straight to their texts, and only a mark goes to
   the name's bucket. Buckets are as many as the texts' bytes ask for.
2. What stays joins its text. A place stands for the V - 1 bytes before it and the WINDOW bytes
   from it, its context: all windows that begin in the period before the place. First only a
   fingerprint of the context goes to the name's bucket. Places with equal contexts are settled,
   and one of each different context stays if there are several. These bring the contexts
   themselves: sorted by name, the remaining starts are merged, and neighbours with equal windows
   mark each other. So what is sent follows the number of different contexts, not of copies.
   A name with more than HOT places would bring its whole group to one task. Its starts are
   named by whole windows instead, which spread over all buckets, and equal ones in a task are
   merged before they are sent.
3. Marked starts are gathered by text.

Names and windows are 64-bit polynomial fingerprints over random byte values (names are cut to
32 bits inside their bucket and checked again as windows); texts are known by 64-bit hashes.

Exact copies need no search: a text that occurs twice goes as a whole if it has WINDOW bytes,
and counts once as a partner of others. Null texts are empty; texts shorter than WINDOW keep
all. Text is held as UTF-8 bytes; repeated ids and null ids are documents like others. Long
texts are worked on in pieces. An empty table gives an empty result. Other columns stay, whatever
their names are; of `repeated` alone, columns called _key, _copies or _spans are replaced.

In place of ranks, names are hashes, and only equal windows need to meet, so there is no ordered
merge of suffixes.

The same works over words (runs between white space, each known by a 40-bit hash) in place of
bytes: a Cover says which, and how long a window is. WORDS finds passages of over 50 words however
few bytes they have; bytes find long strings of few words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, lean, lean_group, mixed, runs, spread, table, whole

WINDOW = 400
V = 273
#: Fixed: a perfect difference set modulo 273; every difference occurs once.
D = np.array([1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256])
TUPLE = WINDOW - V + 1
HOT, LOCAL = 4096, 4096
PIECE = 1 << 20
#: Bytes of text for each bucket of names or windows; names and pieces that a task holds before it deals them to the buckets.
BUCKET_BYTES, HELD_NAMES, HELD_PIECES = 32 << 20, 1 << 21, 4
#: Of buckets at least; a text gives a row to each that holds a name of it, so their number must not follow the session.
LEAST_BUCKETS = 64

_NAME = np.dtype([("name", "<u4"), ("key", "<i8"), ("pos", "<u4")])
_HEAD = np.dtype([("name", "<u8"), ("key", "<i8"), ("pos", "<u4"), ("left", "<u2"), ("right", "<u2")])
_SEEN = np.dtype([("name", "<u4"), ("context", "<u8"), ("key", "<i8"), ("pos", "<u4"), ("left", "<u2"), ("right", "<u2")])
_FINE = np.dtype([("hash", "<u8"), ("key", "<i8"), ("pos", "<u4")])
_SPAN = np.dtype([("lo", "<u4"), ("hi", "<u4")])
_FLAG = np.uint32(1 << 31)
_MARK = np.uint32(0xFFFFFFFF)  # no place, but says that the name is hot
_BASE = 0x5851F42D4C957F2D


_WORD_BYTES = 5
_RUN = re.compile(r"\S+")


class Cover(NamedTuple):
    """What windows are made of, their length, and the difference cover: every difference modulo the period is one of two residues."""

    word: bool
    window: int
    period: int
    residues: tuple
    piece: int

    @property
    def tuple(self) -> int:
        return self.window - self.period + 1

    def units(self, text: str) -> np.ndarray:
        if not self.word:
            return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        words = text.split()
        return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64((1 << 8 * _WORD_BYTES) - 1)

    def sampled(self, n: int, end: int, start: int = 0) -> np.ndarray:
        """Sampled positions in [start, end) at which a tuple fits into n units."""
        end = min(end, n - self.tuple + 1)
        first, v = start // self.period, self.period
        at = ((np.arange(first, max(first, -(-end // v))) * v)[:, None] + np.array(self.residues)).ravel()
        return at[(at >= start) & (at < end)]


BYTES = Cover(False, WINDOW, V, tuple(D.tolist()), PIECE)
#: Fixed: a perfect difference set modulo 31.
WORDS = Cover(True, 51, 31, (0, 1, 3, 8, 12, 18), PIECE >> 2)


@lru_cache(1)
def _bytes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _pack(x: np.ndarray) -> bytes:
    """Rows column by column: the first column is random and stays, keys come in runs, and the others are small numbers, taken byte by byte."""
    head, *rest = x.dtype.names
    cols = (x[n].tobytes() if n == "key" else np.frombuffer(x[n].tobytes(), np.uint8).reshape(len(x), x[n].itemsize).T.tobytes() for n in rest)
    return len(x).to_bytes(4, "little") + x[head].tobytes() + zlib.compress(b"".join(cols), 1)


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    out = np.empty(n, kind)
    head, *rest = kind.names
    at = 4 + n * kind[head].itemsize
    out[head] = np.frombuffer(data[4:at], kind[head])
    more, at = zlib.decompress(data[at:]), 0
    for name in rest:
        size = kind[name].itemsize
        col = np.frombuffer(more[at : at + n * size], np.uint8)
        out[name] = np.frombuffer(col.tobytes() if name == "key" else col.reshape(size, n).T.tobytes(), kind[name])
        at += n * size
    return out


def _shut(x: np.ndarray) -> bytes:
    """Bytes, or words as places in a list of those that occur."""
    if x.dtype == np.uint8:
        return zlib.compress(x.tobytes(), 1)
    each, at = np.unique(x, return_inverse=True)
    return len(each).to_bytes(4, "little") + np.ascontiguousarray(each.view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES]).tobytes() + zlib.compress(at.astype("<u4").tobytes(), 1)


def _opened(data: bytes, word: bool) -> np.ndarray:
    if not word:
        return np.frombuffer(zlib.decompress(data), np.uint8)
    n = int.from_bytes(data[:4], "little")
    end = 4 + _WORD_BYTES * n
    each = np.zeros((n, 8), np.uint8)
    each[:, :_WORD_BYTES] = np.frombuffer(data[4:end], np.uint8).reshape(n, _WORD_BYTES)
    return each.view(np.uint64).ravel()[np.frombuffer(zlib.decompress(data[end:]), "<u4")]


class Prints:
    """Fingerprints of stretches of a buffer of bytes or words."""

    def __init__(self, buffer: np.ndarray):
        size = 1 << max(16, len(buffer).bit_length())
        self.back = _powers(size, pow(_BASE, -1, 1 << 64))
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((_bytes()[buffer] if buffer.dtype == np.uint8 else buffer) * _powers(size, _BASE)[: len(buffer)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, n) -> np.ndarray:
        return mixed((self.sums[start + n] - self.sums[start]) * self.back[start])


def _dealt(x: np.ndarray, bucket: np.ndarray):
    """The rows of x by bucket."""
    order = np.argsort(bucket, kind="stable")
    first, count = runs(bucket[order])
    for b, i, n in zip(bucket[order][first].tolist(), first.tolist(), count.tolist(), strict=True):
        yield b, x[order[i : i + n]]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _hot_apart(x: np.ndarray, bucket: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of names that have more than `most` of them here are flagged and dealt by text; a mark stands for them in the name's bucket. The others keep their order."""
    order = np.argsort(x["name"], kind="stable")
    _, count = runs(x["name"][order])
    if not (count > most).any():
        return x, bucket
    on = np.zeros(len(x), bool)
    on[order] = np.repeat(count > most, count)
    hot = np.unique(x[on])  # copies of a text say the same
    first, count = runs(hot["name"])
    still = np.repeat(count > most, count)
    home = lambda y: _bucket(mixed(y["name"].astype(np.uint64)), buckets)
    marks = hot[first[count > most]].copy()
    marks["key"], marks["pos"] = 0, _MARK
    direct = np.sort(hot[still], order=["key", "pos"])
    direct["pos"] |= _FLAG
    parts = [(x[~on], bucket[~on]), (hot[~still], home(hot[~still])), (marks, home(marks)), (direct, _bucket(mixed(direct["key"].astype(np.uint64)), buckets))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _named(buckets: int, cover: Cover, most: int = LOCAL):
    """Texts to packed names of their sampled tuples."""

    def run(batches):
        held, pieces, size = [], [], 0
        rows = 0

        def hashed():
            nonlocal pieces, size
            base, out = 0, []
            buffer = np.concatenate([p[0] for p in pieces])
            prints = Prints(buffer)
            for data, key, start, at in pieces:
                x = np.empty(len(at), _NAME)
                h = prints(at - start + base, cover.tuple)
                x["name"], x["key"], x["pos"] = h & np.uint64(0xFFFFFFFF), key, at
                out.append((x, _bucket(mixed(h & np.uint64(0xFFFFFFFF)), buckets)))
                base += len(data)
            pieces, size = [], 0
            return out

        def sent():
            x, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            parts = list(_dealt(*_hot_apart(x, b, most, buckets)))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in parts], pa.int64()), "names": pa.array([_pack(p[1]) for p in parts], pa.binary())})

        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = cover.units(text)
                if len(data) < cover.window:
                    continue
                for start in range(0, len(data), cover.piece):
                    at = cover.sampled(len(data), start + cover.piece, start)
                    if len(at):
                        piece = data[start : start + cover.piece + cover.tuple]
                        pieces.append((piece, key, start, at))
                        size += len(piece)
                    if size >= cover.piece:
                        new = hashed()
                        held += new
                        rows += sum(len(h[0]) for h in new)
                        if rows >= HELD_NAMES:
                            yield sent()
                            held, rows = [], 0
        if pieces:
            held += hashed()
        if held:
            yield sent()

    return run


def _active(most: int, cover: Cover):
    """The places of names that matter, by text; those of names with more than `most` places are flagged."""

    def run(group: pa.Table) -> pa.Table:
        x = np.concatenate([_unpack(b, _NAME) for b in group.column("names").to_pylist()])
        marked = np.unique(x["name"][x["pos"] == _MARK])
        flagged = x["pos"] & _FLAG > 0
        direct = x[flagged & (x["pos"] != _MARK)]
        x = x[~flagged]
        x = x[np.argsort(x["name"], kind="stable")]
        first, count = runs(x["name"])
        x = x[np.repeat((count > 1) | np.isin(x["name"][first], marked), count)]
        x = x[np.lexsort((x["pos"], x["key"], x["name"]))]
        if len(x):  # copies of a text say the same
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        first, count = runs(x["name"])
        if len(first):
            residue = x["pos"] % cover.period
            least, last = np.minimum.reduceat(residue, first), np.maximum.reduceat(residue, first)
            known = np.isin(x["name"][first], marked)
            keep = known | (count > 1) & ((least != last) | (least == cover.residues[0]))
            hot = np.repeat(keep & (known | (count > most)), count)
            x["pos"][hot] |= _FLAG
            x = x[np.repeat(keep, count)]
        x = np.concatenate([x, direct])
        x = x[np.argsort(x["key"], kind="stable")]
        first, count = runs(x["key"])
        places = [x["pos"][i : i + n].tobytes() for i, n in zip(first.tolist(), count.tolist(), strict=True)]
        return pa.table({"_key": pa.array(x["key"][first], pa.int64()), "places": pa.array(places, pa.binary())})

    return run


def _spans_of(key: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(key, packed spans) of inclusive ranges of starts, joined where they touch."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    first, count = runs(key)
    keys, out = [], []
    for i, n in zip(first.tolist(), count.tolist(), strict=True):
        a, b = lo[i : i + n], np.maximum.accumulate(hi[i : i + n])
        new = np.concatenate([[True], a[1:] > b[:-1] + 1])
        s = np.empty(int(new.sum()), _SPAN)
        s["lo"] = a[new]
        s["hi"] = b[np.concatenate([np.flatnonzero(new)[1:] - 1, [n - 1]])]
        keys.append(int(key[i]))
        out.append(s.tobytes())
    return keys, out


def _merged_by(h: np.ndarray, key: np.ndarray, pos: np.ndarray, weak: np.ndarray | None = None):
    """Which entries share h with an entry of another place, and which come first in their h."""
    order = np.argsort(h, kind="stable")
    first, count = runs(h[order])
    place = mixed(key.astype(np.uint64)) + pos.astype(np.uint64)
    p = place[order]
    many = np.zeros(len(first), bool)
    if len(first):
        many = np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first)
    shared, lead = np.zeros(len(h), bool), np.zeros(len(h), bool)
    shared[order] = np.repeat(many, count)
    lead[order[first]] = True
    return shared, lead


def _placed(buckets: int, text: str, cover: Cover, whole_contexts: bool):
    """Texts with their active places to contexts or fingerprints of them, whole windows of hot names, and what is settled here or was before."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        seen: set[int] = set()
        out: list[tuple] = []
        docs: list[tuple] = []
        size = 0

        def worked():
            buffer = np.concatenate([d[1] for d in docs])
            prints = Prints(buffer)
            base, heads, at, fine = 0, [], [], []
            for key, data, start, total, places in docs:
                hot = places & _FLAG > 0
                p = np.sort((places & ~_FLAG)[~hot]).astype(np.int64)
                left, right = np.minimum(p, cover.period - 1), np.minimum(total - p, cover.window)
                fits = left + right >= cover.window
                p, left, right = p[fits], left[fits], right[fits]
                x = np.empty(len(p), _HEAD)
                x["key"], x["pos"], x["left"], x["right"] = key, p, left, right
                heads.append(x)
                at.append(p - start + base)
                q = np.sort((places & ~_FLAG)[hot]).astype(np.int64)
                if len(q):  # every start whose window holds a hot place
                    q = np.unique((q[:, None] - np.arange(cover.period)).ravel())
                    q = q[(q >= 0) & (q <= total - cover.window)]
                    f = np.empty(len(q), _FINE)
                    f["hash"], f["key"], f["pos"] = prints(q - start + base, cover.window), key, q
                    fine.append(f)
                base += len(data)
            x, at = np.concatenate(heads), np.concatenate(at)
            rows = []
            if len(x):
                x["name"] = prints(at, cover.tuple)
                begin, n = at - x["left"], x["left"].astype(np.int64) + x["right"]
                context = mixed(prints(begin, n) + x["left"]) + n.astype(np.uint64)
                same, lead = _merged_by(context, x["key"], x["pos"])
                settle(x["key"][same], (x["pos"].astype(np.int64) - x["left"])[same], (x["pos"].astype(np.int64) + x["right"] - cover.window)[same], rows)
                x, begin, n, context = x[lead], begin[lead], n[lead], context[lead]
                order = np.arange(len(x))
                for b, own in _dealt(order, _bucket(x["name"], buckets)):
                    if not whole_contexts:
                        y = np.empty(len(own), _SEEN)
                        y["name"], y["context"] = x["name"][own] & np.uint64(0xFFFFFFFF), context[own]
                        for c in ("key", "pos", "left", "right"):
                            y[c] = x[c][own]
                        rows.append((0, b, _pack(y), None, None))
                        continue
                    k = np.repeat(begin[own], n[own]) + spread(n[own])
                    rows.append((0, b, _pack(x[own]), _shut(buffer[k]), None))
            if fine:
                f = np.concatenate(fine)
                same, lead = _merged_by(f["hash"], f["key"], f["pos"])
                settle(f["key"][same], f["pos"][same], f["pos"][same], rows)
                f = f[lead]
                rows.extend((1, b, _pack(own), None, None) for b, own in _dealt(f, _bucket(f["hash"], buckets)))
            return rows

        def settle(key, lo, hi, rows):
            if len(key):
                keys, spans = _spans_of(key, lo, hi)
                rows.extend((2, k % buckets, s, None, k) for k, s in zip(keys, spans, strict=True))

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "a", "b", "_key"])

        for batch in batches:
            settled = batch.column("spans").to_pylist() if whole_contexts else [()] * batch.num_rows
            for key, said, places, spans in zip(batch.column("_key").to_pylist(), batch.column(text).to_pylist(), batch.column("places").to_pylist(), settled, strict=True):
                if key in seen:
                    continue
                out += ((2, key % buckets, x, None, key) for x in spans)
                if not places:
                    seen.add(key)
                    continue
                seen.add(key)
                if len(seen) > 1_000_000:
                    seen.clear()
                data = cover.units(said)
                own = np.concatenate([np.frombuffer(b, np.uint32) for b in places])
                place = (own & ~_FLAG).astype(np.int64)
                for start in range(0, len(data), cover.piece):
                    part = own[(place >= start) & (place < start + cover.piece)]
                    if len(part):
                        lo = max(0, start - cover.period)
                        piece = data[lo : start + cover.piece + cover.window]
                        docs.append((key, piece, lo, len(data), part))
                        size += len(piece)
                    if size >= HELD_PIECES * cover.piece:
                        out += worked()
                        docs, size = [], 0
                        if out:
                            yield sent(out)
                            out = []
        if docs:
            out += worked()
        if out:
            yield sent(out)

    return run


def _split(cover: Cover):
    """Of one bucket of fingerprints of contexts: spans that are settled, and a place of each context that is not the only one of its name."""
    starts = _starts(cover)

    def run(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py():
            out = starts(group)
            return pa.table({"_key": out.column("_key"), "spans": out.column("spans"), "places": pa.nulls(out.num_rows, pa.binary())})
        x = np.concatenate([_unpack(b, _SEEN) for b in group.column("a").to_pylist()])
        x = x[np.lexsort((x["pos"], x["key"], x["context"], x["name"]))]
        x = x[np.concatenate([[True], (x[1:] != x[:-1])])] if len(x) else x
        name, context = (np.concatenate([[True], x[c][1:] != x[c][:-1]]) if len(x) else np.zeros(0, bool) for c in ("name", "context"))
        first = np.flatnonzero(name | context)
        count = np.diff(np.concatenate([first, [len(x)]]))
        same = np.repeat(count > 1, count)
        own = np.flatnonzero(name)[np.cumsum(name) - 1] if len(x) else first  # where each one's name begins
        _, contexts = runs(own[first])
        many = np.repeat(contexts > 1, contexts)
        lead = x[first[many]]
        start = x["pos"].astype(np.int64) - x["left"]
        keys, spans = _spans_of(x["key"][same], start[same], (x["pos"].astype(np.int64) + x["right"] - cover.window)[same])
        lead = lead[np.argsort(lead["key"], kind="stable")]
        at, n = runs(lead["key"])
        places = [lead["pos"][i : i + k].tobytes() for i, k in zip(at.tolist(), n.tolist(), strict=True)]
        return pa.table({
            "_key": pa.concat_arrays([pa.array(keys, pa.int64()), pa.array(lead["key"][at], pa.int64())]),
            "spans": pa.array([*spans, *[None] * len(places)], pa.binary()), "places": pa.array([*[None] * len(keys), *places], pa.binary()),
        })

    return run


def _starts(cover: Cover):
    """Starts whose windows occur elsewhere, from one bucket of contexts, of windows, or of what is settled."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        if kind == 2:
            return pa.table({"_key": group.column("_key").cast(pa.int64()), "spans": group.column("a").cast(pa.binary())})
        keys, spans = [], []
        if kind == 1:
            f = np.concatenate([_unpack(b, _FINE) for b in group.column("a").to_pylist()])
            same, _ = _merged_by(f["hash"], f["key"], f["pos"])
            keys, spans = _spans_of(f["key"][same], f["pos"][same], f["pos"][same])
        else:
            x = np.concatenate([_unpack(b, _HEAD) for b in group.column("a").to_pylist()])
            data = np.concatenate([_opened(b, cover.word) for b in group.column("b").to_pylist()])
            n = x["left"].astype(np.int64) + x["right"]
            begin = np.cumsum(n) - n
            order = np.argsort(x["name"], kind="stable")
            first, count = runs(x["name"][order])
            order = order[np.repeat(count > 1, count)]
            first, count = runs(x["name"][order])
            # whole groups of up to about half a million units of contexts at a time
            mark = np.cumsum(n[order])[first + count - 1] // (1 << 19) if len(first) else np.zeros(0, np.int64)
            cut, many = runs(mark)
            for c, m in zip(cut.tolist(), many.tolist(), strict=True):
                own = order[first[c] : first[c + m - 1] + count[c + m - 1]]
                y, size = x[own], n[own]
                buffer = data[np.repeat(begin[own], size) + spread(size)]
                base = np.cumsum(size) - size
                windows = size - cover.window + 1
                at = np.repeat(base, windows) + spread(windows)
                key = np.repeat(y["key"], windows)
                pos = np.repeat(y["pos"].astype(np.int64) - y["left"], windows) + spread(windows)
                same, _ = _merged_by(Prints(buffer)(at, cover.window), key, pos)
                k, s = _spans_of(*_ranges(key[same], pos[same]))
                keys += k
                spans += s
        return pa.table({"_key": pa.array(keys, pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


def _ranges(key: np.ndarray, pos: np.ndarray):
    """Neighbours with following starts as ranges."""
    if not len(key):
        return key, pos, pos
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(key) - 1]])
    return key[first], pos[first], pos[last]


def repeated(spark: SparkSession, docs: DataFrame, text: str = "text", hot: int = HOT, covers: tuple = (BYTES,), local: int = LOCAL) -> DataFrame:
    """docs with _key, _copies (rows with the same text) and _spans (of the next cover _spans1): ranges of starts of windows that occur elsewhere."""
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    rows = docs.drop("_copies", *spans_of(covers)).withColumn(text, whole(text)).withColumn("_key", F.xxhash64(text))
    marks = rows.groupBy("_key").agg(F.count("*").alias("_copies")).where("_copies > 1")
    for said, cover in zip(spans_of(covers), covers, strict=True):
        names = rows.select("_key", F.col(text).alias("text")).mapInArrow(lean(_named(buckets, cover, local)), "bucket long, names binary")
        places = names.groupBy("bucket").applyInArrow(lean_group(_active(hot, cover)), "_key long, places binary").groupBy("_key").agg(F.collect_list("places").alias("places"))
        # all joins with the texts take whole rows, so that their shuffle is one and the same
        kinds = "kind long, bucket long, a binary, b binary, _key long"
        found = rows.join(places, "_key").mapInArrow(lean(_placed(buckets, text, cover, False)), kinds)
        known = found.groupBy("kind", "bucket").applyInArrow(lean_group(_split(cover)), "_key long, spans binary, places binary")
        known = known.groupBy("_key").agg(F.collect_list("spans").alias("spans"), F.collect_list("places").alias("places"))
        found = rows.join(known, "_key").mapInArrow(lean(_placed(buckets, text, cover, True)), kinds)
        spans = found.groupBy("kind", "bucket").applyInArrow(lean_group(_starts(cover)), "_key long, spans binary").groupBy("_key").agg(F.collect_list("spans").alias(said))
        marks = spans.join(marks, "_key", "full")
    return rows.join(marks, "_key", "left")


def spans_of(covers: tuple) -> list[str]:
    return ["_spans", *(f"_spans{k}" for k in range(1, len(covers)))]


def removed(n: int, copies: int | None, spans: list[bytes] | None, window: int = WINDOW) -> np.ndarray:
    """Maximal runs [lo, hi) of bytes (or words) that go, of a text of n bytes (or words)."""
    if n < window:
        return np.zeros((0, 2), np.int64)
    if copies and copies > 1:
        return np.array([[0, n]])
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.concatenate([np.frombuffer(b, _SPAN) for b in spans])
    _, packed = _spans_of(np.zeros(len(x), np.int64), x["lo"], x["hi"].astype(np.int64) + window - 1)
    x = np.frombuffer(packed[0], _SPAN)
    return np.stack([x["lo"].astype(np.int64), x["hi"].astype(np.int64) + 1], 1)


def _left(data: bytes, gone: np.ndarray) -> bytes:
    at, out = 0, []
    for lo, hi in gone.tolist():
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


def _digest(batches, words: bool = False):
    """Counts and digest of what the bytes' cover leaves; with `words` also how many bytes, and in how many runs, both covers remove."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 2 * words]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_cut", "n_cut_spans"] * words]
    for b in batches:
        rows = []
        for text, copies, spans, more in zip(*(b.column(c).to_pylist() for c in ("text", "_copies", "_spans", "_spans1" if words else "_spans")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            gone = removed(len(data), copies, spans)
            rows.append((len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(_left(data, gone)).hexdigest()))
            if words:
                both = _union([gone, _words_removed(text, copies, more, WORDS.window)])
                rows[-1] += int((both[:, 1] - both[:, 0]).sum()), len(both)
        c = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(c, kinds, strict=True))], names=names)


def _both_digests(batches):
    return _digest(batches, words=True)


def _words_removed(text: str, copies: int | None, spans: list[bytes] | None, window: int) -> np.ndarray:
    """Runs of bytes from the first to the last word of each run of words that goes."""
    if not spans and not (copies and copies > 1):
        return np.zeros((0, 2), np.int64)
    at = _words(text)
    gone = removed(len(at), copies, spans, window)
    return np.stack([at[gone[:, 0], 0], at[gone[:, 1] - 1, 1]], 1)


def _words(text: str) -> np.ndarray:
    """First and last byte (exclusive) of each word."""
    at = np.array([m.span() for m in _RUN.finditer(text)], np.int64).reshape(-1, 2)
    if text.isascii():
        return at
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])[at]


def _union(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    if not len(x):
        return x
    far = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > far[:-1]])
    return np.stack([x[new, 0], far[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(x) - 1]])]], 1)


def _cut(text: str, names: list[str], covers: tuple, called: list[str] | None = None):
    """Batches with the text cut, their columns `names` under the names `called`."""

    def run(batches):
        for b in batches:
            out = []
            for t, copies, *spans in zip(*(b.column(c).to_pylist() for c in (text, "_copies", *spans_of(covers))), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                gone = _union([_words_removed(t, copies, s, c.window) if c.word else removed(len(data), copies, s, c.window) for c, s in zip(covers, spans, strict=True)])
                # a run may begin or end inside a character; what is left of it goes too
                out.append(t if not len(gone) else _left(data, gone).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b.column(n) for n in names], names=called or names)

    return run


def without_repeats(spark: SparkSession, docs: DataFrame, text: str = "text", covers: tuple = (BYTES,)) -> DataFrame:
    """docs with the stretches that repeat by any of the covers cut out of their texts; a null text becomes an empty one."""
    names = docs.columns
    own = [text if n == text else f"c{k}{'_' * len(text)}" for k, n in enumerate(names)]  # so that no column clashes with ours
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    return repeated(spark, docs.toDF(*own), text, covers=covers).select(*own, "_copies", *spans_of(covers)).mapInArrow(lean(_cut(text, own, covers, names)), kinds)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 400 bytes remove; n_cut bytes in n_cut_spans runs go if passages of over 50 words, which may have fewer bytes, go too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = repeated(spark, docs, covers=(BYTES, WORDS)).select("doc_id", "text", "_copies", "_spans", "_spans1")
    return found.mapInArrow(lean(_both_digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_cut long, n_cut_spans long")
