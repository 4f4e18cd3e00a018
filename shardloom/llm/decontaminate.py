"""Benchmark decontamination under edits.

The CGK walk maps a string to a longer one: at step j it emits the character it stands on and
moves on if a random bit of (j, character) says so. Strings within few edits give walks that
fall back into step, so edit distance becomes Hamming distance, and sampling positions of the
walk is a locality-sensitive hash for it. Each repetition has its own bits, and a few samples.

Walks start at every character of an item but only at every `stride`-th of a document: whatever
the shift, a copied passage holds several walks that begin in step with the item's own. A
collision places an item-sized window in the document; the item's exact edit distance to the
best stretch of that window (bit-parallel dynamic programming) decides. It is first computed for
all windows of a batch at once, over bytes that characters may share, which bounds it from below,
and then over characters for the windows that are left. Repetitions are added until, on copies of the items with random edits
at the rate `tuned_at` (the limit itself), the target recall is met in each class of lengths;
an item takes part in as many repetitions as its class needs.

For walks, characters are mapped to 16 classes of like frequency among the items, so that three
steps are one look-up in a table of 4,096 entries; what is compared in the end are characters.

Items under EXACT characters, and classes that miss the target after MOST_REPEATS repetitions,
are found without loss: k edits leave one of k + 1 pieces of an item whole, so the distance is
computed wherever a piece stands. One automaton finds the pieces of all such items.

Texts are compared in lower case with white space as one blank. Items that are empty then, and
null items, take no part; null texts are empty. Repeated documents each give their own results;
items of equal text are searched once and each of their ids has its results. An empty table on
either side gives an empty result. Other columns, whatever their names, stay (`uncontaminated`)
or are left out (`contaminated`). Items are sent to all tasks in groups of about MAX_ITEM_CHARS
characters, one pass over the documents for each group.
"""

from __future__ import annotations

import random
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, spread, table, whole

#: A walk's steps, those sampled for one hash, and the samples of one walk.
STEPS, SAMPLE, SAMPLES, STRIDE = 39, 14, 4, 12
JOINED = 3  # steps of one look-up
ROOM = STEPS + JOINED  # characters that a walk may look at
EXACT = 64
CLASSES = (EXACT, 96, 128, 192, 256)  # least lengths
TAIL = 24  # characters of an item that a walk has before it at least
MAX_ITEM_CHARS, LOT_CHARS = 500_000, 6_000_000
WITHIN = 0.2  # edits for each character of the item at most
RECALL, TUNED_AT, MOST_REPEATS = 0.97, WITHIN, 24
COPIES = 400
_BITMAP = 24


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    """A byte for each character; rare ones may share one, which only adds candidates."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((x ^ (x >> np.uint32(8)) * np.uint32(37)) & np.uint32(0xFF)).astype(np.uint8)


def alphabet(items: list[str]) -> np.ndarray:
    """A class of 0 to 15 for each character's byte, about as frequent as each other among the items."""
    count = np.bincount(np.concatenate([np.zeros(0, np.uint8), *map(codes, items)]), minlength=256)
    out, load = np.arange(256, dtype=np.uint16) % 16, np.zeros(16)
    for c in np.argsort(-count, kind="stable")[: int((count > 0).sum())].tolist():
        out[c] = k = int(load.argmin())
        load[k] += count[c]
    return out


def joined(text: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each place of a text of bytes, the classes of the next JOINED characters as one number."""
    c = classes[text]
    out = c.copy()
    for k in range(1, JOINED):
        out[:-k] |= c[k:] << np.uint16(4 * k)
    return out.astype(np.int64)


@lru_cache(64)
def _tables(rep: int) -> list[list[np.ndarray | None]]:
    """For each JOINED steps and each sample: what they add to the hash, by the characters before them; with the first sample's, how far they go in the two lowest bits. None adds nothing."""
    rng = np.random.default_rng(1_000_003 + rep)
    bits = rng.integers(0, 2, (STEPS, 16))
    sampled = [set(rng.choice(STEPS, SAMPLE, replace=False).tolist()) for _ in range(SAMPLES)]
    value = rng.integers(0, 1 << 62, (SAMPLES, STEPS, 16), dtype=np.uint64) << np.uint64(2)
    seen, out = np.arange(1 << 4 * JOINED), []
    for first in range(0, STEPS, JOINED):
        go, add = np.zeros(len(seen), np.int64), np.zeros((SAMPLES, len(seen)), np.uint64)
        for j in range(first, first + JOINED):
            c = seen >> 4 * go & 15
            for k, own in enumerate(sampled):
                if j in own:
                    add[k] += value[k, j][c]
            go += bits[j][c]
        add[0] += go.astype(np.uint64)
        out.append([x.view(np.int64) if x.any() else None for x in add])
    return out


def hashes(text: np.ndarray, starts: np.ndarray, rep: int) -> np.ndarray:
    """The sampled walks from each start, a row for each sample; joined() made the text, which must go on for ROOM more characters."""
    out = np.zeros((SAMPLES, len(starts)), np.int64)
    for k in range(0, len(starts), 1 << 14):  # what fits the cache
        begin = starts[k : k + (1 << 14)].astype(np.int64)
        at, own = begin.copy(), out[:, k : k + (1 << 14)]
        seen, got = np.empty_like(at), np.empty_like(at)
        for add in _tables(rep):
            text.take(at, out=seen, mode="clip")
            for i in range(SAMPLES - 1, -1, -1):
                if add[i] is not None:
                    add[i].take(seen, out=got, mode="clip")
                    own[i] += got
            got &= 3
            at += got
        own[0] -= at - begin
    return out.view(np.uint64)


def distance(item: str, window: str, most: int) -> int:
    """Least edit distance of the item to any stretch of the window; more than `most` may be any larger number."""
    n = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score, best, top, full = (1 << n) - 1, 0, n, n, 1 << (n - 1), (1 << n) - 1
    for k, c in enumerate(window):
        eq = peq.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | (full & ~(d0 | up))
        hn = d0 & up
        if hp & top:
            score += 1
        if hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        up = hn | (full & ~(d0 | hp))
        down = d0 & hp
        if score < best:
            best = score
        if score - (len(window) - 1 - k) > most and best > most:
            break  # what is left cannot mend it
    return best


class Bounds:
    """Least edit distances of items to stretches of windows, many at once, over bytes in place of characters."""

    def __init__(self, items: list[str]):
        self.size = np.array([len(t) for t in items], np.int64)
        self.words = -(-self.size // 64)
        self.base = (np.cumsum(self.words) - self.words) * 256
        # as long again as the longest item, since items of fewer words go along with longer ones
        self.bits = np.zeros(int(self.words.sum() + self.words.max(initial=0)) * 256, np.uint64)  # for each item, 64 characters and byte: where it stands
        for t, base in zip(items, self.base.tolist(), strict=True):
            at = np.arange(len(t))
            np.bitwise_or.at(self.bits, base + at // 64 * 256 + codes(t), np.uint64(1) << (at % 64).astype(np.uint64))

    def __call__(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each window [lo, hi) of the text, its item's least number of edits."""
        out = np.zeros(len(item), np.int64)
        order = np.argsort(lo - hi, kind="stable")  # the longest first
        for k in range(0, len(order), 4096):
            own = order[k : k + 4096]
            out[own] = self._run(item[own], lo[own], hi[own], text)
        return out

    def _run(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: np.ndarray) -> np.ndarray:
        one, top = np.uint64(1), np.uint64(63)
        base, words, score = self.base[item], self.words[item], self.size[item].copy()
        best, high = score.copy(), ((score - 1) % 64).astype(np.uint64)
        most, length = int(words.max()), hi - lo
        ends = [np.flatnonzero(words == w + 1) for w in range(most)]  # whose last word it is
        far = [int(np.flatnonzero(words > w)[-1]) + 1 for w in range(most)]  # and up to where some go on
        up, down = np.full((most, len(item)), ~np.uint64(0)), np.zeros((most, len(item)), np.uint64)
        for j in range(int(length[0])):
            n = int(np.searchsorted(-length, -j, "left"))  # windows that go on
            at = base[:n] + text[lo[:n] + j]
            plus = minus = np.zeros(n, np.uint64)
            for w in range(most):
                m = min(n, far[w])
                eq, pv, mv, plus, minus = self.bits[at[:m] + w * 256], up[w, :m], down[w, :m], plus[:m], minus[:m]
                xv = eq | mv
                eq |= minus
                xh = (((eq & pv) + pv) ^ pv) | eq
                hp, hn = mv | ~(xh | pv), pv & xh
                own = ends[w][: np.searchsorted(ends[w], m)]
                if len(own):
                    shift = high[own]
                    score[own] += (hp[own] >> shift & one).astype(np.int64) - (hn[own] >> shift & one).astype(np.int64)
                plus_out, minus_out = hp >> top, hn >> top
                hp <<= one
                hp |= plus
                hn <<= one
                hn |= minus
                down[w, :m] = hp & xv
                xv |= hp
                up[w, :m] = hn | ~xv
                plus, minus = plus_out, minus_out
            np.minimum(best[:n], score[:n], out=best[:n])
        return best


class Index:
    """Walks from every place of every item that has this repetition; item numbers are those of `own`."""

    def __init__(self, items: list[str], own: list[int], rep: int, classes: np.ndarray):
        self.rep = rep
        text = np.concatenate([np.zeros(0, np.uint8), *(np.concatenate([codes(items[i]), np.zeros(ROOM, np.uint8)]) for i in own)])
        size = np.array([len(items[i]) for i in own], np.int64)
        count = np.maximum(size - TAIL + 1, 0)
        item, offset = np.repeat(np.array(own, np.int32), count), spread(count)
        h = hashes(joined(text, classes), np.repeat(np.cumsum(size + ROOM) - size - ROOM, count) + offset, rep)
        self.shift = np.uint64(64 - min(_BITMAP, h.shape[1].bit_length() + 4))
        self.parts = []
        for x in h:
            order = np.argsort(x, kind="stable")
            seen = np.zeros(1 << 64 - int(self.shift), bool)
            seen[x >> self.shift] = True
            self.parts.append((x[order], item[order], offset[order].astype(np.int32), seen))

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the text where it would begin, start of the walk that met it)."""
        out = []
        for x, (h, item, offset, seen) in zip(hashes(text, starts, self.rep), self.parts, strict=True):
            near = np.flatnonzero(seen[x >> self.shift])
            lo, hi = np.searchsorted(h, x[near], "left"), np.searchsorted(h, x[near], "right")
            count = hi - lo
            pick = np.repeat(lo, count) + spread(count)
            walk = np.repeat(starts[near], count).astype(np.int64)
            out.append((item[pick].astype(np.int64), walk - offset[pick], walk))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _laid(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end as bytes, each followed by room for a walk; where each begins; their lengths."""
    size = np.array([len(t) for t in docs], np.int64)
    base = np.cumsum(size + ROOM) - size - ROOM
    text = np.zeros(int((size + ROOM).sum()), np.uint8)
    for t, at in zip(docs, base.tolist(), strict=True):
        text[at : at + len(t)] = codes(t)
    return text, base, size


def edited(text: str, rate: float, rng: random.Random) -> str:
    """The text with about rate * length random edits."""
    out = list(text)
    for _ in range(round(rate * len(text))):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice(text)
        elif kind == 1 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, rng.choice(text))
    return "".join(out)


def repeats_for(items: list[str], recall: float = RECALL, rate: float = TUNED_AT, most: int = MOST_REPEATS) -> list[int]:
    """For each item, the fewest repetitions that find so many edited copies of its class; 0 for the exact way."""
    kind = np.searchsorted(CLASSES, [len(t) for t in items], "right")
    out, classes = np.zeros(len(items), np.int64), alphabet(items)
    for k in range(1, len(CLASSES) + 1):
        rng = random.Random(7)
        own = np.flatnonzero(kind == k).tolist()
        some = rng.sample(own, min(COPIES, len(own)))
        copies = [(i, edited(items[i], rate, rng), rng.randrange(STRIDE)) for i in some for _ in range(-(-COPIES // len(some)))]
        after = "".join(rng.choice(items[i]) for i in rng.choices(own or [0], k=ROOM))  # a document goes on
        left = copies
        for n in range(most if some else 0):
            text, base, size = _laid([c + after for _, c, _ in left])
            starts = np.concatenate([np.arange(b + at, b + z - len(after), STRIDE) for b, z, (_, _, at) in zip(base.tolist(), size.tolist(), left, strict=True)])
            item, begin, walk = Index(items, some, n, classes).candidates(joined(text, classes), starts)
            copy = np.searchsorted(base, walk, "right") - 1
            wanted = np.array([i for i, _, _ in left])[copy]
            limit = np.array([int(rate * len(items[i])) for i, _, _ in left])[copy]
            found = set(copy[(item == wanted) & (np.abs(begin - base[copy]) <= limit)].tolist())
            left = [c for x, c in enumerate(left) if x not in found]
            if len(left) + len(left) ** 0.5 <= (1 - recall) * len(copies):  # a standard error to spare
                out[own] = n + 1
                break
    return out.tolist()


def _pieces(item: str, most: int) -> list[tuple[int, str]]:
    """most + 1 pieces with their places: that many edits leave one whole."""
    cut = [len(item) * k // (most + 1) for k in range(most + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Search:
    """The items of one group, and what was verified before."""

    def __init__(self, items: list[str], repeats: list[int], within: float):
        self.items, self.classes = items, alphabet(items)
        if not 0 <= within < 1:
            raise ValueError("the limit is a share of an item's characters below 1")
        self.most = np.array([int(within * len(t)) for t in items], np.int64)
        self.indexes = [Index(items, own, rep, self.classes) for rep in range(max(repeats)) if (own := [i for i, n in enumerate(repeats) if n > rep])]
        self.pieces = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(repeats):
            for at, piece in [] if n else _pieces(items[i], int(self.most[i])):
                places.setdefault(piece, []).append((i, at + len(piece) - 1))
        for piece, where in places.items():
            self.pieces.add_word(piece, where)
        if places:
            self.pieces.make_automaton()
        self.bounds = Bounds(items)
        self.known: dict[tuple[int, str], int] = {}

    def _distance(self, i: int, window: str) -> int:
        if (i, window) not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[i, window] = distance(self.items[i], window, int(self.most[i]))
        return self.known[i, window]

    def _windows(self, docs: list[str]):
        """(text, item, begin, end) of windows, in that order, that may hold an item; those of one text and item that begin close together are one."""
        text, base, size = _laid(docs)
        count = -(-size // STRIDE)
        starts = np.repeat(base, count) + STRIDE * spread(count)
        seen = joined(text, self.classes)
        found = [x.candidates(seen, starts) for x in self.indexes]
        item, begin, walk = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        doc = np.searchsorted(base, walk, "right") - 1
        if self.pieces:
            more = [(i, end - at, k) for k, t in enumerate(docs) for end, where in self.pieces.iter(t) for i, at in where]
            if more:
                i, at, k = np.array(more, np.int64).T
                item, begin, doc = np.concatenate([item, i]), np.concatenate([begin, base[k] + at]), np.concatenate([doc, k])
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        most, n = self.most[item], self.bounds.size[item]
        # a cluster holds begins that one stretch of `most` + 8 characters holds
        part = begin // (most + 8)
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])])) if len(doc) else np.zeros(0, np.int64)
        final = np.concatenate([first[1:], [len(doc)]])[: len(first)] - 1
        doc, item, most, n = doc[first], item[first], most[first], n[first]
        lo = np.maximum(base[doc], begin[first] - most)
        hi = np.minimum(base[doc] + size[doc], begin[final] + n + most)
        fits = hi - lo >= n - most
        doc, item, lo, hi, most = doc[fits], item[fits], lo[fits], hi[fits], most[fits]
        near = self.bounds(item, lo, hi, text) <= most
        return zip(doc[near].tolist(), item[near].tolist(), (lo - base[doc])[near].tolist(), (hi - base[doc])[near].tolist(), strict=True)

    def __call__(self, texts: list[str], any_item: bool = False) -> dict[tuple[int, int], int]:
        """(text, item) to the least number of edits, where that is within the limit; any_item: of each text one item is enough."""
        docs = [plain(t) for t in texts]
        out: dict[tuple[int, int], int] = {}
        done = -1
        for k, i, lo, hi in self._windows(docs):
            if any_item and done == k:
                continue
            d = self._distance(i, docs[k][lo:hi])
            if d <= self.most[i] and d < out.get((k, i), d + 1):
                out[k, i] = d
                done = k
        return out


def _lots(batches, text: str):
    """Batches with their texts, about LOT_CHARS characters at a time: the fixed costs of a search are shared."""
    held, chars = [], 0
    for b in batches:
        held.append((b, [t or "" for t in b.column(text).to_pylist()]))
        chars += sum(map(len, held[-1][1]))
        if chars >= LOT_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _found(keys, items, repeats, within):
    def run(batches):
        search = Search(items, repeats, within)
        for lot in _lots(batches, "text"):
            doc_ids = [i for b, _ in lot for i in b.column("doc_id").to_pylist()]
            if out := search([t for _, texts in lot for t in texts]):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_ids[k] for k, _ in out], pa.int64()), "item": pa.array([keys[i] for _, i in out], pa.int64()), "distance": pa.array(out.values(), pa.int64()), "item_chars": pa.array([len(items[i]) for _, i in out], pa.int64())})

    return run


def _clean(text, items, repeats, within):
    def run(batches):
        search = Search(items, repeats, within)
        for lot in _lots(batches, text):
            hit, at = {k for k, _ in search([t for _, texts in lot for t in texts], any_item=True)}, 0
            for b, texts in lot:
                yield b.filter(pa.array([at + k not in hit for k in range(len(texts))], pa.bool_()))
                at += len(texts)

    return run


def _groups(benchmark: DataFrame):
    """(hashes of texts, items) of each group of different texts; as many groups as keep one near MAX_ITEM_CHARS, hashes being even."""
    fine = benchmark.where("text is not null").select("text").distinct().withColumn("key", F.xxhash64("text"))
    chars = fine.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // MAX_ITEM_CHARS))
    for g in range(groups):
        rows = fine.where(F.pmod("key", F.lit(groups)) == g).orderBy("key", "text").collect()
        part = [(r["key"], t) for r in rows if (t := plain(r["text"]))]
        if part:
            yield [i for i, _ in part], [t for _, t in part]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, within: float = WITHIN, recall: float = RECALL, tuned_at: float = TUNED_AT) -> DataFrame:
    """doc_id, item_id, distance, item_chars: which items stand in which documents, up to within * item_chars edits."""
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    kind = "doc_id long, item long, distance long, item_chars long"
    out = spark.createDataFrame([], kind)
    for keys, items in _groups(benchmark):
        out = out.unionByName(rows.mapInArrow(lean(_found(keys, items, repeats_for(items, recall, tuned_at), within)), kind))
    ids = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item"))
    return out.join(ids, "item").select("doc_id", "item_id", "distance", "item_chars")


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", within: float = WITHIN, recall: float = RECALL, tuned_at: float = TUNED_AT) -> DataFrame:
    """The documents in which no item stands."""
    bounded_batches(spark)
    for _, items in _groups(benchmark):
        docs = docs.mapInArrow(lean(_clean(text, items, repeats_for(items, recall, tuned_at), within)), docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pair of document and item found in it."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
