"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its five-word shingles. Documents with one and the same set form a
class, and from there on classes stand for their documents, so copies are never expanded.
Each of TREES trees gives a class a string of DEPTH minima. Sorted by range, a tree's strings are
a prefix trie: what a string shares with any other it shares with a neighbour, so one pass over
neighbours tells each class how long a prefix it shares in each tree. Two classes meet in a tree
if their strings share a prefix of the current length. That length starts at DEPTH and is
shortened as long as the recall is not reached; each time only pairs that have not met at a longer
prefix are verified, in the groups that grew. Each link of similarity s stands for the reciprocal
of its chance to meet at this length; the recall is reached if links that are missed by this
count, with two standard errors to spare, are fewer than the target allows, and at the latest
where any pair at the threshold meets with the target recall. The next length is the longest that
the links found so far let expect to be enough.

Prefix groups with the same members in several trees are one group. Large groups are cut into
blocks by members and by bytes, and pairs of blocks are the unit of work. A pair of classes is
verified in one group only, by counting common shingles in products of 0/1 matrices; what comes
out is one row for each class and block (its links, and the root of its links' tree in the
block), never a row for each pair. Groups of linked classes come from the roots.

Words are runs of word characters in lower case; a text of fewer than five words has one
shingle, all its words. Texts without words, and null texts, take no part: each is its own class
with no links. Null ids and repeated rows are documents like others. An empty table gives an empty
result. Other columns, whatever their names, stay (`without_near_copies`) or are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, components, discard, fresh, lean, mixed, rows_of, runs, table, whole, written

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH = 20, 8
LEVEL = 2  # bytes of a minimum in a tree's string; two that agree in them by chance only make a candidate
BINS = 20  # of similarities of links, from the threshold to 1
BLOCK = 1024
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SCALES = np.random.default_rng(11).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit names of the text's n-word shingles."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * _STEP + w[j : len(w) - n + 1 + j])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """A minimum of the shingles for each tree and level."""
    out = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        part = s[None, i : i + 8192]
        for j in range(0, len(out), 32):
            out[j : j + 32] = np.minimum(out[j : j + 32], (part * _SCALES[j : j + 32, None]).min(1))
    return out.reshape(TREES, DEPTH)


def met(similarity, depth: int, trees: int = TREES):
    """The chance that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - np.asarray(similarity) ** depth) ** trees


def first_depth(threshold: float, recall: float) -> int:
    depth = DEPTH
    while depth > 1 and met(threshold, depth) < recall:
        depth -= 1
    return depth


def enough(bins: np.ndarray, depth: int, threshold: float, recall: float) -> bool:
    """Whether links found with prefixes of this length, counted by similarity, leave fewer missed ones than the target allows."""
    if met(threshold, depth) >= recall:
        return True
    chance = met(np.linspace(threshold, 1, len(bins), endpoint=False), depth)
    missed = (bins * (1 / chance - 1)).sum()
    spread = (bins * (1 - chance) / chance**2).sum() ** 0.5
    # where nothing is missed so far, a few rare ones may be: as many as the threshold's chance explains
    return bins.sum() > 0 and bins.sum() / (bins.sum() + missed + 2 * spread + 1 / met(threshold, depth)) >= recall


def shortened(bins: np.ndarray, depth: int, threshold: float, recall: float) -> int:
    """The next shorter prefix: the longest at which as many links as those found stand for should be enough."""
    at = np.linspace(threshold, 1, len(bins), endpoint=False)
    whole_ = bins / met(at, depth)
    return next((d for d in range(depth - 1, 1, -1) if enough(whole_ * met(at, d), d, threshold, recall)), 1)


def _signed(n: int):
    def run(batches):
        for b in batches:
            classes, forests = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, n)
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                forests.append((minima(s) >> np.uint64(16)).astype(f">u{LEVEL}").tobytes() if len(s) else None)  # low bits: a minimum's high ones are small
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text"), b.column("size"), pa.array(classes, pa.binary()), pa.array(forests, pa.binary())], names=["doc_id", "_text", "size", "class", "forest"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levels that strings share, row by row."""
    other = a != b
    return np.where(other.any(1), other.argmax(1), a.shape[1])


def _matched(shortest: int):
    """Sorted strings with the longest prefix that each shares with a neighbour; the first and the last of a partition say so."""
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32()]

    def out(rows, deepest, side):
        pid = TaskContext.get().partitionId()
        keep = np.flatnonzero((deepest >= shortest) | (side > 0))
        cols = [rows.column(c).take(pa.array(keep)) for c in ("class", "size", "tree", "s")]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip([*cols, pa.array(deepest[keep]), pa.array(np.full(len(keep), pid)), pa.array(side[keep])], kinds, strict=True)], names=["class", "size", "tree", "s", "deepest", "pid", "side"])

    def run(batches):
        held, before, first = None, 0, 1  # the last row of the batch before, and what it shares with its own neighbour
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            tree = rows.column("tree").to_numpy(zero_copy_only=False)
            s = np.frombuffer(b"".join(rows.column("s").to_pylist()), np.dtype(f">u{LEVEL}")).reshape(len(tree), DEPTH)
            next_ = np.where(tree[1:] == tree[:-1], _shared(s[1:], s[:-1]), 0)
            deepest = np.maximum(np.concatenate([[before], next_]), np.concatenate([next_, [0]]))
            side = np.zeros(len(tree), np.int64)
            side[0] = first
            held, before = rows.slice(len(tree) - 1), int(next_[-1]) if len(next_) else before
            if len(tree) > 1:
                yield out(rows.slice(0, len(tree) - 1), deepest[:-1], side[:-1])
                first = 0
        if held is not None:
            yield out(held, np.array([before]), np.array([2 + first]))

    return run


def trie(spark: SparkSession, classes: DataFrame, shortest: int) -> DataFrame:
    """class, size, tree, s, deepest: the strings that share a prefix of `shortest` levels at least, and how long a one."""
    step = DEPTH * LEVEL
    each = classes.select("class", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("forest", t * step + 1, F.lit(step)))).alias("tree", "s"))
    sorted_ = each.repartitionByRange("tree", "s").sortWithinPartitions("tree", "s")
    rows = written(spark, sorted_.mapInArrow(lean(_matched(shortest)), "class binary, size long, tree int, s binary, deepest int, pid long, side int"), "trie")
    # two rows of each partition have their other neighbour in another one
    edges = sorted(rows.where("side > 0").collect(), key=lambda r: (r["pid"], r["side"]))
    deepest = [r["deepest"] for r in edges]
    for k, (x, y) in enumerate(itertools.pairwise(edges)):
        if x["pid"] != y["pid"] and x["tree"] == y["tree"]:
            n = int(_shared(*(np.frombuffer(r["s"], f">u{LEVEL}")[None] for r in (x, y)))[0])
            deepest[k], deepest[k + 1] = max(deepest[k], n), max(deepest[k + 1], n)
    kind = "class binary, size long, tree int, s binary, deepest int"
    mended = spark.createDataFrame([(r["class"], r["size"], r["tree"], r["s"], d) for r, d in zip(edges, deepest, strict=True) if d >= shortest], kind)
    return rows.where("side = 0").drop("pid", "side").unionByName(mended)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of a with each of b."""
    flat = np.concatenate([*a, *b])
    order = np.argsort(flat, kind="stable")
    first, count = runs(flat[order])
    row = np.repeat(np.arange(len(a) + len(b)), list(map(len, a)) + list(map(len, b)))[order]
    keep = np.repeat(count > 1, count)
    row, col = row[keep], np.repeat(np.arange(int((count > 1).sum())), count[count > 1])
    out = np.zeros((len(a), len(b)), np.float32)
    wide = 4096
    cuts = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else -1) + 1 + wide, wide))
    for c, (i, j) in enumerate(itertools.pairwise(cuts.tolist())):
        if i < j:
            m = np.zeros((len(a) + len(b), min(wide, int(col[j - 1]) - c * wide + 1)), np.float32)
            m[row[i:j], col[i:j] - c * wide] = 1
            out += m[: len(a)] @ m[len(a) :].T
    return out


def _roots(linked: np.ndarray, na: int) -> np.ndarray:
    """For members 0..na-1 (rows) and those after them (columns): the first member they are linked with, over any path."""
    label = np.arange(sum(linked.shape))
    top = len(label)
    while True:
        a, b = label[:na], label[na:]
        new_a = np.minimum(a, np.where(linked, b[None, :], top).min(1, initial=top))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(0, initial=top))
        new = np.concatenate([new_a, new_b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


_LINKED = "class binary, links long, root binary, bins array<long>"


def _verified(threshold: float, n: int):
    """Rows of (group, i, j) to each class's links in that pair of blocks; a row without a class counts the links by similarity."""

    def work(group, i, j, rows):
        seen, block, own, count, marks, sets = set(), [], [], [], [], []
        for c, k, times, groups, text in rows:
            c = bytes(c)
            if c in seen:
                continue
            seen.add(c)
            block.append(k)
            own.append(c)
            count.append(times)
            marks.append(groups)
            sets.append(shingles(text, n))
        block, count, marks = np.array(block), np.array(count, np.int64), np.array(marks, np.int64).reshape(len(own), -1)
        a = np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        if not len(a) or not len(b) or len(own) < 2:
            return None
        # a pair belongs to the smallest group that it shares, unless it shared a longer prefix before
        least = np.full((len(a), len(b)), np.iinfo(np.int64).max)
        for t in range(2 * TREES):
            x, y = marks[a, t][:, None], marks[b, t][None, :]
            same = (x == y) & (x != 0)
            if t < TREES:
                np.minimum(least, np.where(same, x, least), out=least)
            else:
                least[same] = 0
        todo = least == group
        if i == j:
            todo &= a[:, None] < b[None, :]
        rows_in, cols_in = todo.any(1), todo.any(0)
        if not rows_in.any():
            return None
        a, b, todo = a[rows_in], b[cols_in], todo[np.ix_(rows_in, cols_in)]
        size = np.array(list(map(len, sets)), float)
        common = _common([sets[k] for k in a], [sets[k] for k in b])
        similar = common / (size[a][:, None] + size[b][None, :] - common)
        linked = todo & (similar >= threshold - 1e-9)
        if not linked.any():
            return None
        kind = np.clip(((similar[linked] - threshold) / (1 - threshold + 1e-9) * BINS).astype(np.int64), 0, BINS - 1)
        yield None, 0, None, np.bincount(kind, minlength=BINS).tolist()
        links = np.zeros(len(own), np.int64)
        np.add.at(links, a, linked @ count[b])
        np.add.at(links, b, linked.T @ count[a])
        place = np.concatenate([a, b])
        label = _roots(linked, len(a))
        out: dict[int, set[int]] = {}
        for k, root in zip(place.tolist(), place[label].tolist(), strict=True):
            out.setdefault(k, set()).add(root)
        for k, roots in out.items():
            for m, root in enumerate(sorted(roots)):
                if links[k] or root != k:
                    yield own[k], int(links[k]) if m == 0 else 0, own[root], None

    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["class", "links", "root", "bins"])

    def run(batches):
        out = []
        for (group, i, j), rows in itertools.groupby(rows_of(batches, ("group", "i", "j", "class", "block", "times", "marks", "text")), lambda r: r[:3]):
            out.extend(work(group, i, j, (r[3:] for r in rows)) or ())
            if len(out) >= 4096:
                yield sent(out)
                out = []
        if out:
            yield sent(out)

    return run


def _links(spark: SparkSession, rows: DataFrame, classes: DataFrame, tries: DataFrame, depth: int, before: int, threshold: float, n: int, block: int) -> DataFrame:
    """Links of classes, by block, between those that share a prefix of `depth` levels in some tree and none of `before` levels in any."""
    prefix = lambda d: F.xxhash64("tree", F.substring("s", 1, d * LEVEL))
    member = tries.where(F.col("deepest") >= depth).select("class", "size", "tree", prefix(depth).alias("key"), F.when(F.col("deepest") >= before, prefix(before)).otherwise(0).alias("longer"))
    child = F.when(F.col("longer") == 0, F.xxhash64("class")).otherwise(F.col("longer"))
    groups = member.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("of"), F.min(child).alias("least"), F.max(child).alias("most"))
    groups = groups.where("n > 1 and least <> most")  # else all its pairs have met before
    # the same members in several trees are one group
    same = groups.groupBy("of", "n").agg(F.min("key").alias("group"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES)).cast("int")
    groups = groups.join(same, ["of", "n"]).select("key", "group", blocks.alias("blocks"))
    member = written(spark, member.join(groups, "key", "left").select("class", "tree", "longer", "group", "blocks"), "members")
    by_tree = lambda c: F.map_from_entries(F.collect_list(F.struct("tree", c)))
    filled = member.groupBy("class").agg(by_tree("group").alias("now"), by_tree("longer").alias("before"), F.count("group").alias("any")).where("any > 0")
    each = lambda by: F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at(by, t), F.lit(0).cast("long")))
    one = classes.join(filled, "class").select("class", "times", F.concat(each("now"), each("before")).alias("marks"), "one.doc_id", "one._text")
    # they grow with the documents, so they are never broadcast, however few they are
    texts = rows.withColumnRenamed("doc_id", "_id").join(one.withColumnRenamed("_text", "_t").hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("_t")))
    texts = texts.groupBy("class").agg(F.first("times").alias("times"), F.first("marks").alias("marks"), F.first("text").alias("text"))
    placed = member.where("group is not null").dropDuplicates(["class", "group"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("class", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    work = pairs.join(texts, "class").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    out = written(spark, work.mapInArrow(lean(_verified(threshold, n)), _LINKED), "links")
    discard(spark, member)
    return out


def forest(spark: SparkSession, rows: DataFrame, threshold: float, recall: float, n: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """(signed documents, links of classes by block, the prefix length at which the recall was reached)."""
    signed = written(spark, rows.withColumn("size", F.octet_length("text").cast("long")).mapInArrow(lean(_signed(n)), "doc_id long, _text long, size long, class binary, forest binary"), "signed")
    classes = signed.where("class is not null").groupBy("class").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "_text")).alias("one"), F.max("size").alias("size"), F.first("forest").alias("forest"))
    tries = trie(spark, classes, first_depth(threshold, recall))
    depth, before, links, bins = DEPTH, DEPTH + 1, None, np.zeros(BINS)
    while True:
        new = _links(spark, rows, classes, tries, depth, before, threshold, n, block)
        links = new if links is None else links.unionByName(new)
        found = new.where("class is null").select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS numbers
        for r in found:
            bins[r["bin"]] += r["n"]
        if enough(bins, depth, threshold, recall) or depth == 1:
            return signed, links.where("class is not null").drop("bins"), depth
        depth, before = shortened(bins, depth, threshold, recall), depth


def near_join(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links of every document; _text is the hash of its text, _group names its class.

    class_id: the smallest id of all documents linked with it over any number of links. n_links: other documents at least as
    similar as the threshold.
    """
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("_text", F.xxhash64("text"))
    signed, links, _ = forest(spark, rows, threshold, recall, n, block)
    label = components(spark, links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    count = links.groupBy("class").agg(F.sum("links").alias("links"))
    own = signed.where("class is not null").groupBy("class").agg(F.count("*").alias("times"), F.min("doc_id").alias("least"))
    marks = own.join(label, own["class"] == label["node"], "left").join(count, "class", "left")
    marks = marks.select("class", F.coalesce("label", "class").alias("label"), "times", "least", F.coalesce("links", F.lit(0)).alias("links"))
    first = marks.groupBy("label").agg(F.min("least").alias("class_id"))
    marks = marks.join(first, "label").select("class", "label", "class_id", (F.col("times") - 1 + F.col("links")).alias("n_links"))
    out = signed.select("doc_id", "_text", "class").join(marks, "class", "left")
    return out.select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "_text", F.col("label").alias("_group"))


def without_near_copies(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one with the smallest id, then hash of the text; of repeated rows one."""
    names = docs.columns
    marks = written(spark, near_join(spark, docs, threshold).where("n_links > 0"), "marks").groupBy("_group", F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).count()
    stays = marks.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_t")).alias("one"))
    marks = written(spark, marks.join(stays, "_group").select("_id", "_t", "count", (F.col("_id").eqNullSafe(F.col("one._id")) & (F.col("_t") == F.col("one._t"))).alias("stays")), "drops")
    x, = fresh(docs, "_x")
    hashed = docs.withColumn(x, F.xxhash64(whole()))
    marks = marks.toDF(*fresh(hashed, "_id", "_t", "_count", "_stays"))
    own_id, own_t, times, stay = map(F.col, marks.columns)
    same = F.col("doc_id").cast("long").eqNullSafe(own_id) & (F.col(x) == own_t)
    drop, again = marks.where(~stay | (times > 1)), marks.where(stay & (times > 1))
    out = hashed.join(drop, same, "left_anti").select(*names)
    if not again.isEmpty():  # rows that repeat one that stays
        out = out.unionByName(hashed.join(again, same, "left_semi").dropDuplicates(["doc_id", x]).select(*names))
    return out


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
