import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import near_join as J
from shardloom.llm.common import components


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    base, other = (rng.choices(words, k=200) for _ in range(2))

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    texts = [edited(base, rng.randrange(4)) for _ in range(70)] + [edited(other, rng.randrange(7)) for _ in range(20)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(3, 150))) for _ in range(60)]
    texts += [None, "", "...", "one two", "One, two!", "one two three four five", "x"] * 2 + [" ".join(rng.choices(words, k=30_000))] * 2
    ids = [None if i % 53 == 7 else i for i in range(len(texts))]
    return list(zip(ids, texts, strict=True)) + [(0, texts[0]), (0, texts[1])]


def brute(rows):
    sets = [J.shingles(t or "") for _, t in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if len(sets[i]) and len(sets[j]):
                both = len(np.intersect1d(sets[i], sets[j]))
                link[i, j] = link[j, i] = both / (len(sets[i]) + len(sets[j]) - both) >= J.THRESHOLD
    group = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(link[i]).tolist():
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group] if a != b else group
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    return sets, link, list(members.values())


@pytest.mark.parametrize(("block", "size"), [(1024, J.BLOCK_BYTES), (16, J.BLOCK_BYTES), (1024, 3000)])
def test_against_all_pairs(spark, monkeypatch, block, size):
    monkeypatch.setattr(J, "BLOCK_BYTES", size)
    rows = corpus()
    sets, link, groups = brute(rows)
    want = Counter()
    for g in groups:
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            want[rows[i][0], (min(ids) if ids else None) if len(sets[i]) else rows[i][0], int(link[i].sum())] += 1
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class string").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in J.near_join(spark, df, block=block).collect())
    assert got == want


def test_one_of_each_stays(spark):
    rows = corpus()
    sets, _, groups = brute(rows)
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, keys string")
    got = J.without_near_copies(spark, df).collect()
    assert got[0].keys == "kept"
    odd = spark.createDataFrame([(*r, "x", 1, "t", 0) for r in rows], "doc_id long, text string, _x string, _id int, _t string, stays int")
    assert Counter(map(tuple, J.without_near_copies(spark, odd).collect())) == Counter((r.doc_id, r.text, "x", 1, "t", 0) for r in got)
    named = Counter((r.doc_id, r.text) for r in got)
    for g in groups:
        if len(g) == 1 or not len(sets[g[0]]):
            assert all(named[rows[i]] for i in g)
        else:
            stay = [i for i in g if named[rows[i]]]
            ids = [rows[i][0] for i in g if rows[i][0] is not None]
            assert len({rows[i] for i in stay}) == 1 and (not ids or rows[stay[0]][0] == min(ids))
            assert named[rows[stay[0]]] == 1


def test_depth_keeps_recall():
    d = J.first_depth(J.THRESHOLD, J.RECALL)
    assert J.met(J.THRESHOLD, d) >= J.RECALL > J.met(J.THRESHOLD, d + 1)
    high, low = np.zeros(J.BINS), np.zeros(J.BINS)
    high[-1], low[0] = 100_000, 100_000
    assert J.enough(high, J.DEPTH, J.THRESHOLD, J.RECALL) and not J.enough(low, J.DEPTH, J.THRESHOLD, J.RECALL)
    assert not J.enough(np.zeros(J.BINS), J.DEPTH, J.THRESHOLD, J.RECALL) and J.enough(low, d, J.THRESHOLD, J.RECALL)


def test_the_next_length_is_the_longest_that_should_do():
    d = J.first_depth(J.THRESHOLD, J.RECALL)
    low, middle = np.zeros(J.BINS), np.zeros(J.BINS)
    low[0], middle[J.BINS // 2] = 100_000, 1_000_000
    assert J.shortened(low, J.DEPTH, J.THRESHOLD, J.RECALL) == d == J.shortened(np.zeros(J.BINS), J.DEPTH, J.THRESHOLD, J.RECALL)
    assert d < J.shortened(middle, J.DEPTH, J.THRESHOLD, J.RECALL) < J.DEPTH


def test_prefixes_are_shortened_until_the_recall_is_reached(spark):
    """Links of one kind each: sure ones are all found at full length, those at the threshold need shorter prefixes."""
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    for edits in (0, 4):
        texts = []
        for _ in range(400):
            own = rng.choices(words, k=206)
            other = list(own) if edits else [*own, rng.choice(words)]
            for k in range(edits):  # 5 shingles each, of 202: a similarity of 0.82
                other[25 + 50 * k] = "zz"
            texts += [" ".join(own), " ".join(other)]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_text", F.xxhash64("text"))
        _, links, depth = J.forest(spark, rows, J.THRESHOLD, 0.99, J.N, J.BLOCK)
        assert links.agg(F.sum("links")).first()[0] >= 2 * 400 * 0.99 - 4
        assert depth == J.DEPTH if not edits else depth < J.DEPTH


def test_tries_against_all_strings(spark):
    """The longest prefix that a string shares with any other of its tree, over partitions of a few rows."""
    rng = random.Random(15)
    step, rows = J.DEPTH * J.LEVEL, []
    for i in range(90):
        forest = [bytes(rng.choice(b"ab") if k % 2 else 0 for k in range(step)) for _ in range(J.TREES)]
        rows.append((i.to_bytes(2, "big"), 1, bytearray(b"".join(forest))))
    want = {}
    for t in range(J.TREES):
        own = [(c, bytes(f[t * step : t * step + step])) for c, _, f in rows]
        for c, s in own:
            n = max(next((k // J.LEVEL for k in range(step) if s[k] != x[k]), J.DEPTH) for d, x in own if d != c)
            if n >= 3:
                want[c, t] = n
    df = spark.createDataFrame(rows, "class binary, size long, forest binary")
    for parts in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = {(bytes(r["class"]), r.tree): r.deepest for r in J.trie(spark, df, 3).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys(range(100, 104), 100)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_join(spark, df).count() == 0 and J.without_near_copies(spark, df).count() == 0
