import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import repeats as R

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(hashlib.blake2b(d[i : i + 400]).digest() for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 399):
            if count[hashlib.blake2b(d[i : i + 400]).digest()] > 1:
                gone[i : i + 400] = True
        rises = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(d, gone.tolist(), strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((rises == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_gone(texts):
    """For each text its bytes, and which of them the bytes' and the words' cover find, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    count = Counter(hashlib.blake2b(d[i : i + 400]).digest() for d in data for i in range(len(d) - 399))
    words = [[(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(r"\S+", t)] if not t.isascii() else [m.span() for m in re.finditer(r"\S+", t)] for t in ((t or "") for t in texts)]
    said = [[d[a:b] for a, b in w] for d, w in zip(data, words, strict=True)]
    seen = Counter(tuple(w[i : i + 51]) for w in said for i in range(len(w) - 50))
    for d, at, w in zip(data, words, said, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 399):
            if count[hashlib.blake2b(d[i : i + 400]).digest()] > 1:
                gone[i : i + 400] = True
        lost = np.zeros(len(w) + 2, int)
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                lost[i + 1 : i + 52] = 1
        for a, b in zip(np.flatnonzero(np.diff(lost) == 1), np.flatnonzero(np.diff(lost) == -1), strict=True):  # runs of words
            gone[at[a][0] : at[b - 1][1]] = True
        yield d, gone


def brute_cut(texts):
    return [bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore") for d, gone in brute_gone(texts)]


def corpus():
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    base = some(3000)
    texts = [None, "", base[:1000], base[5:900] + "Q" + base[:700], "ab" * 900, "x" * 401, "x" * 400, "y" * 399, base[100:499] + "é" * 300, base[100:500] + "ö", base[:1000], some(900)]
    for _ in range(60):
        texts.append(some(rng.randrange(500)) + base[1200 : 1200 + rng.randrange(380, 700)] + some(rng.randrange(500)))
    line = some(37) + " "
    texts += [line * rng.randrange(8, 40) + some(rng.randrange(50)) for _ in range(40)]
    return texts


@pytest.mark.parametrize(("hot", "local"), [(R.HOT, R.LOCAL), (3, R.LOCAL), (R.HOT, 2), (5, 1)])
def test_against_brute_force(spark, hot, local):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket int").repartition(5)
    found = R.repeated(spark, df, hot=hot, local=local).select("doc_id", "text", "_copies", "_spans").mapInArrow(R._digest, DIGEST)
    got = {r.doc_id: tuple(r)[1:] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_long_texts_in_pieces(spark):
    rng = random.Random(8)
    one = "".join(rng.choices("abcdefgh", k=2 * R.PIECE + 5000))
    cut = R.PIECE - 300
    texts = [one, "x" + one[cut : cut + 700] + "y", "z" + one[2 * R.PIECE - 100 : 2 * R.PIECE + 350]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in R.repeated(spark, df).select("doc_id", "text", "_copies", "_spans").mapInArrow(R._digest, DIGEST).collect()}
    assert got == {0: 700 + 450, 1: 700, 2: 450}


def test_cover():
    assert len({(a - b) % R.V for a in R.D.tolist() for b in R.D.tolist()}) == R.V


def test_cut_texts(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, _other string")
    out = {r.doc_id: r for r in R.without_repeats(spark, df).collect()}
    assert set(out) == set(range(len(texts))) and out[11].text == texts[11] and out[2].text == "" and out[0].text == "" and out[3]._other == "en"
    assert R.without_repeats(spark, df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "q" * 500), (None, "q" * 500)], "doc_id long, text string")
    assert [r.text for r in R.without_repeats(spark, null).collect()] == ["", ""]
    assert R.without_repeats(spark, df.where(F.col("doc_id") < 2)).count() == 2


def test_clashing_columns(spark):
    texts = corpus()[:14]
    df = spark.createDataFrame([(i, "k", 5, [b"s"], b"m", "b", t) for i, t in enumerate(texts)], "doc_id long, _key string, _copies int, _spans array<binary>, _spans1 binary, c0 string, text string")
    out = {r.doc_id: r for r in R.without_repeats(spark, df, covers=(R.BYTES, R.WORDS)).collect()}
    plain = {r.doc_id: r.text for r in R.without_repeats(spark, df.select("doc_id", "text"), covers=(R.BYTES, R.WORDS)).collect()}
    assert {i: r.text for i, r in out.items()} == plain and all(tuple(r)[1:6] == ("k", 5, [b"s"], b"m", "b") for r in out.values())
    assert R.repeated(spark, df).count() == len(texts)


@pytest.mark.parametrize("local", [R.LOCAL, 1])
def test_both_covers(spark, local):
    """Short-worded copies with edits: words find what bytes leave, next to and across what bytes remove."""
    rng = random.Random(17)
    say = lambda k: [rng.choice("aeiouéñ") + rng.choice(["", "b", "zd", "qrstuvw"]) for _ in range(k)]
    base = say(900)
    texts = []
    for i in range(50):
        own = base[rng.randrange(200) :][: rng.randrange(60, 500)]
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = "edit"
        texts.append((" " if i % 2 else "\n  ").join(say(rng.randrange(30)) + own + say(rng.randrange(30))))
    texts += [texts[3], None, " ".join(base[:51]), " ".join(base[:51]), "x " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = R.repeated(spark, df, covers=(R.BYTES, R.WORDS), local=local)
    got = {r.doc_id: r for r in found.select("doc_id", "text", "_copies", "_spans", "_spans1").mapInArrow(R._both_digests, DIGEST + ", n_cut long, n_cut_spans long").collect()}
    more = 0
    for i, (_, gone) in enumerate(brute_gone(texts)):
        more += gone.sum() > got[i].n_removed
        assert (got[i].n_cut, got[i].n_cut_spans) == (gone.sum(), (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), i
    assert more > 10


def test_word_cover():
    c = R.WORDS
    assert len({(a - b) % c.period for a in c.residues for b in c.residues}) == c.period <= c.window == 51


@pytest.mark.parametrize("hot", [R.HOT, 3])
def test_passages_of_over_50_words(spark, hot):
    """Against counting all windows of 51 words; passages of short words have far less than 400 bytes."""
    rng = random.Random(11)
    say = lambda k: [rng.choice("aeiouéñ") + rng.choice(["", "b", "zd"]) for _ in range(k)]
    base = say(400)
    texts = [" ".join(say(rng.randrange(60)) + base[i : i + rng.randrange(45, 70)] + say(rng.randrange(60))) for i in range(0, 320, 4)]
    texts += [" ".join(say(40) + base[330:381] + say(9)), "\n".join(say(7) + base[330:381]), " ".join(say(40) + base[10:60]), None, "", " ".join(base[:51]), " ".join(base[:51]), "x " * 200]
    count = Counter(tuple(w[i : i + 51]) for t in texts for w in [(t or "").split()] for i in range(len(w) - 50))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string").repartition(5)
    found = R.repeated(spark, df, hot=hot, covers=(R.WORDS,)).select("doc_id", "text", "_copies", "_spans")
    cut = {r.doc_id: r.text for r in found.mapInArrow(R._cut("text", ["doc_id", "text"], (R.WORDS,)), "doc_id long, text string").collect()}
    both = {r.doc_id: r.text for r in R.without_repeats(spark, df, covers=(R.BYTES, R.WORDS)).collect()}
    some = 0
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = [any(count[tuple(w[j : j + 51])] > 1 for j in range(max(0, k - 50), min(k, len(w) - 51) + 1)) for k in range(len(w))]
        some += any(gone)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert cut[i].split() == kept and (any(gone) or cut[i] == (t or ""))
        assert both[i].split() == kept or i == len(texts) - 1
    assert some > 60
