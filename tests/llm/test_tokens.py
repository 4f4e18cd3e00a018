"""BPE, token files and word pieces against the libraries and plain versions."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardloom.llm import bpe, token_files, word_pieces
from shardloom.llm.vocab import public

ODD = [
    "", " ", "Hello World!! it's  we'll   \n\n x ", "<|endoftext|> a<|startoftext|>b <|endo", "Σίσυφος ΣΑΣ İstanbul ŉ ½ ² 3.14 123", "e\u0301 café", "a\u00a0b\u0085c\u2003d\x1cx\x0b", "日本語テキスト 🙂🙂", "\x00\x01 ab",
    "ª º µ Ǆ ſ ŉ", "it'S IT'S 'S", "x" * 300, "naïve'sÀ", "a\tb\r\nc", "   lead", "_under_score_ -- ++", "\u00ad soft\u00ad", "ab" * 40_000,
]


@pytest.fixture(scope="module")
def texts(spark, small):
    return ODD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]


@lru_cache(None)
def library(name):
    out = Tokenizer.from_file(public(name))
    out.no_padding()
    out.no_truncation()
    return out


def test_bpe_equals_the_library(texts):
    own, lib = bpe.codec(public("word_bpe_49k.json")), library("word_bpe_49k.json")
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids and own.decode(np.array(ids, "<u4")) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    own, lib = bpe.codec(public("word_bpe_49k.json")), library("word_bpe_49k.json")
    assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    mine, lib = token_files.encoder(public("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    assert mine(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_merges_by_rank_then_place():
    """Against merging the best pair of the whole word again and again."""
    own = bpe.codec(public("word_bpe_49k.json"))
    rng = random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"aeinorst") for _ in range(rng.randrange(1, 25)))
        ids = [own.inner[b] for b in word[:-1]] + [own.last[word[-1]]]
        while found := [(own.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in own.merges]:
            _, i = min(found)
            ids[i : i + 2] = [own.merges[ids[i], ids[i + 1]][1]]
        assert own.merged(word) == ids


def test_bpe_frames(spark, texts):
    path, lib = public("word_bpe_49k.json"), library("word_bpe_49k.json")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, token_ids string")
    out = bpe.decode(spark, bpe.encode(spark, df, path), path).collect()
    for r in out:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert {tuple(r) for r in bpe.encode_decode(spark, df, path).select("doc_id", "decoded").collect()} == {(r.doc_id, r.decoded) for r in out}
    digests = {r.doc_id: r for r in bpe.round_trips(spark, df, path).collect()}
    assert digests[2].ids_sha256 == hashlib.sha256(np.array(lib.encode(texts[2], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(spark, df.limit(0), path).count() == 0 and bpe.round_trips(spark, df.limit(0), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=500))
def test_words_of_ids(ids):
    x = np.array(ids, np.uint64)
    words = token_files.packed(x)
    assert (token_files.unpacked(words, len(x)) == x).all()
    marks = token_files.offsets(words, len(x))
    for k, before in enumerate(marks.tolist()):  # a part decodes without the rest
        part = words[k * token_files.EVERY :]
        if not (k and token_files._raw(words)[k * token_files.EVERY]):
            assert (token_files.unpacked(part, len(x) - before) == x[before:]).all()


@lru_cache(1)
def whole_of(spark, path):
    """All ids, block by block."""
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.part, r.block))
    return [x for r in rows for x in token_files.unpacked(np.frombuffer(r.words, np.uint64), r.n_ids).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(2**60, 2**64 - 1)), min_size=1, max_size=900), st.integers(-5, 900), st.integers(0, 900))
def test_any_stretch_of_a_block(ids, lo, n):
    x = np.array(ids * 4, np.uint64)
    words = token_files.packed(x)
    got = token_files.stretch(words, token_files.offsets(words, len(x)), len(x), lo, lo + n)
    assert got.tolist() == x[max(lo, 0) : max(lo + n, 0)].tolist()


def test_token_files(spark, texts, tmp_path):
    lib = library("byte_bpe_50k.json")
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, "no id"), (5000, None), (5000, None), (5000, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(spark, df.withColumn("part", F.lit("clash")), public("byte_bpe_50k.json"), path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    at, left = 0, {}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        left.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    whole = {r.doc_id: r.token_ids for r in token_files.read_ids(spark, path).collect()}
    assert whole[7] == [*lib.encode(texts[1], add_special_tokens=False).ids, 2]
    every = [x for r in got for x in whole_of(spark, path)[r.start : r.start + r.n_tokens]]
    for lo, hi in ((0, 5), (at // 2, at // 2 + 700), (at - 3, at + 9), (-4, at), (70, 70)):
        part = [x for r in sorted(token_files.read_range(spark, path, lo, hi).collect()) for x in r.ids]
        assert part == every[max(lo, 0) : hi]
    token_files.write_tokens(spark, df.limit(0), public("byte_bpe_50k.json"), f"{path}-none")
    assert token_files.read_tokens(spark, f"{path}-none").count() == 0


def greedy(word, starts, inner):
    i = n = 0
    while i < len(word):
        pieces = starts if i == 0 else inner
        j = next((j for j in range(min(len(word), i + 64), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 0
        i, n = j, n + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(5)
    for _ in range(2000):
        starts, inner = ({"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(6)} for _ in range(2))
        own = word_pieces.Automaton(starts, inner)
        for _ in range(5):
            word = "".join(rng.choices("abc", k=rng.randrange(1, 12)))
            assert own._count(word) == greedy(word, starts, inner)


def test_token_counts(spark, texts):
    import sentencepiece

    path = public("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    starts, inner = {n[1:] for n in names if n[0] == "▁" and len(n) > 1 and "▁" not in n[1:]}, {n for n in names if "▁" not in n}
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts[:60], None])], "doc_id long, text string, n_words int")
    for r in word_pieces.token_counts(spark, df, path).collect():
        each = [greedy(w, starts, inner) for w in word_pieces.WORDS.findall((texts[:60] + [""])[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(max(1, n) for n in each), each.count(0))
    assert word_pieces.token_counts(spark, df.limit(0), path).count() == 0


def spelled_out(word, pieces, raw):
    """Plain greedy longest match over the whole list; bytes where nothing fits."""
    word = "▁" + word
    i = n = 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + 64), i, -1) if word[i:j] in pieces), None)
        if j is None and not raw.issuperset(word[i].encode()):
            return 0
        n += 1 if j else len(word[i].encode())
        i = j or i + 1
    return n


def test_automaton_spells_whole_vocabularies():
    rng = random.Random(6)
    for _ in range(3000):
        pieces = {rng.choice(["", "▁"]) + "".join(rng.choices("abcé", k=rng.randrange(1, 5))) for _ in range(8)} | set(rng.choice(["", "▁"]))
        raw = set(rng.choice([b"", b"abc", "▁é".encode(), "▁abcé".encode()]))
        byte = lambda c, raw=raw: len(c.encode()) if raw.issuperset(c.encode()) else 0
        own = word_pieces.Automaton({p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if p[0] != "▁"}, 1 if "▁" in pieces else byte("▁"), byte)
        for _ in range(5):
            word = "".join(rng.choices("abcé", k=rng.randrange(1, 12)))
            assert own._count(word) == spelled_out(word, pieces, raw), (word, pieces, raw)


def test_op6_counts_every_piece_of_spellable_words(spark, texts, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    raw = {int(model.id_to_piece(i)[3:-1], 16) for i in ids if model.is_byte(i)}
    said = ["ñmente", "日本語テキスト" * 9, "🙂", "▁", "\U00012000\U00012001", *texts[:60], None]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in word_pieces.op6_token_counts(spark, str(tmp_path)).collect()}
    for i, t in enumerate(said):
        each = [spelled_out(w, pieces, raw) for w in word_pieces.WORDS.findall(t or "")]
        assert got[i] == (len(each), sum(max(1, n) for n in each), each.count(0)), t
    assert got[0] == (1, 3, 0) and got[1][1] > 63 and got[4][1:] == (9, 0)


def test_op3_and_op7_on_whole_tables(spark, small):
    """Every document of the table against the library."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lib, tail = library("word_bpe_49k.json"), [2]
    for r in bpe.op3_bpe(spark, small).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    lib, at = library("byte_bpe_50k.json"), 0
    got = sorted(token_files.op7_token_files(spark, small).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(docs)
    for r in got:
        ids = np.array(lib.encode(docs[r.doc_id], add_special_tokens=False).ids + tail, "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
