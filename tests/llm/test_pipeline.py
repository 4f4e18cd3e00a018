"""Queries on whole small tables, and the pipeline stage by stage against plain versions."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shardloom.llm import decontaminate, near_join, queries, toxicity
from shardloom.llm.vocab import public

from .test_repeats import brute, brute_cut, brute_gone


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, small).toPandas()[list(want.columns)]
    bag = lambda df: Counter(map(str, df.values.tolist()))
    assert bag(got) == bag(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, small, name):
    out = queries.QUERIES[name](spark, small)
    assert out.count() and len(set(out.columns)) == len(out.columns)


def test_op2(spark, small, docs):
    """All pairs of the table."""
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.QUERIES["op2_near_join"](spark, small).collect()}
    sets = {i: near_join.shingles(r.text) for i, r in docs.items()}
    group, links = {i: i for i in docs}, Counter()
    for a in docs:
        for b in docs:
            if a < b and len(sets[a]) and len(sets[b]) and 0.8 <= min(len(sets[a]), len(sets[b])) / max(len(sets[a]), len(sets[b])):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                    links.update((a, b))
                    x, y = sorted((group[a], group[b]))
                    group = {i: x if g == y else g for i, g in group.items()} if x != y else group
    assert got == {i: (group[i], links[i]) for i in docs} and len(set(group.values())) < len(docs)


def test_op4(spark, small, docs):
    """Rejected documents are labelled toxic ones; few of these stay."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op4_toxicity"](spark, small).collect()}
    assert set(got) == set(docs) and all(0 <= r.p_toxic <= 1 and r.rejected == (r.p_toxic >= toxicity.REJECT) for r in got.values())
    right = [got[i].rejected == bool(t) for i, t in labels.items() if i in got]
    assert sum(right) >= 0.95 * len(right)


def test_op10(spark, small, docs):
    """Exact copies of items by search; every distance found is that of the whole text, and within the limit."""
    items = {r.item_id: decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.QUERIES["op10_decontaminate"](spark, small).collect()}
    plain = {i: decontaminate.plain(r.text or "") for i, r in docs.items()}
    assert {(d, i) for d, t in plain.items() for i, x in items.items() if x and x in t} == {k for k, n in got.items() if not n}
    for (d, i), n in got.items():
        most = int(decontaminate.WITHIN * len(items[i]))
        assert n == decontaminate.distance(items[i], plain[d], most) <= most


def test_op8(spark, small, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op8_repeats"](spark, small).collect()}
    ids = sorted(docs)
    assert [tuple(got[i])[1:5] for i in ids] == brute([docs[i].text for i in ids])
    for i, (_, gone) in zip(ids, brute_gone([docs[i].text for i in ids]), strict=True):
        assert (got[i].n_cut, got[i].n_cut_spans) == (gone.sum(), (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


def test_stages(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = df.columns, {r.doc_id: r for r in df.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.written(spark, stage(spark, df, small), name)
        after[name] = {r.doc_id: r for r in df.collect()}
        if name != "bpe":
            assert df.columns == columns
        was, now = before, after[name]
        if name == "toxicity":
            gone = set(was) - set(now)
            assert all(labels.get(i, 1) for i in gone) and now.items() <= was.items()
        if name == "near_join":
            sets = {i: near_join.shingles(r.text) for i, r in was.items()}
            link = lambda a, b: (n := len(np.intersect1d(a, b))) / max(1, len(a) + len(b) - n) >= 0.8
            left = [sets[i] for i in now]
            assert not any(link(a, b) for k, a in enumerate(left) for b in left[:k] if len(a) and len(b))
            assert now.items() <= was.items()
        if name == "repeats":
            ids = sorted(was)
            for i, text in zip(ids, brute_cut([was[i].text for i in ids]), strict=True):
                assert now[i].text == text and now[i].n_chars == len(text)
                assert text != was[i].text or now[i] == was[i]
        if name == "decontaminate":
            assert set(now) == {i for i, r in was.items() if not any(t in decontaminate.plain(r.text) for t in items)}
        if name == "bpe":
            lib = Tokenizer.from_file(public("word_bpe_49k.json"))
            lib.no_truncation()
            lib.no_padding()
            for i, r in now.items():
                ids = lib.encode(was[i].text, add_special_tokens=False).ids
                assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
        before = now
    assert corpus_pipeline.run(spark, small).count() == len(before)
    assert toxicity.REJECT == 0.5
