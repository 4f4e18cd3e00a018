import math
import random

import pytest

from shardloom.llm import topk


def vectors():
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(20)] + [(400, None), (401, [None] * 8), (402, [math.nan] * 8), (403, [math.inf] * 8), (404, []), (405, [0.1, 0.2]), (None, [0.5] * 8), (3, [0.5] * 8), (350, [-0.9] * 8), (450, [-3.0] * 8)]
    return rows


@pytest.mark.parametrize(("k", "lists", "chunk", "block"), [(5, 4, 64, 3), (1, 2, 4096, 512), (7, 8, 7, 2), (400, 4, 64, 64)])
def test_against_all_scores(spark, k, lists, chunk, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = sorted(map(tuple, topk.top_k(spark, df, df.where("vec_id % 50 = 0"), k, lists, chunk, block).collect()))
    whole = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    assert got == sorted(want)


def test_large_components(spark):
    """Sums beyond the integers of doubles."""
    rows = [(0, [2.0**16, 1.0]), (1, [2.0**27, 3.0]), (2, [2.0**27, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(spark, df, df.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**59 + 256 * 768), (2, 2**59 + 256 * 512)]


def test_components_of_any_size(spark):
    """Beyond 64-bit integers the order is exact, and scores end where a long does; 256 times 1e308 is no double."""
    e = [[2.0**40, 1.0], [2.0**40, 2.0], [1e20, -1e20], [1e20, -1e19], [1e300, 0.0], [-1e300, 0.0], [1e308, 0.0], [0.5, 0.25], [2.0**22, 7.0]]
    df = spark.createDataFrame([(i * 50, x, "clash") for i, x in enumerate(e)], "vec_id long, embedding array<double>, dim string")
    whole = {i * 50: [math.floor(256 * v) for v in x] for i, x in enumerate(e) if math.isfinite(256 * max(x))}
    ends = lambda s: max(-(2**63), min(2**63 - 1, s))
    for lists in (1, 2):
        got = sorted(map(tuple, topk.top_k(spark, df, df, 3, lists).collect()))
        want = []
        for q, a in whole.items():
            scores = sorted((-ends(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in whole.items() if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:3])]
        assert got == sorted(want)


def test_vectors_out_of_reach_are_left_alone():
    """Where no local score can reach the cutoff's share, nothing is collected; what is collected has whole totals."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x, q = rng.integers(-200, 200, (500, 16)), rng.integers(-200, 200, (4, 16))
    total = q @ x.T
    t = np.sort(total, 1)[:, -3].copy()
    row = {"dim": 16, "n": 500, "kind": "<i2", "ids": np.arange(500).tobytes(), "cells": x.astype("<i2").tobytes(), "q_n": 4, "q_kind": "<i8", "q_ids": np.arange(1000, 1004).tobytes(), "q_cells": q.tobytes(), "cut": t.tobytes()}
    out = pa.Table.from_batches(topk._collected(4)([pa.RecordBatch.from_pylist([row])])).to_pydict()
    assert {(a - 1000, b): s for a, b, s in zip(*(out[c] for c in ("query_id", "vec_id", "score")), strict=True)} == {(i, j): total[i, j] for i in range(4) for j in range(500) if total[i, j] >= t[i]}
    out = pa.Table.from_batches(topk._collected(4)([pa.RecordBatch.from_pylist([row | {"cut": np.full(4, 2**40).tobytes()}])]))
    assert out.num_rows == 0


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(spark, df, df).count() == 0
