"""Exact top-k by integer inner product: a three-phase uniform threshold over blocks of dimensions.

The score is a sum over m blocks of dimensions. Vectors are packed in chunks, queries in
blocks; each (chunk, block) pair is one row of the work, so scores are never materialised.
Phase 1 gathers, for every query, the k best entries of each local score list (a chunk's list
of one block of dimensions), and totals of these entries alone; the k-th best total is a safe
cutoff t. Phase 2 hands t out with the query blocks and collects the entries of at least t / m
in some list: whoever has t in total has that in one of m lists, also where scores are negative.
Vectors whose length in a block of dimensions cannot reach t / m with any query of the block are
not scored there. Phase 3 resolves the totals of the vectors and queries that have collected
entries, keeps those of at least t, and ranks them.

Vectors that are null, or hold null or non-finite components (also 256 times over), take no part;
so do vectors with no components. Vectors of another length than a query are not its candidates. Ties go to
the smaller id; repeated ids are separate candidates unless they are the query's own id. Null
ids take no part. Fewer than k candidates give fewer rows. Components of any finite size are exact;
a score outside the range of a long is that range's end. Empty tables give an empty result; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, table, written

CHUNK, BLOCK, SALT = 4096, 1024, 32
_PACK = "dim int, part long, n int, kind string, ids binary, cells binary"
_KINDS = {np.dtype("<i2"): 2.0**15, np.dtype("<i4"): 2.0**31, np.dtype("<i8"): 2.0**62}
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _packed(rows: int):
    """Vectors of (vec_id, embedding) to rows of up to `rows` packed ones of one length, in the smallest type; those beyond 62 bits apart, as doubles."""

    def run(batches):
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[tuple[int, bool], int] = {}

        def emit(key):
            ids = np.concatenate([x[0] for x in held[key]])
            cells = np.concatenate([x[1] for x in held[key]])
            held[key], count[key] = [], 0
            for i in range(0, len(ids), rows):
                own = cells[i : i + rows]
                kind = next((t for t, end in _KINDS.items() if np.abs(own).max() < end), own.dtype)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([kind.str]), pa.array([ids[i : i + rows].tobytes()], pa.binary()), pa.array([own.astype(kind).tobytes()], pa.binary())], names=["dim", "part", "n", "kind", "ids", "cells"])

        for b in batches:
            lists = b.column("embedding")
            size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            for dim in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == dim)
                x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    cells = np.floor(256.0 * x)
                fine = np.isfinite(cells).all(1)
                wide = fine & (np.abs(np.where(fine[:, None], cells, 0)) >= 2.0**62).any(1)
                for key, at in (((dim, False), fine & ~wide), ((dim, True), wide)):
                    if at.any():
                        held.setdefault(key, []).append((ids[own][at].astype(np.int64), cells[at]))
                        count[key] = count.get(key, 0) + int(at.sum())
                        if count[key] >= rows:
                            yield from emit(key)
        for key in list(held):
            if count[key]:
                yield from emit(key)

    return run


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    fine = vectors.where("vec_id is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull()))
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lean(_packed(rows)), _PACK).withColumn("part", F.monotonically_increasing_id())


def _matrix(n, kind, ids, cells, dim):
    return np.frombuffer(ids, np.int64, n), np.frombuffer(cells, kind).reshape(n, dim)


def _integers(x: np.ndarray) -> np.ndarray:
    """Python integers, which have no bound."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _product(a: np.ndarray, b: np.ndarray, lists: int) -> np.ndarray:
    """Exact: in doubles where no sum can leave their integers, else in 64-bit integers, else in Python's."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most * lists < 2.0**62:  # so that totals fit too
        return a.astype(np.int64) @ b.astype(np.int64).T
    return _integers(a) @ _integers(b).T


def _long(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int64 else np.array([min(_MOST, max(_LEAST, int(v))) for v in x.tolist()], np.int64)


def _blocks(r, lists: int):
    """Of a row of the work: ids of vectors and queries, and both in blocks of dimensions."""
    ids, x = _matrix(r["n"], r["kind"], r["ids"], r["cells"], r["dim"])
    qs, q = _matrix(r["q_n"], r["q_kind"], r["q_ids"], r["q_cells"], r["dim"])
    cut = np.array_split(np.arange(r["dim"]), min(lists, r["dim"]))
    return ids, qs, [x[:, d] for d in cut], [q[:, d] for d in cut]


def _pairs(qs, ids, i, j, score):
    return pa.RecordBatch.from_arrays([pa.array(qs[i]), pa.array(ids[j]), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])


def _gathered(k: int, lists: int):
    """Phase 1: of each local list the k best entries, and of these the k best totals."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, qs, xs, q = _blocks(r, lists)
                own = qs[:, None] == ids[None, :]
                parts = [_product(a, x, len(xs)) for a, x in zip(q, xs, strict=True)]
                take = np.zeros(own.shape, bool)
                for p in parts:
                    if len(ids) > k + 1:  # one place more, as the query's own may be among them
                        np.put_along_axis(take, np.argpartition(-p, k, axis=1)[:, : k + 1], True, 1)
                    else:
                        take[:] = True
                i, j = np.nonzero(take & ~own)
                total = _long(sum(p[i, j] for p in parts))
                # the k best totals of each query
                order = np.lexsort((~total, i))
                first = np.searchsorted(i, i, "left")
                best = order[np.arange(len(order)) - first < k]
                yield _pairs(qs, ids, i[best], j[best], total[best])

    return run


def _collected(lists: int):
    """Phases 2 and 3: entries of at least the cutoff's share in some list; totals of the vectors and queries that have any."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, qs, xs, q = _blocks(r, lists)
                t, m = np.frombuffer(r["cut"], np.int64), len(xs)
                share = t // m + (t % m > 0)
                take, known = np.repeat((t == _LEAST)[:, None], len(ids), 1), []
                for a, x in zip(q, xs, strict=True):
                    with np.errstate(all="ignore"):
                        long_a, long_x = (np.sqrt((v.astype(float) ** 2).sum(1)) for v in (a, x))
                        least = np.where(t > 0, t / (m * long_a), 0).min(initial=np.inf)
                    cols = np.flatnonzero(~(long_x < least * (1 - 1e-9)))
                    p = _product(a, x[cols], m)
                    take[:, cols] |= (p >= share[:, None]).astype(bool)
                    known.append((cols, p))
                take &= qs[:, None] != ids[None, :]
                rows, cols = np.flatnonzero(take.any(1)), np.flatnonzero(take.any(0))
                total = np.zeros((len(rows), len(cols)), np.int64)
                for (a, x), (had, p) in zip(zip(q, xs, strict=True), known, strict=True):
                    place = np.searchsorted(had, cols)
                    there = place < len(had)
                    there[there] = had[place[there]] == cols[there]
                    if there.all():
                        total = total + p[np.ix_(rows, place)]
                    else:
                        total = total + _product(a[rows], x[cols], m)
                i, j = np.nonzero(take[np.ix_(rows, cols)])
                score, i, j = _long(total[i, j]), rows[i], cols[j]
                best = score >= t[i]
                yield _pairs(qs, ids, i[best], j[best], score[best])

    return run


def _cuts(batches):
    """Query blocks with their cutoffs, in the order of their ids."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["q_ids"], np.int64)
            known = {x["query_id"]: x["cut"] for x in r["cuts"] or ()}
            low = _LEAST
            yield pa.RecordBatch.from_pydict({"q_part": [r["q_part"]], "cut": [np.array([known.get(x, low) for x in ids.tolist()], np.int64).tobytes()]})


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all vectors but its own id."""
    bounded_batches(spark)
    x = written(spark, packed(vectors, chunk), "vectors")
    q = packed(queries, block).select("dim", F.col("part").alias("q_part"), *(F.col(c).alias(f"q_{c}") for c in ("n", "kind", "ids", "cells")))
    q = written(spark, q, "queries")
    # every block meets every chunk of its dimension: numbers of parts only, in SALT shares of each dimension
    salted = q.select("dim", "q_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    pairs = x.select("dim", "part", F.pmod(F.xxhash64("part"), F.lit(SALT)).cast("int").alias("salt")).join(salted, ["dim", "salt"]).select("dim", "part", "q_part")
    pairs = written(spark, pairs, "pairs")
    spread = x.drop("dim").join(pairs, "part").join(q.drop("dim"), "q_part").repartition("part", "q_part")
    found = "query_id long, vec_id long, score long"
    gathered = spread.mapInArrow(lean(_gathered(k, lists)), found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cut = gathered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cut"))
    # cutoffs travel with the blocks of their queries, never all to everyone
    where = q.mapInArrow(lean(_members), "q_part long, query_id long")
    grouped = where.join(cut, "query_id").groupBy("q_part").agg(F.collect_list(F.struct("query_id", "cut")).alias("cuts"))
    cuts = written(spark, q.select("q_part", "q_ids").join(grouped, "q_part", "left").mapInArrow(lean(_cuts), "q_part long, cut binary"), "cuts")
    spread = x.drop("dim").join(pairs, "part").join(q.drop("dim").join(cuts, "q_part"), "q_part").repartition("part", "q_part")
    kept = spread.mapInArrow(lean(_collected(lists)), found)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _members(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["q_ids"], np.int64)
            yield pa.RecordBatch.from_pydict({"q_part": np.full(len(ids), r["q_part"]), "query_id": ids})


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(spark, every, every.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
