"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocab import only

#: Rows and bytes that one Arrow batch hands to Python at most; texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
SALT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run; once a context."""
    root = Path(__file__).resolve().parents[1]
    if getattr(spark.sparkContext, "_shardloom_sent", False) or not root.is_dir():
        return
    to = Path(tempfile.mkdtemp(prefix="shardloom-")) / "shardloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._shardloom_sent = True


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length; every operator asks for the same, so lazy plans of several agree."""
    ship(spark)
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that none of df's columns bears, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f):
    """f for mapInArrow, in a worker that keeps nothing of other operators before and gives memory back after."""

    def run(batches):
        only(f.__module__)
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def lean_group(f):
    """The same for a group's function."""

    def run(group):
        only(f.__module__)
        try:
            return f(group)
        finally:
            _give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without, and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: its lineage is cut and a lost executor costs no recomputation."""
    folder = f"{shared_dir(spark)}/shardloom-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.__dict__["_written_to"] = folder
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete what written() made, once nothing that is still to be computed reads it. What no one discards stays until the shared folder is cleared."""
    if folder := df.__dict__.get("_written_to"):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the constants of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(keys)]]))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def rows_of(batches, columns):
    """The rows of Arrow batches as tuples."""
    return itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns), strict=True) for b in batches)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label of all nodes of the edges (a, b): the smallest node that it is linked with, itself included.

    Alternating large and small stars; every round is written to the shared folder, and two numbers decide whether it was the last.
    """

    def stars(e: DataFrame, small: bool) -> DataFrame:
        if small:
            near = e
        else:
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # a node may have a great share of all edges, so each node's least one goes to SALT places
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")).join(salted, ["a", "salt"]).drop("salt")
        if small:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        return r[0], r[1]

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(spark, e, "edges")
    was, now = None, state(e)
    while was != now:
        e, old = written(spark, stars(stars(e, False), True), "edges"), e
        was, now = now, state(e)
        discard(spark, old)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
