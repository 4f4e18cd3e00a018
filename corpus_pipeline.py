"""From raw documents to token ids, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import bpe, decontaminate, near_join, repeats, toxicity
from shardloom.llm.common import discard, table, written
from shardloom.llm.vocab import public


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go."""
    model = toxicity.fit_chain(spark, docs, table(spark, sf_dir, "labels"), toxicity.categories())
    return toxicity.score(spark, docs, model).where(F.col("p_toxic") < toxicity.REJECT).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_join.without_near_copies(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words or of 400 bytes that occur more than once are cut out of the texts; every document stays, n_chars follows."""
    return repeats.without_repeats(spark, docs, covers=(repeats.BYTES, repeats.WORDS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text that they stand for."""
    out = bpe.encode_decode(spark, docs.select("doc_id", "lang", "source", "text"), public("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [("toxicity", reject_toxic), ("near_join", one_of_each), ("repeats", cut_repeats), ("decontaminate", drop_leaks), ("bpe", to_tokens)]

#: SQL has no classifier and no merges by rank; tests compare the stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = written(spark, stage(spark, docs, sf_dir), name), docs
        discard(spark, before)  # what the stage read; the tables themselves stay
    return docs
