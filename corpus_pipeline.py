"""Corpus pipeline: quality filter, line dedup, near-dedup, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and is written and reread before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import bpe, decontamination, linedup, neardup, quality
from vellumspark.llm.common import Scratch, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; it is trained on the labelled ones among `docs`."""
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars brought up to date. A document of which nothing but blanks is left goes."""
    got = linedup.clean(spark, docs).where((F.col("_n_removed") == 0) | F.col("text").rlike(r"\S"))
    return got.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return neardup.keep_first(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontamination.remove(spark, docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (binary, little-endian 32 bits) and n_tokens."""
    return bpe.encode(docs, bpe.automaton(spark, bpe.default_path())).withColumn("n_tokens", bpe.n_tokens())


STAGES = [("quality classifier", quality_filter), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("bpe encoding", encode)]

#: SimHashes, a trained model and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if last is not None:
                scratch.drop(last)
            last = docs
    return docs
