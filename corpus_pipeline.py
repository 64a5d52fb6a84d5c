"""The corpus pipeline: each stage's rows are written as Parquet and are the next stage's documents.

Defined cases, in all stages: a null text is empty; null sources and languages are sources and languages of their own; rows that share an id are one
document for the near-duplicate stage, which keeps one of them, and rows with a null id take no part there and are kept; what ties
is decided by the smallest id; columns of any other name pass through all stages but the last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavespark.llm import bpe, mixing, order_minhash, quality, recompression
from wavespark.llm.common import Scratch
from wavespark.llm.queries import VOCABULARY


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(spark, docs, labels).where("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return order_minhash.deduplicate(spark, docs)


def said_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document of a smaller id has too."""
    return recompression.without_repeats(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights."""
    return mixing.emit(mixing.mix(spark, docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe.digests(spark, docs, VOCABULARY)


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", one_of_each),
    ("substring dedup", said_once),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]
#: A trained classifier and an alignment are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
