"""The corpus pipeline: five stages from raw documents to encoded ones, each written before the next reads it.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns them with the columns of ``documents``;
the last returns each document that is left with its token count and the digest of its ids.
Defined cases: nulls, repeated rows, empty tables and further columns are treated as the operators describe; a row
with a null text has an empty text for every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe_chunks, decontaminate, exact_dedup, quality_net, sketch_join
from attesta.llm.queries import table, vocabulary
from attesta.operators.staging import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled documents that are not held out."""
    return quality_net.keep_good(docs, quality_net.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return sketch_join.drop_near(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, counted and digested, and the digest of the text they decode to."""
    done = bpe_chunks.round_trip(docs.select("doc_id", "text"), vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark), ("encode", encoded),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer cannot be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
