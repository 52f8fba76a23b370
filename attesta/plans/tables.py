"""The roles the given tables play: articles, their claims, sources, pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import evidence, search, verdict
from attesta.operators.staging import spread, stage, stage_path

CLAIM = ["article_id", "claim_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to check: the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("article_id"),
        F.concat(F.lit("https://bench.example.org/"), "item_id").alias("url"), "text")


def sentence_claims(arts: DataFrame) -> DataFrame:
    """Sentences as claims; positions are dense because they come from one row."""
    return arts.select("article_id", "url", F.posexplode(tx.sentences("text")).alias("claim_id", "claim"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_claims(articles(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to check against: the documents, with a web address each."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
        "text", "source", "lang")


_STORED: dict[tuple[str, str], str] = {}


def corpus_index(spark: SparkSession, sf_dir: str) -> search.SearchIndex:
    """The search index of the documents: written once per application and folder, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORED:
        try:
            return search.open_index(spark, _STORED[key])
        except AnalysisException as e:      # the scratch folder was cleared
            if "PATH_NOT_FOUND" not in str(e):
                raise
    _STORED[key] = stage_path(spark, "corpus-index")
    return search.build_index(sources(spark, sf_dir), path=_STORED[key])


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 documents per claim, staged: later stages read it more than once."""
    docs = sources(spark, sf_dir)
    found = search.top_k_search(corpus_index(spark, sf_dir), claims(spark, sf_dir), CLAIM, "claim")
    return stage(found.join(docs.select("doc_id", "url"), "doc_id"), "hits")


def pairs(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = hits(spark, sf_dir) if found is None else found
    return evidence.nearest(found, claims(spark, sf_dir), sources(spark, sf_dir))


def first_hit(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = hits(spark, sf_dir) if found is None else found
    first, _ = evidence.in_waves(
        found, lambda some: pairs(spark, sf_dir, some), ["search_rank", "dist_rank"],
        ["search_rank", "dist_rank", "doc_id", "source_claim_id", "dist", "relation"])
    return evidence.with_source_text(first, sources(spark, sf_dir))


def decided(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return verdict.verdicts(claims(spark, sf_dir), first_hit(spark, sf_dir, found))


def source_site_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose labelled documents are of good quality in at least 17 of 20 cases."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "source").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return (
        labelled.groupBy("source").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("good") * 20 >= F.col("n") * 17)
        .select(F.concat(F.lit("https://*."), "source", F.lit(".example.org")).alias("pattern"))
    )
