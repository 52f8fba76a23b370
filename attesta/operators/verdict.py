"""Verdict per claim, roll-ups per article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.relation import CONTRADICTION, ENTAILMENT

CLAIM = ["article_id", "claim_id"]


def verdicts(claims: DataFrame, first: DataFrame) -> DataFrame:
    """One row per claim: supported, contradicted or unverified, with its evidence."""
    label = (
        F.when(F.col("relation") == ENTAILMENT, "supported")
        .when(F.col("relation") == CONTRADICTION, "contradicted")
        .otherwise("unverified")
    )
    return claims.join(first, CLAIM, "left").withColumn("verdict", label)


def article_report(decided: DataFrame, sources_used: DataFrame) -> DataFrame:
    """Counts and flags per article. Lists stay as rows (see ``findings``).

    ``no_unverified`` is the wording of the original report; ``all_supported``
    also asks that nothing was contradicted.
    """
    def n(v):
        return F.count_if(F.col("verdict") == v)

    used = sources_used.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return (
        decided.groupBy("article_id")
        .agg(F.count(F.lit(1)).alias("n_claims"), n("supported").alias("n_supported"),
             n("contradicted").alias("n_contradicted"), n("unverified").alias("n_unverified"))
        .join(used, "article_id", "left")
        .withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
        .withColumn("has_sources", F.col("n_sources") > 0)
        .withColumn("no_unverified", F.col("n_unverified") == 0)
        .withColumn("all_supported", F.col("n_supported") == F.col("n_claims"))
    )


def findings(decided: DataFrame, sources_used: DataFrame) -> DataFrame:
    """The report as ordered rows: claims, sources, contradictions, unverified claims.

    Rows instead of one collected list per article, so an article of any
    size stays spread out; sort by (article_id, section, position) to read it.
    Articles without any source only list their claims.
    """
    has = sources_used.select("article_id").distinct()
    nothing = F.lit(None).cast("string")
    claims = decided.select(
        "article_id", F.lit("1 claim").alias("section"), F.col("claim_id").cast("string").alias("position"),
        F.col("claim").alias("content"), nothing.alias("source_url"), nothing.alias("source_claim"))
    sources = sources_used.select(
        "article_id", F.lit("2 source").alias("section"), F.col("url").alias("position"),
        F.col("url").alias("content"), nothing.alias("source_url"), nothing.alias("source_claim"))
    reported = decided.filter("verdict <> 'supported'").join(has, "article_id", "left_semi")
    problems = reported.select(
        "article_id",
        F.when(F.col("verdict") == "contradicted", "3 contradiction").otherwise("4 unverified").alias("section"),
        F.col("claim_id").cast("string").alias("position"), F.col("claim").alias("content"),
        "source_url", "source_claim")
    return claims.unionByName(sources).unionByName(problems)


def sources_used(hits: DataFrame) -> DataFrame:
    """Distinct (article, source) over all search results, also those never compared."""
    return hits.select("article_id", "url").distinct()


def unverified(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims without any non-neutral pair."""
    decided = pairs.filter("relation <> 'neutral'").select(*CLAIM).distinct()
    return claims.join(decided, CLAIM, "left_anti")


def inspected(tiles: DataFrame) -> DataFrame:
    """Pairs looked at per claim before the first decisive one (all, if none decides)."""
    stop = F.struct("search_rank", "at")
    first = (
        tiles.filter("at IS NOT NULL").groupBy(*CLAIM)
        .agg(F.min(stop).alias("stop"))
    )
    here, rank = F.col("search_rank"), F.col("stop.search_rank")
    looked = (
        F.when(F.col("stop").isNull() | (here < rank), F.col("n"))
        .when(here > rank, 0)
        .otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.col("stop.at") - F.col("first_id") + 1)))
    )
    return (
        tiles.join(first, CLAIM, "left")
        .groupBy(*CLAIM).agg(F.sum(looked).alias("pairs_inspected"))
    )
