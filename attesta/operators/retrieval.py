"""Combine, compare and refine ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attesta.functions import text as tx
from attesta.operators.search import DIGITS, SearchIndex
from attesta.operators.segment import entities

RRF_CONSTANT = 60       # fixed value of reciprocal rank fusion


def compare(left: DataFrame, right: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Per query: units each result holds, how many are common, Jaccard similarity."""
    a = left.select(*keys, unit).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys, unit).distinct().withColumn("_b", F.lit(1))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return (
        a.join(b, [*keys, unit], "full")
        .groupBy(*keys).agg(F.count("_a").alias("n_by_proposition"), F.count("_b").alias("n_by_chunk"),
                            both.alias("common"), F.round(both / F.count(F.lit(1)), DIGITS).alias("jaccard"))
    )


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, keys: list[str], unit: str, k: int) -> DataFrame:
    """The k best units by the sum of 1 / (60 + rank) over two rankings."""
    rows = left.select(*keys, unit, "search_rank").unionByName(right.select(*keys, unit, "search_rank"))
    fused = rows.groupBy(*keys, unit).agg(
        F.round(F.sum(F.lit(1.0) / (RRF_CONSTANT + F.col("search_rank"))), DIGITS).alias("fused"))
    ranked = W.partitionBy(*keys).orderBy(F.desc("fused"), unit)
    return fused.withColumn("fused_rank", F.row_number().over(ranked)).filter(F.col("fused_rank") <= k)


def rerank(pairs: DataFrame, keys: list[str], unit: str = "doc_id") -> DataFrame:
    """Candidates in a new order: by their closest sentence, then by the old rank."""
    best = pairs.groupBy(*keys, "search_rank", unit).agg(F.min("dist").alias("best_dist"))
    return best.withColumn("new_rank", F.row_number().over(W.partitionBy(*keys).orderBy("best_dist", "search_rank")))


def expand(index: SearchIndex, queries: DataFrame, hits: DataFrame, keys: list[str], text: str = "claim",
           top_docs: int = 3, terms: int = 5, max_df_share: float = 0.2) -> DataFrame:
    """Queries with the strongest tf-idf terms of their first results appended."""
    near = hits.filter(F.col("search_rank") <= top_docs).select(*keys, "doc_id")
    found = (
        index.forward.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", F.inline("terms"))
    )
    counts = (
        index.terms.join(found.select("term").distinct(), "term", "left_semi")
        .filter(F.col("df") <= max_df_share * index.n_docs)
    )
    own = queries.select(*keys, F.explode(F.array_distinct(tx.tokens(text))).alias("term"))
    weight = F.round(F.sum(F.col("tf") * F.log(F.lit(float(index.n_docs)) / F.col("df"))), DIGITS)
    ranked = W.partitionBy(*keys).orderBy(F.desc("weight"), "term")
    extra = (
        near.join(found.join(counts, "term"), "doc_id")
        .groupBy(*keys, "term").agg(weight.alias("weight"))
        .join(own, [*keys, "term"], "left_anti")
        .withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= terms)
        .groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]), " ").alias("_extra"))
    )
    return queries.join(extra, keys, "left").withColumn(
        text, F.concat_ws(" ", text, "_extra")).select(*keys, text)


def entity_filter(hits: DataFrame, claims: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Hits whose source shares a named entity with the claim."""
    ours = claims.select(*keys, F.explode(entities(F.col("claim"))).alias("entity"))
    theirs = (
        sources.select("doc_id", F.explode(F.array_distinct(F.flatten(
            F.transform(tx.sentences("text"), entities)))).alias("entity"))
    )
    asked = hits.select(*keys, "doc_id").join(ours, keys)
    shared = asked.join(theirs, ["doc_id", "entity"], "left_semi").select(*keys, "doc_id").distinct()
    return hits.join(shared, [*keys, "doc_id"], "left_semi")
