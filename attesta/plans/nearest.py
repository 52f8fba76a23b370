"""Queries over vectors and retrieval comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vectors as vx
from attesta.operators import evidence, retrieval, search
from attesta.operators import neighbours as nb
from attesta.operators import segment as sg
from attesta.operators import vector_index as vi
from attesta.operators.staging import spread, stage
from attesta.plans import tables as tb
from attesta.plans.registry import query
from attesta.plans.sqlkit import bm25, cte, exploded, sents, toks, with_ctes
from attesta.plans.texts import documents, window_sql

DIMS = 64
CLAIM = tb.CLAIM


def vectors(spark, sf):
    rows = tb.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return spread(rows, "vec_id")


def as_queries(df):
    return df.withColumnRenamed("vec_id", "query_id")


def knn_sql(k: int, extra: str = "true", part: str = "query_id") -> str:
    return f"""SELECT query_id, vec_id, dist, dist_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS dist_rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(range(1, {DIMS + 1}),
          lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6)
          AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {extra})) WHERE dist_rank <= {k}"""


@query("k01_nearest_in_group", knn_sql(5, "a.label = b.label"))
def k01_nearest_in_group(spark, sf):
    rows = vectors(spark, sf)
    return nb.nearest_vectors(as_queries(rows), rows, 5, on=("label",), skip_self=True).drop("label")


@query("k02_nearest_overall", knn_sql(4))
def k02_nearest_overall(spark, sf):
    rows = vectors(spark, sf).drop("label")
    return nb.nearest_vectors(as_queries(rows), rows, 4, skip_self=True)


@query("m07_nearest_by_projection")
def m07_nearest_by_projection(spark, sf):
    rows = vectors(spark, sf).drop("label")
    return nb.nearest_by_projection(as_queries(rows), rows, 5, DIMS, skip_self=True)


@query("m07_projection_recall")
def m07_projection_recall(spark, sf):
    rows = vectors(spark, sf).drop("label")
    exact = nb.nearest_vectors(as_queries(rows), rows, 5, skip_self=True)
    return nb.recall(nb.nearest_by_projection(as_queries(rows), rows, 5, DIMS, skip_self=True), exact)


def _indexed(spark, sf):
    """A stored index of the table, searched for every vector of it."""
    rows = vectors(spark, sf).drop("label")
    index = vi.build(rows)
    return index, rows, vi.search(index, as_queries(rows), skip_self=True)


@query("m07_nearest_by_index")
def m07_nearest_by_index(spark, sf):
    return _indexed(spark, sf)[2]


@query("m07_index_recall")
def m07_index_recall(spark, sf):
    """Recall at 5 against the exact form, and what a search opens and ranks."""
    index, rows, found = _indexed(spark, sf)
    exact = nb.nearest_vectors(as_queries(rows), rows, 5, skip_self=True)
    return nb.recall(found, exact).select(
        "n_exact", "n_found", "recall", F.lit(len(index.model.centres)).alias("cells"), F.lit(index.probes).alias("cells_read"),
        F.lit(index.rerank).alias("reranked"))


@query("m07_text_vectors", f"""
    SELECT doc_id, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)::DOUBLE), 6) AS value FROM (
      SELECT doc_id, (('0x' || substr(md5(t), 1, 4))::INT % {vx.BUCKETS}) AS bucket, count(*) AS tf
      FROM (SELECT doc_id, unnest({toks('text')}) AS t FROM documents) GROUP BY ALL)""")
def m07_text_vectors(spark, sf):
    return documents(spark, sf).select("doc_id", F.inline(vx.hashed_text("text")))


# ---- ranked retrieval variants --------------------------------------------------------

def overlap_sql(units: str, key: str, k: int) -> str:
    """Top k units per claim by share of the claim's tokens they hold."""
    return f"""SELECT article_id, claim_id, {key}, search_rank, score FROM (SELECT *, row_number() OVER
        (PARTITION BY article_id, claim_id ORDER BY score DESC, {key}) AS search_rank FROM (
        SELECT article_id, claim_id, {key}, round(sum(1.0::DOUBLE / n), 6) AS score FROM (
          SELECT article_id, claim_id, len(t) AS n, unnest(t) AS term FROM (
            SELECT article_id, claim_id, list_distinct({toks('claim')}) AS t FROM claims))
        JOIN (SELECT DISTINCT {key}, term FROM (SELECT {key}, unnest({toks('unit')}) AS term FROM {units})) USING (term)
        GROUP BY article_id, claim_id, {key})) WHERE search_rank <= {k}"""


cte("windows", window_sql(200, 50))
cte("chunk_units", "SELECT {'doc_id': doc_id, 'chunk_id': chunk_id} AS unit_id, chunk AS unit FROM windows", "windows")
cte("prop_units", "SELECT {'doc_id': doc_id, 'chunk_id': chunk_id, 'pos': pos} AS unit_id, proposition AS unit FROM (" + exploded(
    sents("chunk"), "doc_id, chunk_id", "windows", "proposition") + ")", "windows")
cte("chunk_top", overlap_sql("chunk_units", "unit_id", 4), "claims", "chunk_units")
cte("prop_top", overlap_sql("prop_units", "unit_id", 4), "claims", "prop_units")


def chunk_units(spark, sf):
    cut = documents(spark, sf).select("doc_id", F.posexplode(sg.word_windows(F.col("text"))).alias("_p", "unit"))
    return cut.select(F.struct("doc_id", (F.col("_p") + 1).alias("chunk_id")).alias("unit_id"), "unit")


def prop_units(spark, sf):
    return chunk_units(spark, sf).select("unit_id", F.posexplode(tx.sentences("unit")).alias("_p", "unit")).select(
        F.struct("unit_id.doc_id", "unit_id.chunk_id", F.col("_p").alias("pos")).alias("unit_id"), "unit")


def overlap_top(spark, sf, units, k=4):
    index = search.build_index(units, text="unit", doc_id="unit_id")
    return search.top_k_search(index, tb.claims(spark, sf), CLAIM, "claim", k=k, scheme="overlap")


@query("k02_top_chunks", with_ctes(
    "SELECT article_id, claim_id, unit_id.doc_id AS doc_id, unit_id.chunk_id AS chunk_id, search_rank, score FROM chunk_top", "chunk_top"))
def k02_top_chunks(spark, sf):
    return overlap_top(spark, sf, chunk_units(spark, sf)).select(*CLAIM, "doc_id.doc_id", "doc_id.chunk_id", "search_rank", "score")


@query("a07_retrieval_comparison", with_ctes("""
    SELECT article_id, claim_id, count(p) AS n_by_proposition, count(c) AS n_by_chunk, count(*) FILTER (WHERE p AND c) AS common,
      round(count(*) FILTER (WHERE p AND c) / count(*), 6) AS jaccard FROM (
      SELECT DISTINCT article_id, claim_id, {'doc_id': unit_id.doc_id, 'chunk_id': unit_id.chunk_id} AS chunk, true AS p FROM prop_top)
    FULL JOIN (SELECT article_id, claim_id, unit_id AS chunk, true AS c FROM chunk_top) USING (article_id, claim_id, chunk)
    GROUP BY ALL""", "prop_top", "chunk_top"))
def a07_retrieval_comparison(spark, sf):
    by_prop = overlap_top(spark, sf, prop_units(spark, sf)).withColumn(
        "chunk", F.struct("doc_id.doc_id", "doc_id.chunk_id"))
    by_chunk = overlap_top(spark, sf, chunk_units(spark, sf)).withColumnRenamed("doc_id", "chunk")
    return retrieval.compare(by_prop, by_chunk, CLAIM, "chunk")


cte("doc_units", "SELECT doc_id, text AS unit FROM sources", "sources")
cte("doc_overlap", overlap_sql("doc_units", "doc_id", 10), "claims", "doc_units")
RRF = """SELECT article_id, claim_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + a.search_rank), 0) + coalesce(1.0::DOUBLE / (60 + b.search_rank), 0), 6)
      AS fused FROM hits a FULL JOIN doc_overlap b USING (article_id, claim_id, doc_id)"""


@query("n01_sparse_scores", with_ctes("SELECT article_id, claim_id, url, score FROM hits", "hits"))
def n01_sparse_scores(spark, sf):
    return tb.hits(spark, sf).select(*CLAIM, "url", "score")


@query("n02_fused_ranking", with_ctes(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id
      ORDER BY fused DESC, doc_id) AS fused_rank FROM ({RRF})) WHERE fused_rank <= 10""", "hits", "doc_overlap"))
def n02_fused_ranking(spark, sf):
    index = tb.corpus_index(spark, sf)
    ours = tb.claims(spark, sf)
    sparse = search.top_k_search(index, ours, CLAIM, "claim")
    overlap = search.top_k_search(index, ours, CLAIM, "claim", scheme="overlap")
    return retrieval.reciprocal_rank_fusion(sparse, overlap, CLAIM, "doc_id", k=10)


@query("n03_reranked", with_ctes("""
    SELECT *, row_number() OVER (PARTITION BY article_id, claim_id ORDER BY best_dist, search_rank) AS new_rank FROM (
      SELECT article_id, claim_id, search_rank, doc_id, min(dist) AS best_dist FROM pairs GROUP BY ALL)""", "pairs"))
def n03_reranked(spark, sf):
    return retrieval.rerank(tb.pairs(spark, sf), CLAIM)


cte("expansion", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id ORDER BY weight DESC, term) AS r
      FROM (SELECT article_id, claim_id, term, round(sum(tf * ln(n / df)), 6) AS weight FROM hits
        JOIN (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM postings) p USING (doc_id) CROSS JOIN corpus
        WHERE search_rank <= 3 AND df <= 0.2 * n GROUP BY article_id, claim_id, term) WHERE (article_id, claim_id, term) NOT IN
        (SELECT article_id, claim_id, unnest({toks('claim')}) FROM claims)) WHERE r <= 5""",
    "hits", "postings", "corpus", "claims")
cte("expanded_claims", """SELECT c.article_id, c.claim_id, claim || coalesce(' ' || extra, '') AS claim FROM claims c LEFT JOIN (
      SELECT article_id, claim_id, string_agg(term, ' ' ORDER BY r) AS extra FROM expansion GROUP BY ALL) e
      USING (article_id, claim_id)""", "claims", "expansion")


@query("n04_expanded_search", with_ctes(
    bm25("expanded_claims", "article_id, claim_id", "claim"), "expanded_claims", "postings", "corpus"))
def n04_expanded_search(spark, sf):
    index = tb.corpus_index(spark, sf)
    ours = tb.claims(spark, sf)
    found = stage(search.top_k_search(index, ours, CLAIM, "claim"), "first-round")
    return search.top_k_search(index, retrieval.expand(index, ours, found, CLAIM), CLAIM, "claim")


def _entities(x):
    return (f"list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, '^[^ ]+', ''), "
            f"'{sg.ENTITY_SPAN}', 1), lambda e: lower(e)))")


@query("n05_entity_filtered", with_ctes(f"""
    SELECT article_id, claim_id, doc_id, search_rank FROM hits h WHERE EXISTS (
      SELECT 1 FROM (SELECT article_id, claim_id, unnest({_entities('claim')}) AS e FROM claims) c
      JOIN (SELECT doc_id, unnest({_entities('source_claim')}) AS e FROM source_claims) s ON c.e = s.e
      WHERE c.article_id = h.article_id AND c.claim_id = h.claim_id AND s.doc_id = h.doc_id)""",
    "hits", "claims", "source_claims"))
def n05_entity_filtered(spark, sf):
    found = tb.hits(spark, sf)
    docs = tb.sources(spark, sf).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return retrieval.entity_filter(found, tb.claims(spark, sf), docs, CLAIM).select(*CLAIM, "doc_id", "search_rank")


# claims that name something: the sentences of the documents with a capitalised span inside
cte("naming", f"""SELECT doc_id AS article_id, source_claim_id AS claim_id, source_claim AS claim FROM source_claims
    WHERE len({_entities('source_claim')}) > 0""", "source_claims")
cte("naming_hits", bm25("naming", "article_id, claim_id", "claim"), "naming", "postings", "corpus")


@query("n05_entity_claims", with_ctes(f"""
    SELECT article_id, claim_id, doc_id, search_rank FROM naming_hits h WHERE EXISTS (
      SELECT 1 FROM (SELECT article_id, claim_id, unnest({_entities('claim')}) AS e FROM naming) c
      JOIN (SELECT doc_id, unnest({_entities('source_claim')}) AS e FROM source_claims) s ON c.e = s.e
      WHERE c.article_id = h.article_id AND c.claim_id = h.claim_id AND s.doc_id = h.doc_id)""", "naming", "naming_hits", "source_claims"))
def n05_entity_claims(spark, sf):
    """The documents' own sentences that name something, and the hits that name the same."""
    docs = tb.sources(spark, sf)
    said = evidence.source_claims(docs, ["doc_id"]).filter(F.size(sg.entities(F.col("source_claim"))) > 0)
    naming = stage(said.select(F.col("doc_id").alias("article_id"), F.col("source_claim_id").alias("claim_id"), F.col("source_claim").alias("claim")), "naming")
    found = stage(search.top_k_search(tb.corpus_index(spark, sf), naming, CLAIM, "claim"), "hits")
    wanted = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return retrieval.entity_filter(found, naming, wanted, CLAIM).select(*CLAIM, "doc_id", "search_rank")
