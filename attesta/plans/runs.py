"""Queries over whole runs, the claim store and the incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.config import VerifyConfig
from attesta.flows import verify
from attesta.operators import retrieval
from attesta.operators.staging import stage, stage_path
from attesta.plans import tables as tb
from attesta.plans import claims as claims_plan
from attesta.plans import web
from attesta.plans.nearest import chunk_units, overlap_sql, overlap_top
from attesta.plans.registry import query
from attesta.plans.replies import grade_replies
from attesta.plans.sqlkit import cte, exploded, sents, toks, with_ctes
from attesta.plans.verify import VERDICT_COLS, source_sites, title_hits
from attesta.operators import requests as rq
from attesta.sources import claim_store as cs
from attesta.sources import pages as pg
from attesta.streaming import incremental as inc

CLAIM = tb.CLAIM

# ---- whole runs ------------------------------------------------------------------------

cte("first_reliable", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id
      ORDER BY search_rank, dist_rank) AS rn FROM pairs WHERE relation <> 'neutral' AND
      regexp_extract(url, '^https://([^.]+)[.]', 1) IN (SELECT source FROM good_sources)) WHERE rn = 1""",
    "pairs", "good_sources")


@query("e1_reliable_verdicts", with_ctes("""
    SELECT c.article_id, c.claim_id, c.claim, CASE relation WHEN 'entailment' THEN 'supported'
      WHEN 'contradiction' THEN 'contradicted' ELSE 'unverified' END AS verdict, f.url AS source_url, f.source_claim,
      f.search_rank, f.dist_rank FROM claims c LEFT JOIN first_reliable f USING (article_id, claim_id)
    WHERE len(list_filter(regexp_split_to_array(lower(c.claim), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) > 0""",
    "claims", "first_reliable"))
def e1_reliable_verdicts(spark, sf):
    """The current flow with chunked articles and the reliability filter after the search cut."""
    config = VerifyConfig(split_chunks=True, require_reliable=True)
    run = verify(tb.articles(spark, sf), tb.sources(spark, sf), config, sites=source_sites(spark, sf))
    return run.verdicts.select(*VERDICT_COLS)


cte("first_by_vector", f"""SELECT * FROM (SELECT p.*, s.source_claim, s.url, row_number() OVER (PARTITION BY article_id, claim_id ORDER BY search_rank, dist_rank) AS rn
      FROM vector_pairs p JOIN (SELECT article_id, claim_id, doc_id, source_claim_id, relation FROM pairs_all) r
        USING (article_id, claim_id, doc_id, source_claim_id) JOIN source_claims s USING (doc_id, source_claim_id)
      WHERE relation <> 'neutral') JOIN (SELECT article_id, claim_id, doc_id, source_claim_id, relation FROM pairs_all)
      USING (article_id, claim_id, doc_id, source_claim_id) WHERE rn = 1""", "vector_pairs", "pairs_all", "source_claims")
DECIDED_BY = """SELECT c.article_id, c.claim_id, CASE relation WHEN 'entailment' THEN 'supported'
      WHEN 'contradiction' THEN 'contradicted' ELSE 'unverified' END AS verdict, f.url AS source_url, f.source_claim,
      f.search_rank, f.dist_rank FROM ({claims}) c LEFT JOIN {first} f USING (article_id, claim_id)
    WHERE len(list_filter(regexp_split_to_array(lower(c.claim), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) > 0"""
RUN_COLS = ["article_id", "claim_id", "verdict", "source_url", "source_claim", "search_rank", "dist_rank"]


@query("e1_encoded_verdicts", with_ctes(DECIDED_BY.format(claims="SELECT * FROM claims", first="first_by_vector"), "claims", "first_by_vector"))
def e1_encoded_verdicts(spark, sf):
    """The whole run with source claims ranked by hashed vectors."""
    run = verify(tb.articles(spark, sf), tb.sources(spark, sf), VerifyConfig(encoder="hashed"), index=tb.corpus_index(spark, sf))
    return run.verdicts.select(RUN_COLS)


cte("given_hits", """SELECT article_id, claim_id, search_rank, doc_id, url FROM hits WHERE search_rank % 2 = 0
    UNION ALL SELECT article_id, claim_id, 1, NULL, 'https://elsewhere.example.org/' || claim_id FROM claims""", "hits", "claims")
cte("first_given", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id
      ORDER BY search_rank, dist_rank) AS rn FROM pairs WHERE relation <> 'neutral' AND search_rank % 2 = 0) WHERE rn = 1""", "pairs")


@query("e1_given_hits", with_ctes(DECIDED_BY.format(claims="SELECT * FROM claims", first="first_given"), "claims", "first_given"))
def e1_given_hits(spark, sf):
    """Hits of another search drive the run: every second one of ours, behind an address that is no source."""
    ours = tb.claims(spark, sf)
    theirs = ours.select(*CLAIM, F.lit(1).alias("search_rank"), F.concat(F.lit("https://elsewhere.example.org/"), "claim_id").alias("url"))
    given = tb.hits(spark, sf).filter("search_rank % 2 = 0").select(*CLAIM, "search_rank", "url").unionByName(theirs)
    return verify(tb.articles(spark, sf), tb.sources(spark, sf), hits=given).verdicts.select(RUN_COLS)


cte("first_of_four", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id ORDER BY search_rank, source_claim_id) AS rn
      FROM pairs_all WHERE relation <> 'neutral' AND search_rank <= 4) WHERE rn = 1""", "pairs_all")


@query("m10_other_options", with_ctes("""SELECT article_id, claim_id, CASE relation WHEN 'entailment' THEN 'supported'
      WHEN 'contradiction' THEN 'contradicted' ELSE 'unverified' END AS verdict, f.url AS source_url, f.source_claim, f.search_rank
    FROM claims c LEFT JOIN first_of_four f USING (article_id, claim_id) WHERE len(list_filter(regexp_split_to_array(
      lower(claim), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) > 2""", "claims", "first_of_four"))
def m10_other_options(spark, sf):
    """A run with other options: four hits, every source claim in order, short claims left out, waves of one rank, small tiles."""
    config = VerifyConfig(search_results=4, embed_source_claims=False, min_claim_tokens=3, wave_ranks=(1, 2), wave_least_hits=0, tile_rows=16, hot_key_rows=50)
    run = verify(tb.articles(spark, sf), tb.sources(spark, sf), config, index=tb.corpus_index(spark, sf))
    return run.verdicts.select([c for c in RUN_COLS if c != "dist_rank"])


cte("claim_labels", "SELECT article_id, claim_id, claim, " + claims_plan.LABEL.replace("sentence", "claim")
    + " AS label FROM (SELECT *, " + toks("claim") + " AS t FROM claims)", "claims")
cte("source_labels", "SELECT doc_id, source_claim_id, " + claims_plan.LABEL.replace("sentence", "source_claim")
    + " AS label FROM (SELECT *, " + toks("source_claim") + " AS t FROM source_claims)", "source_claims")
cte("first_checkworthy", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id ORDER BY search_rank, dist_rank) AS rn
      FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id, doc_id ORDER BY dist, source_claim_id) AS dist_rank
        FROM pairs_all JOIN source_labels USING (doc_id, source_claim_id) WHERE label = 'checkworthy')
      WHERE dist_rank <= 5 AND relation <> 'neutral') WHERE rn = 1""", "pairs_all", "source_labels")


@query("e1_source_extraction", with_ctes(DECIDED_BY.format(
    claims="SELECT * FROM claim_labels WHERE label = 'checkworthy'", first="first_checkworthy"), "claim_labels", "first_checkworthy"))
def e1_source_extraction(spark, sf):
    """Sources go through the chain that makes an article's claims, here with the falsifiability filter."""
    config = VerifyConfig(extract_sources=True, check_falsifiability=True)
    return verify(tb.articles(spark, sf), tb.sources(spark, sf), config, index=tb.corpus_index(spark, sf)).verdicts.select(RUN_COLS)


@query("e1_stored_sources", with_ctes("""SELECT article_id, claim_id, verdict, source_url, source_claim, search_rank, dist_rank, 0 AS added FROM decided
    WHERE len(list_filter(regexp_split_to_array(lower(claim), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) > 0""", "decided"))
def e1_stored_sources(spark, sf):
    """A second run over the same sources reads their claims from the store and adds none (``added``)."""
    store, index = stage_path(spark, "store"), tb.corpus_index(spark, sf)
    articles, docs = tb.articles(spark, sf), tb.sources(spark, sf)
    verify(articles, docs, index=index, store=store)
    cs.compact(spark, store)
    before = cs.last_commit(spark, store)
    again = verify(articles, docs, index=index, store=store)
    return again.verdicts.select(*RUN_COLS, F.lit(cs.last_commit(spark, store) - before).cast("int").alias("added"))


cte("passed_units", "SELECT {'doc_id': doc_id, 'chunk_id': chunk_id, 'pos': pos} AS unit_id, proposition AS unit FROM grades "
    "WHERE passed", "grades")
cte("passed_top", overlap_sql("passed_units", "unit_id", 4), "claims", "passed_units")


@query("e3_gated_retrieval", with_ctes("""
    SELECT article_id, claim_id, count(p) AS n_by_proposition, count(c) AS n_by_chunk, count(*) FILTER (WHERE p AND c) AS common,
      round(count(*) FILTER (WHERE p AND c) / count(*), 6) AS jaccard FROM (
      SELECT DISTINCT article_id, claim_id, {'doc_id': unit_id.doc_id, 'chunk_id': unit_id.chunk_id} AS chunk, true AS p FROM passed_top)
    FULL JOIN (SELECT article_id, claim_id, unit_id AS chunk, true AS c FROM chunk_top) USING (article_id, claim_id, chunk)
    GROUP BY ALL""", "passed_top", "chunk_top"))
def e3_gated_retrieval(spark, sf):
    """Word windows, propositions, the grade gate, and both retrievals compared."""
    passed = rq.graded(grade_replies(spark, sf)).filter("passed").select(
        F.struct("doc_id", "chunk_id", "pos").alias("unit_id"),
        F.col("proposition").alias("unit"))
    by_prop = overlap_top(spark, sf, passed).withColumn("chunk", F.struct("doc_id.doc_id", F.col("doc_id.chunk_id").cast("int").alias("chunk_id")))
    by_chunk = overlap_top(spark, sf, chunk_units(spark, sf)).withColumnRenamed("doc_id", "chunk")
    return retrieval.compare(by_prop, by_chunk, CLAIM, "chunk")


# ---- claim store -----------------------------------------------------------------------

cte("page_claims", exploded(sents("text"), "url", "page_main", "claim", "claim_id"), "page_main")
STORE_SQL = with_ctes("SELECT domain, url, claim_id, claim FROM page_claims JOIN page_domains USING (url)",
                      "page_claims", "page_domains")
STORE_COLS = ["domain", "url", "claim_id", "claim"]


def store_pages(spark, sf, path, rows, batch=0):
    content = pg.main_content(rows)
    cs.append(cs.claims_of(content, web.page_domains(spark, sf)), path, batch)


@query("s12_claim_store", STORE_SQL)
def s12_claim_store(spark, sf):
    path = stage_path(spark, "store")
    store_pages(spark, sf, path, web.pages(spark, sf))
    return cs.load_domains(spark, path, web.page_domains(spark, sf)).select(*STORE_COLS)


cte("secure_claims", "SELECT DISTINCT url FROM page_claims WHERE starts_with(url, 'https://')", "page_claims")


@query("j06_missing_sources", with_ctes(
    "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM secure_claims)", "secure_claims"))
def j06_missing_sources(spark, sf):
    """Store the pages served over https, then ask which pages are still to do."""
    path = stage_path(spark, "store")
    content = pg.main_content(web.pages(spark, sf)).filter(F.col("url").startswith("https://"))
    cs.append(cs.claims_of(content, web.page_domains(spark, sf)), path)
    return cs.missing(tb.table(spark, sf, "pages").select("page_id", "url"), cs.load(spark, path))


@query("j07_first_page_per_domain", with_ctes("""
    SELECT article_id, claim_id, search_rank, url, domain, first_value(url) OVER (PARTITION BY domain
      ORDER BY search_rank, url) AS origin_url FROM title_hits JOIN page_domains USING (url)""",
    "title_hits", "page_domains"))
def j07_first_page_per_domain(spark, sf):
    found = stage(title_hits(spark, sf).join(web.page_domains(spark, sf), "url"), "title-hits")
    return cs.by_domain(found).select(*CLAIM, "search_rank", "url", "domain", "origin_url")


# ---- streams ---------------------------------------------------------------------------

@query("x01_streamed_verdicts", with_ctes(
    "SELECT article_id, claim_id, claim, verdict, source_url, source_claim FROM decided", "decided"))
def x01_streamed_verdicts(spark, sf):
    """Articles arrive in several files; the collected verdicts equal the batch run."""
    incoming, sink = stage_path(spark, "articles"), stage_path(spark, "verdicts")
    arts = tb.articles(spark, sf)
    arts.repartition("article_id").write.parquet(incoming)
    docs = tb.sources(spark, sf)
    running = inc.verify_stream(spark, incoming, arts.schema, docs, tb.corpus_index(spark, sf), sink,
                                stage_path(spark, "offsets"), files_per_batch=2)
    running.awaitTermination()
    return spark.read.parquet(sink).drop("run", "batch")


@query("x02_streamed_store", STORE_SQL)
def x02_streamed_store(spark, sf):
    """Pages arrive with repeats, some within the lateness bound, some long after."""
    incoming, store = stage_path(spark, "arrivals"), stage_path(spark, "store")
    minute = F.col("page_id").cast("int")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def at(offset):
        return (base + F.make_interval(mins=offset)).alias("arrived_at")

    pages = tb.table(spark, sf, "pages").select("page_id", "url", "html")
    first = pages.select("*", at(minute))
    soon = pages.filter(F.length("url") % 2 == 0).select("*", at(minute + 5))
    late = pages.filter(F.length("url") % 3 == 0).select("*", at(minute + 100000))
    first.unionByName(soon).write.parquet(incoming)
    in_time = len(spark.read.parquet(incoming).inputFiles())
    late.write.mode("append").parquet(incoming)
    repeated = stage(pg.boilerplate(pg.page_blocks(pages)), "boilerplate")
    inc.store_stream(spark, incoming, first.schema, web.suffix_rules(spark, sf), store,
                     stage_path(spark, "offsets"), repeated, files_per_batch=in_time).awaitTermination()
    return cs.load(spark, store).select(*STORE_COLS)
