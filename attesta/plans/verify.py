"""Search, evidence and verdict queries over benchmark claims and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import dense, evidence, search, verdict
from attesta.operators import sites as st
from attesta.operators.staging import spread, stage
from attesta.plans import tables as tb
from attesta.plans.registry import query
from attesta.plans.sqlkit import bm25, cte, toks, with_ctes
from attesta.sources import pages as pg
from attesta.sources import sites as sl

CLAIM = tb.CLAIM
VERDICT_COLS = ["article_id", "claim_id", "claim", "verdict", "source_url", "source_claim",
                "search_rank", "dist_rank"]

cte("good_sources", """SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source
      HAVING sum(quality) * 20 >= count(*) * 17""")
cte("hits_marked", """SELECT h.*, regexp_extract(url, '^https://([^.]+)[.]', 1) IN (SELECT source FROM good_sources)
      AS reliable FROM hits h""", "hits", "good_sources")
cte("first_any", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id
      ORDER BY search_rank, source_claim_id) AS rn FROM pairs_all WHERE relation <> 'neutral') WHERE rn = 1""",
    "pairs_all")
cte("looked_at", """SELECT p.article_id, p.claim_id, count(*) FILTER (WHERE f.search_rank IS NULL
        OR (p.search_rank, p.source_claim_id) <= (f.search_rank, f.source_claim_id)) AS pairs_inspected
      FROM pairs_all p LEFT JOIN first_any f USING (article_id, claim_id) GROUP BY ALL""", "pairs_all", "first_any")


def source_sites(spark, sf):
    return sl.reliable_sites(tb.source_site_patterns(spark, sf))


# ---- search ---------------------------------------------------------------------

@query("m09_corpus_search", with_ctes("SELECT article_id, claim_id, search_rank, doc_id, score FROM hits", "hits"))
def m09_corpus_search(spark, sf):
    return search.top_k_search(tb.corpus_index(spark, sf), tb.claims(spark, sf), CLAIM, "claim")


@query("m09_scored_share")
def m09_scored_share(spark, sf):
    """How many (query, document) pairs the search scores of those that exist; copies and equal queries count once."""
    index = tb.corpus_index(spark, sf)
    asked = search.identified(tb.claims(spark, sf), CLAIM, "claim")
    pairs = search.scored_pairs(index, asked, 10)
    queries = asked.select(*search.QID).distinct().count()
    return pairs.agg(F.count(F.lit(1)).alias("scored")).select(
        F.lit(queries).cast("long").alias("queries"), F.lit(index.n_groups).cast("long").alias("documents"), "scored",
        F.round(F.col("scored") / max(1, queries * index.n_groups), 6).alias("share"))


@query("k03_reliable_hits", with_ctes(
    "SELECT article_id, claim_id, search_rank, url FROM hits_marked WHERE reliable", "hits_marked"))
def k03_reliable_hits(spark, sf):
    return st.top_then_reliable(tb.hits(spark, sf), source_sites(spark, sf)).select(*CLAIM, "search_rank", "url")


@query("j02_reliability_flags", with_ctes(
    "SELECT article_id, claim_id, search_rank, url, reliable, "
    "count(*) FILTER (WHERE reliable) OVER (PARTITION BY article_id, claim_id) AS n_reliable FROM hits_marked",
    "hits_marked"))
def j02_reliability_flags(spark, sf):
    return st.reliability_flags(tb.hits(spark, sf), source_sites(spark, sf)).select(
        *CLAIM, "search_rank", "url", "reliable", "n_reliable")


# ---- hits on the page's own corpus ------------------------------------------------

cte("title_claims", "SELECT page_id AS article_id, 0 AS claim_id, url AS claim_url, title AS claim FROM page_titled",
    "page_titled")
cte("page_postings", f"""SELECT page_id, dl, term, count(*) AS tf FROM (SELECT page_id, len(_t) AS dl, unnest(_t) AS term
      FROM (SELECT page_id, {toks('text')} AS _t FROM page_main)) GROUP BY ALL""", "page_main")
cte("page_corpus", f"SELECT count(*) AS n, avg(len({toks('text')})) AS avgdl FROM page_main", "page_main")
cte("title_hits", "SELECT h.*, c.claim_url, m.url FROM (" + bm25(
    "title_claims", "article_id, claim_id", "claim", "page_postings", "page_corpus", "page_id") + ") h "
    "JOIN title_claims c USING (article_id, claim_id) JOIN page_main m USING (page_id)",
    "title_claims", "page_postings", "page_corpus", "page_main")


def title_hits(spark, sf):
    """Page titles as claims, searched in the text of all pages."""
    raw = spread(tb.table(spark, sf, "pages"), "page_id")
    content = stage(pg.main_content(raw), "content")
    titles = content.select(F.col("page_id").alias("article_id"), F.lit(0).alias("claim_id"),
                            F.col("url").alias("claim_url"), F.col("title").alias("claim"))
    index = search.build_index(content, doc_id="page_id")
    found = search.top_k_search(index, titles, CLAIM, "claim")
    return (found.join(content.select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
            .join(titles.select(*CLAIM, "claim_url"), CLAIM))


@query("p05_without_own_page", with_ctes(
    "SELECT article_id, claim_id, search_rank, url FROM title_hits WHERE url <> claim_url", "title_hits"))
def p05_without_own_page(spark, sf):
    return title_hits(spark, sf).filter("url <> claim_url").select(*CLAIM, "search_rank", "url")


@query("u03_sources_minus_own", with_ctes(
    "SELECT article_id, claim_id, coalesce(string_agg(url, ' ' ORDER BY url) FILTER (WHERE url <> claim_url), '') AS urls "
    "FROM title_hits GROUP BY article_id, claim_id", "title_hits"))
def u03_sources_minus_own(spark, sf):
    found = title_hits(spark, sf).groupBy(*CLAIM, "claim_url").agg(F.collect_list("url").alias("urls"))
    return found.select(*CLAIM, F.array_join(
        F.array_sort(F.array_except("urls", F.array("claim_url"))), " ").alias("urls"))


# ---- evidence ---------------------------------------------------------------------

@query("j03_hit_source_claims", with_ctes(
    "SELECT h.article_id, h.claim_id, h.search_rank, h.url, count(s.doc_id) AS n_source_claims "
    "FROM hits h JOIN source_claims s USING (doc_id) GROUP BY ALL", "hits", "source_claims"))
def j03_hit_source_claims(spark, sf):
    found = tb.hits(spark, sf)
    wanted = tb.sources(spark, sf).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    tiles = evidence.source_tiles(wanted, "doc_id").select("doc_id", F.size("rows").alias("n"))
    sizes = tiles.groupBy("doc_id").agg(F.sum("n").alias("n_source_claims"))
    return found.join(sizes, "doc_id").select(*CLAIM, "search_rank", "url", "n_source_claims")


PAIR_COLS = "article_id, claim_id, search_rank, doc_id, source_claim_id, dist, dist_rank"


@query("j04_nearest_in_source", with_ctes(f"SELECT {PAIR_COLS} FROM pairs", "pairs"))
def j04_nearest_in_source(spark, sf):
    return tb.pairs(spark, sf).select(*PAIR_COLS.split(", "))


@query("m05_pair_relations", with_ctes(
    "SELECT article_id, claim_id, doc_id, source_claim_id, relation FROM pairs", "pairs"))
def m05_pair_relations(spark, sf):
    return tb.pairs(spark, sf).select(*CLAIM, "doc_id", "source_claim_id", "relation")


@query("p10_decisive_pairs", with_ctes(
    "SELECT article_id, claim_id, doc_id, source_claim_id, relation FROM pairs WHERE relation <> 'neutral'", "pairs"))
def p10_decisive_pairs(spark, sf):
    return tb.pairs(spark, sf).filter("relation <> 'neutral'").select(
        *CLAIM, "doc_id", "source_claim_id", "relation")


@query("j05_all_compared", with_ctes(
    "SELECT article_id, claim_id, search_rank, doc_id, count(*) AS compared, min(source_claim_id) "
    "FILTER (WHERE relation <> 'neutral') AS first_decisive FROM pairs_all GROUP BY ALL", "pairs_all"))
def j05_all_compared(spark, sf):
    tiles = evidence.exhaustive(tb.hits(spark, sf), tb.claims(spark, sf), tb.sources(spark, sf))
    return tiles.groupBy(*CLAIM, "search_rank", "doc_id").agg(
        F.sum("n").alias("compared"), F.min("at").alias("first_decisive"))


FIRST = "article_id, claim_id, search_rank, dist_rank, doc_id, source_claim_id, relation"


@query("k04_first_by_distance", with_ctes(f"SELECT {FIRST} FROM first_hit", "first_hit"))
def k04_first_by_distance(spark, sf):
    return evidence.first_decisive(
        tb.pairs(spark, sf), ["search_rank", "dist_rank"],
        ["search_rank", "dist_rank", "doc_id", "source_claim_id", "relation"])


@query("k05_first_in_order", with_ctes(
    "SELECT article_id, claim_id, search_rank, doc_id, source_claim_id, relation FROM first_any", "first_any"))
def k05_first_in_order(spark, sf):
    return _in_order(spark, sf)[0]


def _in_order(spark, sf, **options):
    claims, sources = tb.claims(spark, sf), tb.sources(spark, sf)

    def compare(some):
        tiles = evidence.exhaustive(some, claims, sources)
        return tiles.filter("at IS NOT NULL").withColumnRenamed("at", "source_claim_id")
    return evidence.in_waves(tb.hits(spark, sf), compare, ["search_rank", "source_claim_id"],
                             ["search_rank", "source_claim_id", "doc_id", "relation"], **options)


@query("k05_hits_by_wave", with_ctes("""
    SELECT CASE WHEN h.search_rank <= 3 THEN 1 ELSE 2 END AS wave, count(*) AS hits FROM hits h
    LEFT JOIN first_any f USING (article_id, claim_id)
    WHERE h.search_rank <= 3 OR f.search_rank IS NULL OR f.search_rank > 3 GROUP BY 1""", "hits", "first_any"))
def k05_hits_by_wave(spark, sf):
    """Hits compared in each wave: the second has only claims that the first left open."""
    return _in_order(spark, sf, least_hits=0)[1].filter("hits > 0")


# the numbers below follow hashed vectors: token counts in 64 buckets, of unit length
cte("said", f"""SELECT 'c' AS side, article_id, claim_id, NULL AS doc_id, NULL AS source_claim_id, {toks('claim')} AS t FROM claims
    UNION ALL SELECT 's', NULL, NULL, doc_id, source_claim_id, {toks('source_claim')} FROM source_claims""", "claims", "source_claims")
cte("hashed", """SELECT side, article_id, claim_id, doc_id, source_claim_id, bucket, tf / sqrt(sum(tf * tf) OVER (
      PARTITION BY side, article_id, claim_id, doc_id, source_claim_id)::DOUBLE) AS v FROM (
      SELECT side, article_id, claim_id, doc_id, source_claim_id, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS bucket, count(*) AS tf
      FROM (SELECT *, unnest(t) AS w FROM said) GROUP BY ALL)""", "said")
cte("vector_pairs", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id, doc_id ORDER BY dist, source_claim_id) AS dist_rank
      FROM (SELECT h.article_id, h.claim_id, h.search_rank, h.doc_id, s.source_claim_id,
        round((CASE WHEN len(c.t) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(s.t) > 0 THEN 1 ELSE 0 END) - 2 * coalesce(dot, 0), 6) + 0.0::DOUBLE AS dist
        FROM hits h JOIN said c ON c.side = 'c' AND c.article_id = h.article_id AND c.claim_id = h.claim_id
        JOIN said s ON s.side = 's' AND s.doc_id = h.doc_id
        LEFT JOIN (SELECT h.article_id, h.claim_id, h.doc_id, b.source_claim_id, sum(a.v * b.v) AS dot FROM hits h
          JOIN hashed a ON a.side = 'c' AND a.article_id = h.article_id AND a.claim_id = h.claim_id
          JOIN hashed b ON b.side = 's' AND b.doc_id = h.doc_id AND b.bucket = a.bucket GROUP BY ALL) d
        ON d.article_id = h.article_id AND d.claim_id = h.claim_id AND d.doc_id = h.doc_id AND d.source_claim_id = s.source_claim_id))
      WHERE dist_rank <= 5""", "hits", "said", "hashed")


@query("j04_nearest_by_vector", with_ctes(
    "SELECT article_id, claim_id, search_rank, doc_id, source_claim_id, dist, dist_rank FROM vector_pairs", "vector_pairs"))
def j04_nearest_by_vector(spark, sf):
    """The closest source claims of each hit by hashed vectors."""
    said = evidence.source_claims(tb.sources(spark, sf), ["doc_id"])
    return dense.nearest(tb.hits(spark, sf), tb.claims(spark, sf), said)


# ---- verdicts and reports ----------------------------------------------------------

@query("a03_verdicts", with_ctes(f"SELECT {', '.join(VERDICT_COLS)} FROM decided", "decided"))
def a03_verdicts(spark, sf):
    return tb.decided(spark, sf).select(*VERDICT_COLS)


@query("a01_claims_per_article", with_ctes(
    "SELECT 'article' AS kind, url, count(*) AS n_claims FROM claims GROUP BY url UNION ALL "
    "SELECT 'source', url, count(*) FROM source_claims GROUP BY url", "claims", "source_claims"))
def a01_claims_per_article(spark, sf):
    ours = tb.claims(spark, sf).groupBy("url").agg(F.count(F.lit(1)).alias("n_claims"))
    theirs = evidence.source_claims(tb.sources(spark, sf), ["url"]).groupBy("url").agg(
        F.count(F.lit(1)).alias("n_claims"))
    return ours.select(F.lit("article").alias("kind"), "url", "n_claims").unionByName(
        theirs.select(F.lit("source").alias("kind"), "url", "n_claims"))


@query("a02_sources_used", with_ctes("SELECT DISTINCT article_id, url FROM hits", "hits"))
def a02_sources_used(spark, sf):
    return verdict.sources_used(tb.hits(spark, sf))


@query("u01_source_union", with_ctes(
    "SELECT url, count(DISTINCT article_id) AS n_articles, count(*) AS n_hits FROM hits GROUP BY url", "hits"))
def u01_source_union(spark, sf):
    per_article = tb.hits(spark, sf).groupBy("url", "article_id").agg(F.count(F.lit(1)).alias("n"))
    return per_article.groupBy("url").agg(F.count(F.lit(1)).alias("n_articles"), F.sum("n").alias("n_hits"))


@query("u02_unverified_claims", with_ctes(
    "SELECT article_id, claim_id, claim FROM decided WHERE verdict = 'unverified'", "decided"))
def u02_unverified_claims(spark, sf):
    return verdict.unverified(tb.claims(spark, sf), tb.pairs(spark, sf)).select(*CLAIM, "claim")


REPORT_SQL = """SELECT d.*, coalesce(n_sources, 0) AS n_sources, coalesce(n_sources, 0) > 0 AS has_sources,
      n_unverified = 0 AS no_unverified, n_supported = n_claims AS all_supported
      FROM (SELECT article_id, count(*) AS n_claims, count(*) FILTER (WHERE verdict = 'supported') AS n_supported,
        count(*) FILTER (WHERE verdict = 'contradicted') AS n_contradicted,
        count(*) FILTER (WHERE verdict = 'unverified') AS n_unverified FROM {decided} GROUP BY article_id) d
      LEFT JOIN (SELECT article_id, count(DISTINCT url) AS n_sources FROM hits GROUP BY article_id) s USING (article_id)"""


@query("a03_article_rollup", with_ctes(
    "SELECT article_id, n_claims, n_supported, n_contradicted, n_unverified FROM ("
    + REPORT_SQL.format(decided="decided") + ")", "decided", "hits"))
def a03_article_rollup(spark, sf):
    found = tb.hits(spark, sf)
    report = verdict.article_report(tb.decided(spark, sf, found), verdict.sources_used(found))
    return report.select("article_id", "n_claims", "n_supported", "n_contradicted", "n_unverified")


@query("a04_article_report", with_ctes(REPORT_SQL.format(decided="decided"), "decided", "hits"))
def a04_article_report(spark, sf):
    found = tb.hits(spark, sf)
    return verdict.article_report(tb.decided(spark, sf, found), verdict.sources_used(found))


@query("a04_findings", with_ctes("""
    SELECT article_id, '1 claim' AS section, claim_id::VARCHAR AS position, claim AS content,
      NULL::VARCHAR AS source_url, NULL::VARCHAR AS source_claim FROM decided
    UNION ALL SELECT DISTINCT article_id, '2 source', url, url, NULL, NULL FROM hits
    UNION ALL SELECT article_id, CASE verdict WHEN 'contradicted' THEN '3 contradiction' ELSE '4 unverified' END,
      claim_id::VARCHAR, claim, source_url, source_claim FROM decided
      WHERE verdict <> 'supported' AND article_id IN (SELECT article_id FROM hits)""", "decided", "hits"))
def a04_findings(spark, sf):
    found = tb.hits(spark, sf)
    return verdict.findings(stage(tb.decided(spark, sf, found), "decided"), verdict.sources_used(found))


@query("a05_pairs_inspected", with_ctes("SELECT * FROM looked_at", "looked_at"))
def a05_pairs_inspected(spark, sf):
    tiles = evidence.exhaustive(tb.hits(spark, sf), tb.claims(spark, sf), tb.sources(spark, sf))
    return verdict.inspected(stage(tiles, "compared"))


cte("decided_any", """SELECT c.article_id, c.claim_id, CASE relation WHEN 'entailment' THEN 'supported'
        WHEN 'contradiction' THEN 'contradicted' ELSE 'unverified' END AS verdict
      FROM claims c LEFT JOIN first_any f USING (article_id, claim_id)""", "claims", "first_any")


@query("e2_sequential_report", with_ctes(
    "SELECT r.*, coalesce(i.pairs_inspected, 0) AS pairs_inspected FROM (" + REPORT_SQL.format(decided="decided_any")
    + ") r LEFT JOIN (SELECT article_id, sum(pairs_inspected)::BIGINT AS pairs_inspected FROM looked_at "
    "GROUP BY article_id) i USING (article_id)", "decided_any", "hits", "looked_at"))
def e2_sequential_report(spark, sf):
    """The older variant: every source claim in order, first decisive one wins, pairs counted."""
    found = tb.hits(spark, sf)
    tiles = stage(evidence.exhaustive(found, tb.claims(spark, sf), tb.sources(spark, sf)), "compared")
    decisive = tiles.filter("at IS NOT NULL").withColumnRenamed("at", "source_claim_id")
    first = evidence.first_decisive(decisive, ["search_rank", "source_claim_id"],
                                    ["search_rank", "source_claim_id", "doc_id", "relation"])
    report = verdict.article_report(verdict.verdicts(tb.claims(spark, sf), first), verdict.sources_used(found))
    looked = verdict.inspected(tiles).groupBy("article_id").agg(F.sum("pairs_inspected").alias("pairs_inspected"))
    return report.join(looked, "article_id", "left").withColumn(
        "pairs_inspected", F.coalesce("pairs_inspected", F.lit(0)))
