"""The whole run: articles and sources in, verdicts and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.config import VerifyConfig
from attesta.functions import text as tx
from attesta.functions import urls
from attesta.operators import context as cx
from attesta.operators import dense, evidence, quality, relation, search, verdict
from attesta.operators import segment as sg
from attesta.operators import sites as st
from attesta.operators.staging import stage
from attesta.sources import claim_store as cs

CLAIM = evidence.CLAIM


@dataclass(frozen=True)
class Verified:
    """Tables of one run; hits and the evidence behind the verdicts are already written."""

    claims: DataFrame
    hits: DataFrame
    verdicts: DataFrame

    def report(self) -> DataFrame:
        return verdict.article_report(self.verdicts, verdict.sources_used(self.hits))

    def findings(self) -> DataFrame:
        return verdict.findings(self.verdicts, verdict.sources_used(self.hits))


def extract_claims(articles: DataFrame, config: VerifyConfig) -> DataFrame:
    """``article_id, url, claim_id, claim`` (and chunk columns when chunking is on and claims stay as they are).

    One chain whatever makes the claims: chunk, extract, clean, rewrite, filter.
    """
    keys = ["article_id", "url"]
    if config.extractor is not None:
        chunked = sg.chunk_table(articles, keys, size=config.chunk_size, overlap=config.chunk_overlap)
        claims = sg.extracted_claims(chunked, keys, config.extractor)
    elif config.split_chunks:
        claims = sg.claims_with_chunks(articles, keys, size=config.chunk_size, overlap=config.chunk_overlap)
    else:
        claims = None
        arrays = articles.select(*keys, tx.sentences("text").alias("claims"))
    if claims is not None and (config.clean_prefixes or config.decontextualise):
        # both read an article's claims as one list; an article's list is bounded by its text
        listed = F.array_sort(F.collect_list(F.struct("claim_id", "claim")))
        arrays = claims.groupBy(*keys).agg(F.transform(listed, lambda c: c["claim"]).alias("claims"))
        claims = None
    if claims is None:
        if config.clean_prefixes:
            arrays = arrays.withColumn("claims", quality.clean_claims("claims"))
        if config.decontextualise:
            arrays = cx.rewrite_in_order(arrays, rewriter=config.rewriter, batch_rewriter=config.batch_rewriter).select(*keys, F.col("rewritten").alias("claims"))
        claims = arrays.select(*keys, F.posexplode("claims").alias("claim_id", "claim"))
    claims = claims.filter(F.size(tx.tokens("claim")) >= config.min_claim_tokens)
    claims = quality.falsifiable(claims, config.check_falsifiability)
    # A plugged model runs once; native claims are cheaper to make again than to write.
    plugged = any(m is not None for m in (config.extractor, config.rewriter, config.batch_rewriter))
    return stage(claims, "claims") if plugged else claims


def source_claims(sources: DataFrame, config: VerifyConfig, store: str | None = None) -> DataFrame:
    """``doc_id, source_claim_id, source_claim`` of ``sources(doc_id, url, text)``, written.

    With ``extract_sources`` they are made by the chain that makes an article's claims, else they are its sentences.
    With a ``store``, sources whose URL it holds are read from it and only the others are processed and added; of sources
    with one URL the one with the lowest id is processed.
    """
    def made(rows: DataFrame) -> DataFrame:
        if not config.extract_sources:
            return evidence.source_claims(rows, ["doc_id", "url"])
        claims = extract_claims(rows.select(F.col("doc_id").alias("article_id"), "url", "text"), config)
        return claims.select(F.col("article_id").alias("doc_id"), "url", F.col("claim_id").alias("source_claim_id"), F.col("claim").alias("source_claim"))

    columns = ["doc_id", "source_claim_id", "source_claim"]
    if store is None:
        return stage(made(sources).select(*columns), "source_claims")
    spark = sources.sparkSession
    held = stage(cs.of_urls(spark, store, sources).select("url", "claim_id", "claim"), "held")
    first = sources.groupBy("url").agg(F.min("doc_id").alias("doc_id"))
    todo = stage(sources.join(first, ["url", "doc_id"], "left_semi").join(held.select("url").distinct(), "url", "left_anti")
                 .select("doc_id", "url", "text"), "todo")
    if not todo.isEmpty():
        new = made(todo).select("doc_id", F.col("source_claim_id").alias("claim_id"), F.col("source_claim").alias("claim"))
        whole = todo.select("doc_id", "url").join(new, "doc_id", "left")        # a source without claims is remembered too
        cs.append(whole.select(urls.host("url").alias("domain"), "url", "claim_id", "claim"), store)
        held = cs.of_urls(spark, store, sources)
    found = held.filter("claim_id IS NOT NULL").join(sources.select("doc_id", "url"), "url")
    return stage(found.select("doc_id", F.col("claim_id").alias("source_claim_id"), F.col("claim").alias("source_claim")), "source_claims")


def verify(articles: DataFrame, sources: DataFrame, config: VerifyConfig = VerifyConfig(),
           sites: DataFrame | None = None, index: search.SearchIndex | None = None,
           hits: DataFrame | None = None, store: str | None = None) -> Verified:
    """Check ``articles(article_id, url, text)`` against ``sources(doc_id, url, text)``.

    Search results are cut at ``search_results`` before the reliability
    filter, and an article is never its own source. ``hits(article_id, claim_id, search_rank, url)`` from another search take
    the place of the own one; a URL that is no source is reported but has nothing to compare. ``store`` is a claim store (see
    ``source_claims``).
    """
    claims = extract_claims(articles, config)
    if hits is None:
        index = index or search.build_index(sources)
        found = search.top_k_search(index, claims, CLAIM, "claim", k=config.search_results, k1=config.bm25_k1,
                                    b=config.bm25_b, max_df_share=config.max_df_share)
        found = found.join(sources.select("doc_id", "url"), "doc_id")
    else:
        given = hits.filter(F.col("search_rank") <= config.search_results).join(claims.select(*CLAIM), CLAIM, "left_semi")
        known = sources.groupBy("url").agg(F.min("doc_id").alias("doc_id"))
        found = given.join(known, "url", "left").select(*CLAIM, "search_rank", "doc_id", "url")
    if config.require_reliable:
        if sites is None:
            raise ValueError("require_reliable needs a table of reliable sites")
        found = st.top_then_reliable(found, sites)
    found = stage(found, "hits")
    compared = found.filter("doc_id IS NOT NULL").join(claims.select(*CLAIM, F.col("url").alias("_own")), CLAIM).filter("NOT (url <=> _own)").drop("_own")
    compared = stage(compared, "compared")
    compare, order, text_of = _comparison(claims, sources, config, store, compared)
    carry = [*order, *(c for c in ("doc_id", "source_claim_id", "relation") if c not in order)]
    first, _ = evidence.in_waves(compared, compare, order, carry, tuple(config.wave_ranks), config.wave_least_hits)
    return Verified(claims, found, verdict.verdicts(claims, text_of(first)))


def _comparison(claims: DataFrame, sources: DataFrame, config: VerifyConfig, store: str | None, compared: DataFrame):
    """How hits are compared, the order in which pairs decide, and how a pair's texts are found."""
    sizes = {"tile_rows": config.tile_rows, "hot_key_rows": config.hot_key_rows}
    chain = tiles = None
    if config.extract_sources or store is not None or config.encoder is not None:
        used = sources.select("doc_id", "url", "text").join(compared.select("doc_id").distinct(), "doc_id", "left_semi")
        chain = source_claims(used, config, store)
        tiles = evidence.tiles_of(chain, "doc_id", config.tile_rows)

    def text_of(pairs: DataFrame) -> DataFrame:
        if chain is None:
            return evidence.with_source_text(pairs, sources)
        return pairs.join(chain, ["doc_id", "source_claim_id"]).join(sources.select("doc_id", F.col("url").alias("source_url")), "doc_id")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(claims.select(*CLAIM, "claim"), CLAIM)
        if config.scorer is not None:
            return relation.with_model_relation(rows, config.scorer, config.labels)
        return rows.withColumn("relation", relation.lexical_relation(relation.profile("claim"), relation.profile("source_claim")))

    def by_vector(hits: DataFrame) -> DataFrame:
        encoder = None if config.encoder == "hashed" else config.encoder
        return scored(text_of(stage(dense.nearest(hits, claims, chain, encoder, k=config.nearest_k, **sizes), "pairs")))

    def by_words(hits: DataFrame) -> DataFrame:
        pairs = evidence.nearest(hits, claims, sources, k=config.nearest_k, tiles=tiles, **sizes)
        return pairs if config.scorer is None else scored(text_of(stage(pairs.drop("relation"), "pairs")))

    def every(hits: DataFrame) -> DataFrame:
        if config.scorer is None:
            found = evidence.exhaustive(hits, claims, sources, tiles=tiles, **sizes)
            return found.filter("at IS NOT NULL").withColumnRenamed("at", "source_claim_id")
        # a plugged model sees every sentence of every hit, in Arrow batches
        if chain is not None:
            return scored(hits.join(chain, "doc_id"))
        wanted = sources.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
        return scored(hits.join(evidence.source_claims(wanted, ["doc_id"]), "doc_id"))

    if not config.embed_source_claims:
        return every, ["search_rank", "source_claim_id"], text_of
    return (by_words if config.encoder is None else by_vector), ["search_rank", "dist_rank"], text_of
