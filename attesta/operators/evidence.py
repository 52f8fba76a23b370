"""Source claims, the closest of them per hit, and the first that decides a claim.

A source's claims travel as tiles: arrays of at most ``tile_rows`` sentences. The claims that hit a source travel as
blocks, so a row of the join is a (tile, block of claims) and a tile is sent once, not once per hit. Each such row
reduces itself to the few best entries of every claim in it, so no table of all pairs ever exists, and a source
of any size is spread over as many rows as it has tiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attesta.functions import text as tx
from attesta.operators import relation as rel
from attesta.operators.skew import hot_keys, union_all
from attesta.operators.staging import stage

CLAIM = ["article_id", "claim_id"]


def source_claims(sources: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """One row per sentence of every source, numbered from 0."""
    return sources.select(*id_cols, F.posexplode(tx.sentences(text)).alias("source_claim_id", "source_claim"))


def source_tiles(sources: DataFrame, key: str, text: str = "text", tile_rows: int = 256) -> DataFrame:
    """``key, tile, first_id, rows array<struct<toks, nums, neg>>``, made inside each row."""
    sents = F.col("_s")
    return (
        sources.select(key, tx.sentences(text).alias("_s"))
        .select(key, "_s", F.posexplode(F.when(
            F.size(sents) > 0, F.sequence(F.lit(0), F.size(sents) - 1, F.lit(tile_rows))))
            .alias("tile", "first_id"))
        .select(key, "tile", "first_id",
                F.transform(F.slice(sents, F.col("first_id") + 1, F.lit(tile_rows)), rel.profile).alias("rows"))
    )


def tiles_of(claims: DataFrame, key: str, tile_rows: int = 256) -> DataFrame:
    """The same tiles from a table of source claims (``key, source_claim_id, source_claim``)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("source_claim_id").alias("id"), rel.profile("source_claim").alias("p"))))
    return (
        claims.groupBy(key, F.floor(F.col("source_claim_id") / tile_rows).cast("int").alias("tile")).agg(listed.alias("_l"))
        .select(key, "tile", F.transform("_l", lambda x: x["id"]).alias("ids"), F.transform("_l", lambda x: x["p"]).alias("rows"))
    )


def hits_with_tiles(hits: DataFrame, claims: DataFrame, sources: DataFrame, key: str = "doc_id",
                    tile_rows: int = 256, hot_key_rows: int = 1_000, tiles: DataFrame | None = None) -> DataFrame:
    """``key, tile, ids, rows, askers``: tiles of the sources that were hit, with the claims that hit them.

    ``hits`` is read more than once: pass a staged table. Only sources that
    were hit are tokenised, and the hits on a much-hit source are several blocks. ``tiles`` are used in place of the
    sources' own sentences (see ``tiles_of``).
    """
    if tiles is None:
        wanted = sources.join(hits.select(key).distinct(), key, "left_semi")
        last = F.col("first_id") + F.size("rows") - 1
        tiles = source_tiles(wanted, key, tile_rows=tile_rows).withColumn("ids", F.sequence("first_id", last)).drop("first_id")
    hot = hot_keys(hits, [key], hot_key_rows)
    asked = hits.join(claims.select(*CLAIM, rel.profile("claim").alias("h")), CLAIM).join(hot, key, "left")
    block = F.pmod(F.xxhash64(*CLAIM), F.coalesce("_parts", F.lit(1))).cast("int")
    blocks = asked.groupBy(key, block.alias("_block")).agg(F.collect_list(F.struct(*CLAIM, "search_rank", "h")).alias("askers"))
    dealt = tiles.join(hot, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(blocks, [key, "_block"]).drop("_block")


def nearest(hits: DataFrame, claims: DataFrame, sources: DataFrame, key: str = "doc_id", k: int = 5,
            tile_rows: int = 256, hot_key_rows: int = 1_000, tiles: DataFrame | None = None) -> DataFrame:
    """The k closest source claims per (claim, source), with their relation.

    Output: claim key, ``search_rank``, key, ``source_claim_id``, ``dist``,
    ``dist_rank``, ``relation``. Ties go to the lower source claim id.
    """
    joined = hits_with_tiles(hits, claims, sources, key, tile_rows, hot_key_rows, tiles)
    rows, ids = F.col("rows"), F.col("ids")

    def best(asker: Column) -> Column:
        near = F.slice(F.sort_array(F.transform(
            rows, lambda p, i: F.struct(rel.distance(asker["h"], p).alias("dist"), i.alias("at")))), 1, k)
        return F.struct(*[asker[c].alias(c) for c in (*CLAIM, "search_rank")], F.transform(near, lambda b: F.struct(
            b["dist"].alias("dist"), F.get(ids, b["at"]).alias("source_claim_id"),
            rel.lexical_relation(asker["h"], F.get(rows, b["at"])).alias("relation"))).alias("e"))

    by_hit = W.partitionBy(*CLAIM, "search_rank", key).orderBy("dist", "source_claim_id")
    return (
        joined.select(key, F.explode(F.transform("askers", best)).alias("_a"))
        .select(key, "_a.*").select(*CLAIM, "search_rank", key, F.explode("e").alias("_e"))
        .select(*CLAIM, "search_rank", key, "_e.*")
        .withColumn("dist_rank", F.row_number().over(by_hit))
        .filter(F.col("dist_rank") <= k)
    )


def exhaustive(hits: DataFrame, claims: DataFrame, sources: DataFrame, key: str = "doc_id",
               tile_rows: int = 256, hot_key_rows: int = 1_000, tiles: DataFrame | None = None) -> DataFrame:
    """Every claim of every hit is compared, none is emitted: per (claim, tile)
    only the number compared and the first one that is not neutral.

    Output: claim key, ``search_rank``, key, ``tile``, ``first_id``, ``n``,
    ``at`` (source claim id or null) and its ``relation``.
    """
    joined = hits_with_tiles(hits, claims, sources, key, tile_rows, hot_key_rows, tiles)
    rows, ids = F.col("rows"), F.col("ids")

    def first(asker: Column) -> Column:
        found = F.transform(rows, lambda p: rel.lexical_relation(asker["h"], p))
        named = tx.let(found, lambda v: tx.let(
            F.array_position(F.transform(v, lambda x: x != rel.NEUTRAL), True).cast("int"),
            lambda i: F.when(i > 0, F.struct(F.get(ids, i - 1).alias("at"), F.get(v, i - 1).alias("relation")))))
        return F.struct(*[asker[c].alias(c) for c in (*CLAIM, "search_rank")], named.alias("found"))

    return (
        joined.select(key, "tile", F.get("ids", 0).alias("first_id"), F.size("rows").alias("n"),
                      F.explode(F.transform("askers", first)).alias("_a"))
        .select("_a.article_id", "_a.claim_id", "_a.search_rank", key, "tile", "first_id", "n", "_a.found.at", "_a.found.relation")
    )


def in_waves(hits: DataFrame, compare: Callable[[DataFrame], DataFrame], order: list[str], carry: list[str],
             last_ranks: tuple[int, ...] = (3,), least_hits: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """First decisive pair per claim, comparing no more hits than it takes, in as many waves as ``last_ranks`` has and one.

    A wave compares the hits up to its last rank of the claims that no earlier wave decided, so no claim gets another
    pair than a comparison of all hits would give: ``order`` must begin with the search rank. Fewer than ``least_hits`` are compared in one
    wave, as another round would cost more than it saves. Returns the pairs and a
    count per wave of the hits compared. ``hits`` must be staged.
    """
    if order[0] != "search_rank":
        raise ValueError("waves follow the search rank")
    found, counts, open_ = [], [], hits
    edges = [0, *(last_ranks if hits.count() >= least_hits else ()), None]
    for wave, (above, upto) in enumerate(zip(edges, edges[1:]), 1):
        now = open_.filter(F.col("search_rank") > above)
        now = now if upto is None else now.filter(F.col("search_rank") <= upto)
        now = stage(now, "wave")
        found.append(stage(first_decisive(compare(now), order, carry), "decided"))
        counts.append(now.agg(F.lit(wave).alias("wave"), F.count(F.lit(1)).alias("hits")))
        open_ = open_.join(found[-1].select(*CLAIM), CLAIM, "left_anti")
    return union_all(found), union_all(counts)


def first_decisive(pairs: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """First non-neutral pair per claim in ``order``.

    A minimum over structs: map-side combined, so a claim with any number of
    pairs costs one row per task in the shuffle.
    """
    entry = F.min(F.struct(*order, *[c for c in carry if c not in order])).alias("_e")
    return (
        pairs.filter(F.col("relation") != rel.NEUTRAL)
        .groupBy(*CLAIM).agg(entry).select(*CLAIM, "_e.*")
    )


def with_source_text(evidence: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bring the text of the chosen source claim back; only sources in use are split.

    ``evidence`` is read twice: pass a staged table.
    """
    wanted = sources.join(evidence.select(key).distinct(), key, "left_semi")
    texts = source_claims(wanted, [key, "url"]).withColumnRenamed("url", "source_url")
    return evidence.join(texts, [key, "source_claim_id"])
