"""Saved search responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where each search service keeps its result list and the link in it.
SHAPES = {
    "serpapi": ("organic_results", "link"),
    "serper": ("organic", "link"),
    "duckduckgo": (None, "href"),
    "tavily": ("results", "url"),
}


def search_hits(responses: DataFrame) -> DataFrame:
    """``claim_id, search_rank, url`` from ``claim_id, provider, reply``.

    A missing result list, an unreadable reply or an unknown provider gives
    no rows; empty links are dropped but keep their place in the ranking.
    """
    links = F.array().cast("array<string>")
    for provider, (key, link) in SHAPES.items():
        item = f"array<struct<{link}:string>>"
        if key:
            found = F.from_json("reply", f"{key} {item}")[key]
        else:
            found = F.from_json("reply", item)
        links = F.when(F.col("provider") == provider, found[link]).otherwise(links)
    return (
        responses.select("claim_id", F.posexplode(links).alias("pos", "url"))
        .filter(F.coalesce(F.col("url") != "", F.lit(False)))
        .select("claim_id", (F.col("pos") + 1).alias("search_rank"), "url")
    )
