"""Reliable-site lists: harvest from rating tables, build, load, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import urls as ux

# Fixed values of the rating tables the list is harvested from.
GOOD_LABEL = "Generally reliable"
LINK_TITLE = "HTTPS links"
CELLS = 6
HREF_PREFIX = 25


def reliable_sites(patterns: DataFrame) -> DataFrame:
    """``pattern, host, path, regex`` from a table of site patterns."""
    address = ux.site_address("pattern")
    return (
        patterns.select("pattern", address.alias("_a")).distinct()
        .select("pattern",
                F.substring_index("_a", "/", 1).alias("host"),
                F.substr("_a", F.length(F.substring_index("_a", "/", 1)) + 1).alias("path"),
                ux.site_regex("_a").alias("regex"))
    )


def harvest(pages: DataFrame) -> DataFrame:
    """``page_id, row_pos, link_pos, pattern`` from rating tables inside pages.

    Keeps table rows with exactly six cells whose second says generally
    reliable; every link in the sixth titled as a links list gives the part
    of its target after a fixed prefix.
    """
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    anchors = F.regexp_extract_all(F.get("cells", CELLS - 1), F.lit(r"(?is)(<a\s[^>]*>)"), F.lit(1))
    href = F.regexp_extract("anchor", r'(?is)href="([^"]*)"', 1)
    return (
        pages.filter(F.contains("html", F.lit("<tr"))).select("page_id", F.posexplode(rows).alias("row_pos", "row"))
        .select("page_id", "row_pos", cells.alias("cells"))
        .filter((F.size("cells") == CELLS) & F.contains(F.get("cells", 1), F.lit(GOOD_LABEL)))
        .select("page_id", "row_pos", F.posexplode(anchors).alias("link_pos", "anchor"))
        .filter(F.regexp_extract("anchor", r'(?is)title="([^"]*)"', 1) == LINK_TITLE)
        .select("page_id", "row_pos", "link_pos",
                F.substr(href, F.lit(HREF_PREFIX + 1)).alias("pattern"))
    )


def save_sites(patterns: DataFrame, folder: str) -> None:
    """Write the list as a text file set and as a table."""
    patterns.select("pattern").write.mode("overwrite").text(f"{folder}/text")
    patterns.write.mode("overwrite").parquet(f"{folder}/table")


def load_sites(spark: SparkSession, folder: str) -> DataFrame:
    """The saved table; a missing one raises, it never means 'nothing is reliable'."""
    return spark.read.parquet(f"{folder}/table")
