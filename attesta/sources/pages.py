"""Raw pages to article text, at corpus level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import html as hx
from attesta.functions import text as tx
from attesta.functions import urls as ux
from attesta.operators.staging import stage


def article_text(articles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Override text where one is given and non-empty, else the loaded text."""
    chosen = overrides.select("article_id", F.col("text").alias("_override"))
    return (
        articles.join(chosen, "article_id", "left")
        .withColumn("overridden", F.coalesce(F.col("_override") != "", F.lit(False)))
        .withColumn("text", F.coalesce(F.nullif("_override", F.lit("")), "text"))
        .drop("_override")
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, title, blocks``, staged: the markup is taken apart once."""
    return stage(
        pages.select("page_id", "url", ux.host("url").alias("host"), hx.page_title("html").alias("title"),
                     hx.content_blocks("html").alias("blocks")),
        "blocks",
    )


def _block_hashes(blocks: DataFrame) -> DataFrame:
    hashes = F.array_distinct(F.transform("blocks", lambda b: F.md5(b)))
    return blocks.select("page_id", "host", F.explode(hashes).alias("block"))


def boilerplate(blocks: DataFrame, min_pages: int = 3, share: float = 0.2) -> DataFrame:
    """``host, block`` hashes found on ``share`` of a host's pages, and on ``min_pages`` of them at least.

    A share, so that a passage copied to a few pages of a large host stays text.

    Counted with a map-side combine: a block on every page of a huge host is
    one row per task in the shuffle.
    """
    pages = blocks.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (_block_hashes(blocks).groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_pages))
    return counts.join(pages, "host").filter(F.col("n") >= F.col("pages") * share).select("host", "block")


def main_content(pages: DataFrame, min_pages: int = 3, repeated: DataFrame | None = None, share: float = 0.2) -> DataFrame:
    """``page_id, url, title, text``: content blocks without what a host repeats.

    Texts are not regrouped: each page gets back the few hashes to leave out.
    ``repeated`` is a known boilerplate table, for runs that see only part of
    a host's pages at a time.
    """
    blocks = page_blocks(pages)
    known = boilerplate(blocks, min_pages, share) if repeated is None else repeated
    drop = (
        _block_hashes(blocks).join(known, ["host", "block"], "left_semi")
        .groupBy("page_id").agg(F.collect_list("block").alias("drop"))
    )
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("drop", F.md5(b)), F.lit(False)))
    return (
        blocks.join(drop, "page_id", "left")
        .select("page_id", "url", "title", F.array_join(kept, "\n").alias("text"))
    )


def titled(content: DataFrame, include_title: bool = True) -> DataFrame:
    """Title, blank line, text; the text alone without a title. An empty text is a failure."""
    body = tx.strip("text")
    with_title = F.concat("title", F.lit("\n\n"), body)
    full = F.when(F.lit(include_title) & (F.col("title") != ""), with_title).otherwise(body)
    return content.select("page_id", "url", F.when(body != "", full).alias("text"))


def load_status(pages: DataFrame, content: DataFrame) -> DataFrame:
    """Every page with ``status`` and ``reason``: a failing source is set aside, not fatal."""
    loaded = content.select("page_id", F.col("text").alias("_text"))
    reason = (
        F.when(ux.normal_url("url").isNull(), "bad url")
        .when(tx.is_blank("html"), "nothing downloaded")
        .when(tx.is_blank("_text"), "no text extracted")
    )
    return (
        pages.join(loaded, "page_id", "left")
        .select("page_id", "url", F.when(reason.isNull(), "ok").otherwise("failed").alias("status"),
                reason.alias("reason"), F.length("_text").alias("text_chars"))
    )
