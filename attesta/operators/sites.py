"""Joins of URLs with suffix rules, reliable sites and bias ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attesta.functions import urls as ux

GRAM = 8


def registrable_domains(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``url, domain`` for every distinct URL: one label plus its public suffix.

    Rules are resolved once per distinct host: its suffixes are exploded and
    joined with the list (plain, ``*.`` and ``!`` rules); the longest wins. No match leaves an empty suffix,
    so ``localhost`` becomes ``localhost.``.
    """
    addressed = urls.select("url").distinct().select("url", F.lower(ux.host("url")).alias("host"))
    labels = F.split("host", r"\.")
    hosts = addressed.select("host").distinct().select("host", labels.alias("labels"))
    n = F.size("labels")

    def tail(count):
        return F.array_join(F.slice("labels", n - count + 1, count), ".")

    def keys(count):
        here = tail(count)
        return F.array(
            F.struct(here.alias("rule"), count.alias("taken"), count.alias("rank")),
            F.struct(F.concat(F.lit("*."), tail(count - 1)).alias("rule"), count.alias("taken"), count.alias("rank")),
            F.struct(F.concat(F.lit("!"), here).alias("rule"), (count - 1).alias("taken"),
                     (count + 1000).alias("rank")),
        )

    candidates = F.flatten(F.transform(F.sequence(F.lit(1), n), keys))
    matched = (
        hosts.select("host", F.explode(candidates).alias("c"))
        .select("host", "c.*")
        .join(suffixes.select(F.col("suffix").alias("rule")).distinct(), "rule")
        .groupBy("host").agg(F.max(F.struct("rank", "taken")).alias("m"))
        .select("host", F.col("m.taken").alias("taken"))
    )
    taken = F.coalesce("taken", F.lit(0))
    resolved = (
        hosts.join(matched, "host", "left")
        .select("host", F.concat(
            F.coalesce(F.get("labels", n - taken - 1), F.lit("")), F.lit("."),
            F.array_join(F.slice("labels", n - taken + 1, taken), ".")).alias("domain"))
    )
    return addressed.join(resolved, "host").select("url", "domain")


def reliable_urls(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct URLs the site list covers: equi-joins on host suffixes, then the path.

    Sites are matched once per distinct host, not per URL.

    Equals matching each site's anchored regex: labels before the site's host
    must be non-empty, a port or query glued to the host does not match, case
    counts, and a site's path must end the URL or be followed by ``/``.
    """
    rest = F.regexp_extract("url", r"^https?://(.*)$", 1)
    addressed = (
        urls.select("url").distinct().select("url", rest.alias("rest")).filter("rest <> ''")
        .select("url", F.substring_index("rest", "/", 1).alias("authority"),
                F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)").alias("url_path"))
    )
    labels = F.split("authority", r"\.")
    suffixes = (
        addressed.select("authority").distinct().select("authority", labels.alias("labels"))
        .select("authority", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("at"))
        .filter(~F.exists(F.slice("labels", F.lit(1), F.col("at") - 1), lambda x: x == ""))
        .select("authority", F.array_join(F.slice("labels", F.col("at"), F.size("labels")), ".").alias("host"))
    )
    rules = suffixes.join(sites.select("host", "path").distinct(), "host").select("authority", "path").distinct()
    covers = (F.col("path") == "") & ((F.col("url_path") == "") | F.col("url_path").startswith("/"))
    covers = covers | ((F.col("path") != "") & (
        (F.col("url_path") == F.col("path")) | F.col("url_path").startswith(F.concat("path", F.lit("/")))))
    return addressed.join(rules, "authority").filter(covers).select("url").distinct()


def containing(texts: DataFrame, needles: DataFrame, wildcard: bool = False) -> DataFrame:
    """Distinct ``text, needle`` pairs where the text contains the needle.

    Equi-join on short substrings instead of a nested loop: each needle is
    looked up by the one of its substrings that is rarest among the texts,
    then checked in full. With ``wildcard`` a ``.`` in the needle matches any
    character, and substrings come from the needle's longest label.
    """
    wanted = needles.select("needle").filter("needle <> ''").distinct()
    body = F.col("needle")
    if wildcard:
        body = F.element_at(F.array_sort(F.split("needle", r"\."), lambda a, b: F.length(a) - F.length(b)), -1)
    wanted = wanted.select("needle", body.alias("body"), F.least(F.length(body), F.lit(GRAM)).alias("width"))

    def grams(text, width):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(text, i, width)), lambda g: F.length(g) == width)

    needle_grams = wanted.select("needle", F.explode(F.array_distinct(grams(F.col("body"), F.col("width")))).alias("gram"))
    widths = [r["width"] for r in wanted.select("width").distinct().collect()]      # at most GRAM values
    distinct_texts = texts.select("text").distinct()
    every = [grams(F.col("text"), F.lit(w)) for w in widths] or [F.array().cast("array<string>")]
    text_grams = distinct_texts.select("text", F.explode(F.array_distinct(F.concat(*every))).alias("gram"))
    counts = (
        text_grams.join(needle_grams.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    )
    rarest = (
        needle_grams.join(counts, "gram", "left")
        .groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "gram")).alias("m"))
        .filter("m.n > 0").select("needle", "m.gram")
    )
    found = F.rlike("text", F.col("needle")) if wildcard else F.contains("text", F.col("needle"))
    return text_grams.join(rarest, "gram").filter(found).select("text", "needle")


def source_bias(domains: DataFrame, ratings: DataFrame, mode: str = "literal") -> DataFrame:
    """Rating of each distinct ``domain``: the first row in file order whose URL holds it.

    ``literal`` compares text, ``regex`` lets ``.`` match any character (the
    reading a data-frame library gives a pattern). Unmatched domains stay,
    with nulls and ``matched = false``.
    """
    wanted = domains.select("domain").distinct()
    lowered = ratings.filter("url IS NOT NULL").select(F.lower("url").alias("text"), "row_no",
                                                       "bias_rating", "factual_reporting_rating")
    found = containing(lowered, wanted.select(F.col("domain").alias("needle")), wildcard=mode == "regex")
    first = (
        found.join(lowered, "text")
        .groupBy("needle")
        .agg(F.min_by(F.struct("bias_rating", "factual_reporting_rating"), "row_no").alias("r"))
        .select(F.col("needle").alias("domain"), "r.*", F.lit(True).alias("matched"))
    )
    return wanted.join(first, "domain", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def top_then_reliable(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Search results kept only if reliable: the cut at k came first, so fewer may remain."""
    return hits.join(reliable_urls(hits, sites), "url", "left_semi")


def reliability_flags(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Each hit with ``reliable``, and per claim how many are."""
    marked = hits.join(reliable_urls(hits, sites).withColumn("reliable", F.lit(True)), "url", "left") \
        .withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    return marked.withColumn("n_reliable", F.count_if("reliable").over(W.partitionBy("article_id", "claim_id")))
