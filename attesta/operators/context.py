"""Sentences and claims in context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from attesta.functions import text as tx
from attesta.operators.segment import ENTITY_SPAN
from attesta.operators.skew import with_halo

CUT_MARK = "[...]"
# Words that open a sentence by pointing back.
PRONOUNS = ["he", "she", "it", "they", "this", "these", "that", "those", "er", "sie", "es", "dies", "diese",
            "il", "elle", "ils", "elles", "cela", "él", "ella", "ellos", "ellas", "esto"]


def claim_context(claims: DataFrame, key: list[str], position: str = "claim_id", text: str = "claim",
                  before: int = 5, after: int = 1, sep: str = "", block: int = 4096) -> DataFrame:
    """Adds ``before`` and ``after``: neighbouring claims joined with ``sep``.

    Works on exploded rows with dense positions. Blocks with a halo keep every
    window short, so one article may hold any share of the rows.
    """
    spread = with_halo(claims, position, before, after, block)
    w = W.partitionBy(*key, "_block").orderBy(position)
    return (
        spread
        .withColumn("before", F.array_join(F.collect_list(text).over(w.rowsBetween(-before, -1)), sep))
        .withColumn("after", F.array_join(F.collect_list(text).over(w.rowsBetween(1, after)), sep))
        .filter("_block = _home").drop("_block", "_home")
    )


def resolve_pronoun(before: Column, claim: Column) -> Column:
    """Native rule: a leading pronoun becomes the last capitalised span of ``before``."""
    word = F.regexp_extract(claim, r"^([\p{L}]+)", 1)
    spans = F.regexp_extract_all(before, F.lit(ENTITY_SPAN), F.lit(1))
    pointing = F.lower(word).isin(PRONOUNS) & (F.size(spans) > 0)
    return F.when(pointing, F.concat(F.element_at(spans, -1), F.substr(claim, F.length(word) + 1))).otherwise(claim)


def rewrite_in_order(articles: DataFrame, claims: str = "claims", before: int = 5, after: int = 1,
                     rewriter: Callable[[str, str, str], str] | None = None,
                     batch_rewriter: Callable[[list[str], list[str], list[str]], list[str]] | None = None) -> DataFrame:
    """Rewrite each claim from its context; earlier rewrites feed later contexts.

    ``claims`` is one article's array, so the order-dependent walk stays in
    its row and articles run in parallel. Without a plugged model the pronoun
    rule runs as a fold. A ``batch_rewriter`` gets lists of (before, claim, after): step i of all articles of an
    Arrow batch is one call, so a batch costs as many calls as its longest article has claims. A ``rewriter``
    gets one claim at a time.
    """
    if rewriter is None and batch_rewriter is None:
        def step(done: Column, claim: Column) -> Column:
            context = F.array_join(F.slice(done, F.greatest(F.size(done) - before + 1, F.lit(1)), before), "")
            return F.concat(done, F.array(resolve_pronoun(context, claim)))

        fold = F.aggregate(claims, F.array().cast("array<string>"), step)
        return articles.withColumn("rewritten", fold)

    def together(befores: list[str], texts: list[str], afters: list[str]) -> list[str]:
        if batch_rewriter is not None:
            return list(batch_rewriter(befores, texts, afters))
        return [rewriter(*row) for row in zip(befores, texts, afters)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batch: pd.Series) -> pd.Series:
        lists = [list(given) if given is not None else [] for given in batch]
        for i in range(max(map(len, lists), default=0)):
            open_ = [now for now in lists if i < len(now)]
            found = together(["".join(now[max(0, i - before):i]) for now in open_], [now[i] for now in open_],
                             ["".join(now[i + 1:i + 1 + after]) for now in open_])
            for now, text in zip(open_, found, strict=True):
                now[i] = text
        return pd.Series(lists)

    return articles.withColumn("rewritten", run(claims))


def excerpts(texts: DataFrame, keys: list[str], text: str, before: int = 5, after: int = 5) -> DataFrame:
    """Each sentence with its excerpt: neighbours joined by newlines, ``[...]`` where cut.

    The leading mark appears from sentence ``before`` on and the trailing one
    until ``after`` from the end, also where nothing was left out.
    """
    n = F.size("_s")
    mark, none = F.array(F.lit(CUT_MARK)), F.array().cast("array<string>")

    def row(sentence: Column, i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        body = F.slice("_s", first + 1, F.least(i + after, n - 1) - first + 1)
        lead = F.when(i >= before, mark).otherwise(none)
        tail = F.when(i > n - after, none).otherwise(mark)
        return F.struct(i.alias("i"), sentence.alias("sentence"),
                        F.array_join(F.concat(lead, body, tail), "\n").alias("excerpt"))

    return (
        texts.select(*keys, tx.sentences(text).alias("_s"))
        .select(*keys, F.inline(F.transform("_s", row)))
    )


def sentence_window(texts: DataFrame, keys: list[str], text: str, before: int, after: int, sep: str) -> DataFrame:
    """Each sentence with ``before`` and ``after`` neighbours, no marks."""
    def row(sentence: Column, i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        body = F.slice("_s", first + 1, i + after - first + 1)
        return F.struct(i.alias("i"), sentence.alias("sentence"), F.array_join(body, sep).alias("context"))

    return (
        texts.select(*keys, tx.sentences(text).alias("_s"))
        .select(*keys, F.inline(F.transform("_s", row)))
    )
