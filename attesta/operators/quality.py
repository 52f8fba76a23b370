"""Claim quality: check-worthiness, clean-up, uniqueness, criteria, similarity of rewrites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from attesta.functions import text as tx
from attesta.operators.similar_sets import similar_components
from attesta.operators.staging import stage

# Labels, word lists of the rules, prefixes cut from claim lists (in this order).
CHECKWORTHY, OPINION, PERSONAL, NOT_A_CLAIM = "checkworthy", "opinion", "personal statement", "not a claim"
OPINION_WORDS = ["better", "best", "worse", "worst", "should", "beautiful", "ugly", "terrible", "great", "opinion",
                 "besser", "schlecht", "soll", "meinung", "meilleur", "pire", "doit", "avis",
                 "mejor", "peor", "debe", "opinión"]
FIRST_PERSON = ["i", "me", "my", "mine", "we", "our", "us", "ich", "mein", "meine", "wir", "unser",
                "je", "moi", "mon", "ma", "mes", "nous", "notre", "yo", "mi", "mis", "nosotros", "nuestro"]
IMPERATIVES = ["please", "let", "try", "stop", "consider", "remember", "imagine", "bitte", "por", "veuillez"]
PRONOUN_WORDS = ["he", "she", "it", "they", "him", "her", "them", "his", "their", "this", "these", "that", "those"]
PREFIXES = ["-", "- ", "The ", "speaker ", "text ", "post ", "article ", "blog post ", "blog article ",
            "blog post article "]
REPORTING_START = r"(?i)^the (?:speaker|text|author|article|post) (?:says|suggests|advises|states|claims)"
JOINED_FACTS = r"(?i);|,? (?:and|but|while|whereas) "
CHRF_CHARS = 50_000         # characters whose n-grams are counted at once


def _any(toks: Column, words: list[str]) -> Column:
    return F.arrays_overlap(toks, F.array(*[F.lit(w) for w in words]))


def checkworthiness(claim) -> Column:
    """Question or command, then opinion, then first person; the rest is checkworthy."""
    toks = tx.tokens(claim)
    return (
        F.when(tx.strip(claim).endswith("?") | (F.size(toks) == 0)
               | F.get(toks, 0).isin(IMPERATIVES), NOT_A_CLAIM)
        .when(_any(toks, OPINION_WORDS), OPINION)
        .when(_any(toks, FIRST_PERSON), PERSONAL)
        .otherwise(CHECKWORTHY)
    )


def falsifiable(claims: DataFrame, check: bool = False, text: str = "claim", predicate: Column | None = None) -> DataFrame:
    """Keeps all claims unless checking is on; then those the predicate (default: the rule) accepts."""
    if not check:
        return claims
    return claims.filter(checkworthiness(text) == CHECKWORTHY if predicate is None else predicate)


def clean_claims(claims) -> Column:
    """Prefixes that every claim of the list has, in fixed order, then a final dot
    every claim has, are cut; claims are trimmed and blanks dropped."""
    def cut(a: Column, p: Column) -> Column:
        return F.when(F.forall(a, lambda c: c.startswith(p)),
                      F.transform(a, lambda c: F.substr(c, F.length(p) + 1))).otherwise(a)

    def dotless(a: Column) -> Column:
        bare = F.when(F.forall(a, lambda c: c.endswith(".")), F.transform(
            a, lambda c: F.substring(c, F.lit(1), F.length(c) - 1))).otherwise(a)
        return F.filter(F.transform(bare, tx.strip), lambda c: c != "")

    return F.aggregate(F.array(*[F.lit(p) for p in PREFIXES]), tx.col(claims), cut, dotless)


def normal_text(text) -> Column:
    return F.array_join(tx.tokens(text), " ")


def unique_claims(claims: DataFrame, ids: list[str], text: str) -> DataFrame:
    """First claim (by ``ids``) of each normalised text, with how many share it.

    Grouped by hash with a map-side combine: a text copied a billion times is
    one row per task in the shuffle.
    """
    return (
        claims.groupBy(F.md5(normal_text(text)).alias("_h"))
        .agg(F.min(F.struct(*ids, text)).alias("m"), F.count(F.lit(1)).alias("n_copies"))
        .select("m.*", "n_copies")
    )


def near_unique(claims: DataFrame, ids: list[str], text: str, threshold: float = 0.7) -> DataFrame:
    """Claims that repeat another in other words, with the lowest claim of all that repeat each other.

    Exact copies go first. Token sets are linked where their Jaccard similarity reaches ``threshold``; linked sets are one
    group, whose lowest claim is kept, so no claim points at one that is itself a repeat. ``jaccard`` is the similarity to
    the kept claim, lower than ``threshold`` where only claims between them link the two.
    """
    sets = (
        unique_claims(claims, ids, text)
        .select(F.struct(*ids).alias("id"), F.array_sort(F.array_distinct(tx.tokens(text))).alias("toks"))
        .filter(F.size("toks") > 0)
    )
    named = stage(sets.withColumn("first", F.min("id").over(W.partitionBy("toks"))), "claims")
    distinct = named.filter("id = first").select("id", "toks")
    labels = similar_components(distinct, threshold).withColumnRenamed("node", "first")
    rooted = (named.join(labels, "first", "left").withColumn("root", F.coalesce("root", "first")).filter("id <> root")
              .join(distinct.select(F.col("id").alias("root"), F.col("toks").alias("kept")), "root"))
    both = F.size(F.array_intersect("toks", "kept"))
    return rooted.select(
        *[F.col(f"id.{i}").alias(i) for i in ids], *[F.col(f"root.{i}").alias(f"repeats_{i}") for i in ids],
        F.round(both / (F.size("toks") + F.size("kept") - both), 6).alias("jaccard"))


def criteria(claims: DataFrame, article: str, text: str) -> DataFrame:
    """Per article: share of claims that join facts, use pronouns or open with a reporting phrase."""
    toks = tx.tokens(text)
    flags = claims.select(
        article, tx.col(text).rlike(JOINED_FACTS).cast("int").alias("j"),
        _any(toks, PRONOUN_WORDS).cast("int").alias("p"), tx.col(text).rlike(REPORTING_START).cast("int").alias("r"))
    return flags.groupBy(article).agg(
        F.count(F.lit(1)).alias("n_claims"), F.round(F.avg("j"), 6).alias("joined_share"),
        F.round(F.avg("p"), 6).alias("pronoun_share"), F.round(F.avg("r"), 6).alias("reporting_share"))


def all_satisfy(rows: DataFrame, everyone: DataFrame, key: str, name: str, predicate: Column) -> DataFrame:
    """Per key: does every row satisfy the predicate? True for a key without rows."""
    held = rows.groupBy(key).agg(F.bool_and(predicate).alias(name))
    return everyone.select(key).distinct().join(held, key, "left").withColumn(name, F.coalesce(name, F.lit(True)))


def chrf(hypothesis, reference, max_n: int = 6, beta: float = 2.0) -> Column:
    """Character n-gram F-score, whitespace ignored, averaged over n where both have n-grams."""
    def bare(c) -> Column:
        return F.coalesce(F.regexp_replace(tx.col(c), r"[ \t\n\r\f\x0B]+", ""), F.lit(""))

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, r in batches:
            yield pd.Series(_gram_scores(h.tolist(), r.tolist(), max_n, beta))

    return F.round(F.coalesce(scores(bare(hypothesis), bare(reference)), F.lit(0.0)), 6)


def _gram_scores(h: list[str], r: list[str], max_n: int, beta: float) -> np.ndarray:
    """The score of each pair; pairs are counted together in slices of about ``CHRF_CHARS`` characters."""
    ends = np.cumsum(np.fromiter((len(a) + len(b) for a, b in zip(h, r)), np.int64, len(h)))
    cuts = (np.flatnonzero(np.diff(ends // CHRF_CHARS)) + 1).tolist()
    weight, out = beta * beta, []
    for lo, hi in zip([0, *cuts], [*cuts, len(h)]):
        n, p, q = _gram_shares(h[lo:hi], r[lo:hi], max_n)
        p, q = p / np.maximum(n, 1), q / np.maximum(n, 1)
        low = weight * p + q
        out.append(np.where(low > 0, (1 + weight) * p * q / np.where(low > 0, low, 1.0), 0.0))
    return np.concatenate(out)


def _gram_shares(h: list[str], r: list[str], max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair: lengths n at which both have n-grams, and the shares of either's n-grams that both have, summed over these."""
    pairs, texts = len(h), [*h, *r]
    sizes = np.fromiter(map(len, texts), np.int64, 2 * pairs)
    chars = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)[1].astype(np.int64)
    width = int(chars.max(initial=0)) + 1
    pair = np.repeat(np.tile(np.arange(pairs), 2), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    ours = int(sizes[:pairs].sum())
    n, p, q = np.zeros(pairs, np.int64), np.zeros(pairs), np.zeros(pairs)
    gram = pair.copy()      # numbers the n-grams of all pairs, from the one before and the next character
    for size in range(1, max_n + 1):
        at = np.flatnonzero(left >= size)
        if not len(at):
            break
        names, gram[at] = np.unique(gram[at] * width + chars[at + size - 1], return_inverse=True)
        of = np.zeros(len(names), np.int64)
        of[gram[at]] = pair[at]
        mine, theirs = (np.bincount(gram[some], minlength=len(names)) for some in (at[at < ours], at[at >= ours]))
        both = np.bincount(of, weights=np.minimum(mine, theirs), minlength=pairs)
        n_h, n_r = (np.maximum(s - size + 1, 0) for s in (sizes[:pairs], sizes[pairs:]))
        some = (n_h > 0) & (n_r > 0)
        n[some] += 1
        p[some] += both[some] / n_h[some]
        q[some] += both[some] / n_r[some]
    return n, p, q


def quality_model(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """Binary check-worthiness model: tokens, hashed counts, inverse frequency, logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=tx.TOKEN_GAP, toLowercase=True),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def holdout_metrics(model, held: DataFrame, label: str = "label") -> DataFrame:
    """One row: number of held-out texts, accuracy, area under the ROC curve."""
    scored = model.transform(held).select(label, "prediction", "rawPrediction")
    auc = BinaryClassificationEvaluator(labelCol=label).evaluate(scored)
    return scored.agg(
        F.count(F.lit(1)).alias("n_held"),
        F.round(F.avg((F.col("prediction") == F.col(label)).cast("double")), 6).alias("accuracy"),
    ).withColumn("auc", F.lit(round(auc, 6)))
