"""Label a (premise, hypothesis) pair: entailment, contradiction or neutral.

The native rule is a lexical stand-in for an entailment model. A model is
plugged in as a function over an iterator of (premise, hypothesis) batches
that returns three logits per pair; the label then comes from ``decide``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import text as tx

ENTAILMENT, CONTRADICTION, NEUTRAL = "entailment", "contradiction", "neutral"


def profile(c) -> Column:
    """What the rule needs from one text: distinct tokens, numbers, negation parity."""
    return tx.let(tx.tokens(c), lambda toks: F.struct(
        F.array_distinct(toks).alias("toks"),
        tx.numbers(toks).alias("nums"),
        tx.negation_odd(toks).alias("neg")))


def shared(h: Column, p: Column) -> Column:
    return F.size(F.array_intersect(h["toks"], p["toks"]))


def distance(h: Column, p: Column) -> Column:
    """1 - |H and P| / |H| over distinct tokens, rounded to 6 digits."""
    n = F.size(h["toks"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.lit(1.0) - shared(h, p) / n, 6))


def lexical_relation(h: Column, p: Column) -> Column:
    """Containment >= 0.6 is needed at all, >= 0.8 for entailment; a negation or
    number mismatch turns a contained pair into a contradiction."""
    n = F.size(h["toks"])
    number_clash = (F.size(p["nums"]) > 0) & (F.size(F.array_except(h["nums"], p["nums"])) > 0)
    return tx.let(shared(h, p), lambda both: (
        F.when((n == 0) | (both * 10 < n * 6), NEUTRAL)
        .when((h["neg"] != p["neg"]) | number_clash, CONTRADICTION)
        .when(both * 10 >= n * 8, ENTAILMENT)
        .otherwise(NEUTRAL)))


def relation_of_label(label: Column) -> Column:
    """Model label text to relation: by substring, anything else is neutral."""
    low = F.lower(label)
    return (F.when(low.contains("entail"), ENTAILMENT)
            .when(low.contains("contradict"), CONTRADICTION).otherwise(NEUTRAL))


def softmax(logits: Column) -> Column:
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def decide(logits: Column, labels: Column) -> Column:
    """Label of the largest logit; the first one wins a tie."""
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    return relation_of_label(F.element_at(labels, at))


def with_model_relation(pairs: DataFrame, scorer: Callable[[Iterator], Iterator],
                        labels: tuple, premise: str = "source_claim",
                        hypothesis: str = "claim") -> DataFrame:
    """Add ``relation`` from a plugged scorer, batched through Arrow.

    ``scorer`` gets an iterator of (premises, hypotheses) series and yields
    arrays of shape (n, 3); it can load its model once, before the loop.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for scores in scorer(batches):
            yield pd.Series([list(map(float, row)) for row in scores])

    named = F.array(*[F.lit(x) for x in labels])
    scored = pairs.withColumn("_logits", logits(F.col(premise), F.col(hypothesis)))
    return scored.withColumn("relation", decide(F.col("_logits"), named)).drop("_logits")
