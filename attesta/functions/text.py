"""Text columns: tokens, sentences, trimming. All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set, the token separator, the sentence boundary.
WHITESPACE = " \t\n\r\f\x0b"
TOKEN_GAP = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])[ \t\n\r\f\x0B]+"
MARK = "\x01"

# Negation words, English, German, French and Spanish.
NEGATIONS = [
    "no", "not", "never", "none", "nor", "without", "cannot",
    "nicht", "kein", "keine", "keinen", "nie", "niemals", "ohne",
    "ne", "pas", "jamais", "aucun", "aucune", "sans", "non",
    "nunca", "jamás", "sin", "ningún", "ninguno", "ninguna", "tampoco",
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of ASCII whitespace, not only spaces."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def tokens(c) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(col(c)), TOKEN_GAP), "")


def sentences(c) -> Column:
    """Sentences of a text: cut after ``. ! ?`` followed by whitespace."""
    parts = F.split(F.regexp_replace(col(c), SENTENCE_END, "$1" + MARK), MARK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def let(value: Column, body) -> Column:
    """Bind a value once: lambdas re-evaluate captured expressions per element."""
    return F.get(F.transform(F.array(value), body), 0)


def term_counts(toks: Column) -> Column:
    """Distinct terms of one token array with their counts, without a shuffle.

    Sorts the array and reads run lengths, so a document's postings are made
    inside its own row: O(n log n), no explode and no grouping by document.
    """
    def run_starts(ordered: Column) -> Column:
        every = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
        return F.filter(every, lambda i: (F.size(ordered) > 0) & (
            (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))

    def runs(ordered: Column) -> Column:
        return let(run_starts(ordered), lambda starts: F.transform(
            starts, lambda s, j: F.struct(
                F.get(ordered, s).alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - s).alias("tf"))))

    return let(F.sort_array(toks), runs)


def negation_odd(toks: Column) -> Column:
    """True when the text holds an odd number of negation words."""
    return F.size(F.filter(toks, lambda t: t.isin(NEGATIONS))) % 2 == 1


def numbers(toks: Column) -> Column:
    return F.filter(F.array_distinct(toks), lambda t: t.rlike("^[0-9]+$"))
