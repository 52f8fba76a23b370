"""Cut texts into chunks, sentences and claims. Every cut is made inside its row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import text as tx
from attesta.operators.skew import numbered
from attesta.operators.staging import stage

# Separators from coarse to fine, clause and discourse markers.
SEPARATORS = ["\n\n", "\n", " "]
CLAUSE_WORDS = ("and|but|or|because|while|whereas|although|since|und|aber|oder|weil|während|obwohl"
                "|et|mais|ou|car|tandis|y|pero|o|porque|mientras|aunque")
DISCOURSE_WORDS = ("however|therefore|moreover|furthermore|because|although|thus|jedoch|daher|außerdem|weil"
                   "|cependant|donc|pourtant|parce|sin embargo|por tanto|además|porque")
CLAUSE_CUT = rf"(?i)[;]|,[ \t\n\r\f]+(?:{CLAUSE_WORDS})[ \t\n\r\f]+"
DISCOURSE_CUT = rf"(?i)[ \t\n\r\f]+({DISCOURSE_WORDS})[ \t\n\r\f,]+"
PUNCTUATION_CUT = r"[,;:.!?]+(?:[ \t\n\r\f]+|$)"
PIECE, BREAK, HARD = 0, 1, 2


def _elements(text: Column, size: int, seps: list[str]) -> Column:
    """Text as (length, kind, separator): pieces shorter than ``size``, each
    starting with its separator; a piece too long is cut at the next finer
    separator, fenced by breaks because nothing is packed across it."""
    sep, finer = seps[0], seps[1:]
    fence = F.array(F.struct(F.lit(0).alias("len"), F.lit(BREAK).alias("kind"), F.lit("").alias("sep")))
    parts = F.filter(F.split(F.replace(text, F.lit(sep), F.lit(tx.MARK + sep)), tx.MARK), lambda p: p != "")

    def cut(p: Column) -> Column:
        whole = F.array(F.struct(F.length(p).alias("len"), F.lit(PIECE).alias("kind"), F.lit(sep).alias("sep")))
        inner = _elements(p, size, finer) if finer else F.array(
            F.struct(F.length(p).alias("len"), F.lit(HARD).alias("kind"), F.lit("").alias("sep")))
        return F.when(F.length(p) < size, whole).otherwise(F.concat(fence, inner, fence))

    return F.flatten(F.transform(parts, cut))


def _pack(elements: Column, text: Column, size: int, overlap: int) -> Column:
    """Greedy packing of elements into [start, end) ranges of at most ``size``
    characters; a new range reaches back over whole pieces, up to ``overlap``."""
    def span(s, e):
        return F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))

    empty = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("start"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        pos, start, n = a["pos"], a["start"], x["len"]
        closed = F.when(pos > start, F.concat(a["out"], span(start, pos))).otherwise(a["out"])
        stride = size - overlap
        windows = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)).cast("int")),
            lambda j: F.struct((pos + j * stride).cast("int").alias("s"),
                               F.least(pos + j * stride + size, pos + n).cast("int").alias("e")))
        back = pos
        if overlap:
            reach = F.greatest(pos - overlap, pos + n - size)
            at = F.call_function("locate", x["sep"], text, reach + 1) - 1
            back = F.when((at < 0) | (at > pos), pos).otherwise(at)
        full = (pos > start) & (pos + n - start > size)
        return (
            F.when(x["kind"] == BREAK, F.struct(pos.alias("pos"), pos.alias("start"), closed.alias("out")))
            .when(x["kind"] == HARD, F.struct((pos + n).alias("pos"), (pos + n).alias("start"),
                                              F.concat(a["out"], windows).alias("out")))
            .otherwise(F.struct((pos + n).alias("pos"), F.when(full, back).otherwise(start).alias("start"),
                                F.when(full, closed).otherwise(a["out"]).alias("out")))
        )

    def finish(a: Column) -> Column:
        return F.when(a["pos"] > a["start"], F.concat(a["out"], span(a["start"], a["pos"]))).otherwise(a["out"])

    return F.aggregate(elements, zero, step, finish)


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Chunks of at most ``size`` characters, cut at paragraph, line, word, then character."""
    spans = _pack(_elements(text, size, SEPARATORS), text, size, overlap)
    cut = F.transform(spans, lambda r: tx.strip(F.substring(text, r["s"] + 1, r["e"] - r["s"])))
    return F.filter(cut, lambda c: c != "")


def word_windows(text: Column, width: int = 200, overlap: int = 50) -> Column:
    """Windows of ``width`` words; the last one is never only overlap."""
    words = F.array_remove(F.split(text, r"[ \t\n\r\f\x0B]+"), "")

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(width - overlap))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(width)), " "))

    return F.filter(tx.let(words, windows), lambda c: c != "")


def pieces(text: Column, pattern: str) -> Column:
    """Split at a pattern, trim, drop blanks."""
    return F.filter(F.transform(F.split(text, pattern), tx.strip), lambda s: s != "")


def discourse_pieces(text: Column) -> Column:
    """Split before discourse markers; each marker stays with what follows it."""
    return pieces(F.regexp_replace(text, DISCOURSE_CUT, tx.MARK + "$1 "), tx.MARK)


def clause_claims(text: Column, min_tokens: int = 3) -> Column:
    """Native claim extractor: sentences cut at semicolons and clause connectives."""
    clauses = F.flatten(F.transform(tx.sentences(text), lambda s: pieces(s, CLAUSE_CUT)))
    return F.filter(clauses, lambda c: F.size(tx.tokens(c)) >= min_tokens)


def chunk_table(texts: DataFrame, keys: list[str], text: str = "text", size: int = 1000,
                overlap: int = 200) -> DataFrame:
    return texts.select(*keys, F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk_id", "chunk"))


def claims_with_chunks(texts: DataFrame, keys: list[str], text: str = "text", size: int = 1000,
                       overlap: int = 200, extract: Callable[[Column], Column] = tx.sentences) -> DataFrame:
    """Claims in chunk order, then claim order, each with its chunk.

    Nested arrays are flattened inside the row, so positions are dense
    without a window. Blank chunks give no claims.
    """
    found = F.transform("_chunks", lambda c, i: F.transform(
        extract(c), lambda s: F.struct(i.alias("chunk_id"), s.alias("claim"), c.alias("chunk"))))
    return (
        texts.select(*keys, chunks(F.col(text), size, overlap).alias("_chunks"))
        .select(*keys, F.posexplode(F.flatten(found)).alias("claim_id", "_c"))
        .select(*keys, "claim_id", "_c.chunk_id", "_c.claim", "_c.chunk")
    )


def extracted_claims(chunked: DataFrame, keys: list[str],
                     extractor: Callable[[Iterator[pd.Series]], Iterator[list]]) -> DataFrame:
    """Claims from a plugged model over chunk rows (``chunk_id``, ``chunk``).

    ``extractor`` maps an iterator of chunk batches to lists of claim lists
    and may load its model once. Positions follow (chunk, place in reply).
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for claims in extractor(batches):
            yield pd.Series(list(claims))

    # Staged: numbering reads the rows twice, the model must not run twice.
    rows = stage(
        chunked.filter(~tx.is_blank("chunk"))
        .select(*keys, "chunk_id", "chunk", F.posexplode(run("chunk")).alias("_pos", "claim")),
        "extracted",
    )
    return numbered(rows, keys, ["chunk_id", "_pos"], F.floor(F.col("chunk_id") / 256), "claim_id").drop("_pos")


def topic_segments(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences with a segment number, cut where neighbouring blocks share least.

    The similarity at a gap is the cosine of the token sets of the two
    sentences before and the two after it. A gap is a cut when it is lower
    than the gap before, not above the gap after, and below the text's mean.
    """
    sets = F.transform("_s", lambda s: F.array_distinct(tx.tokens(s)))

    def block(a: Column, at: Column) -> Column:
        return F.array_distinct(F.flatten(F.slice(a, F.greatest(at, F.lit(1)), 2 - F.when(at < 1, 1).otherwise(0))))

    def gap(i: Column) -> Column:           # between sentence i and i + 1, 1-based
        left, right = block(F.col("_t"), i - 1), block(F.col("_t"), i + 1)
        size = F.sqrt((F.size(left) * F.size(right)).cast("double"))
        return F.when(size > 0, F.round(F.size(F.array_intersect(left, right)) / size, 6)).otherwise(F.lit(0.0))

    n = F.size("_s")
    gaps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), gap)).otherwise(F.array().cast("array<double>"))
    mean = F.aggregate("_g", F.lit(0.0), lambda a, x: a + x, lambda a: F.round(F.try_divide(a, F.size("_g")), 6))
    cuts = tx.let(mean, lambda m: F.transform("_g", lambda g, i: (
        (g < F.coalesce(F.get("_g", i - 1), F.lit(1.0)))
        & (g <= F.coalesce(F.get("_g", i + 1), F.lit(1.0))) & (g < m))))
    begins = F.filter(F.transform(F.coalesce(cuts, F.array().cast("array<boolean>")), lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull())
    return (
        texts.select(*keys, tx.sentences(text).alias("_s")).withColumn("_t", sets)
        .withColumn("_g", gaps).select(*keys, F.inline(_numbered_runs(begins, "segment")))
    )


def _numbered_runs(begins: Column, name: str) -> Column:
    """Sentences ``_s`` with the number of their run; ``begins`` are the places, but 0, where a new run starts. Linear: each run is
    cut out once."""
    n = F.size("_s")
    return tx.let(F.concat(F.array(F.lit(0)), begins), lambda at: F.flatten(F.transform(at, lambda a, k: F.transform(
        F.slice("_s", a + 1, F.coalesce(F.get(at, k + 1), n) - a),
        lambda s, j: F.struct((a + j).alias("i"), s.alias("sentence"), k.alias(name))))))


# Fixed shape of an entity: one or more capitalised words in a row.
ENTITY_SPAN = r"(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*)"


def entities(sentence: Column) -> Column:
    """Capitalised spans after the first word, lower-cased."""
    tail = F.regexp_replace(sentence, r"^[^ ]+", "")
    found = F.regexp_extract_all(tail, F.lit(ENTITY_SPAN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda e: F.lower(e)))


def entity_groups(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Neighbouring sentences that share an entity get one group number."""
    begins = F.filter(F.transform("_e", lambda e, i: F.when(
        (i > 0) & ~F.arrays_overlap(e, F.get("_e", i - 1)), i)), lambda i: i.isNotNull())
    return (
        texts.select(*keys, tx.sentences(text).alias("_s"))
        .withColumn("_e", F.transform("_s", entities)).select(*keys, F.inline(_numbered_runs(begins, "group_id")))
    )


def hybrid_chunks(text: Column, size: int = 300) -> Column:
    """Clause pieces of all sentences, packed back into chunks of at most ``size`` characters."""
    clauses = F.flatten(F.transform(tx.sentences(text), lambda s: pieces(s, CLAUSE_CUT)))
    return tx.let(F.array_join(clauses, "\n"), lambda joined: chunks(joined, size, 0))
