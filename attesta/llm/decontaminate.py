"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all document words.

Each window of ``size`` consecutive item words (a shorter item is one window) is one entry of the set,
filed under its longest word, the one least likely to occur by chance. A document is
scanned once: every word probes the set, and a probe that hits is verified by
comparing all words of the window. Explode, probe and verification are one
code-generated stage without a shuffle; only verified hits are shuffled.

The set is broadcast only when its size has been counted and is within
``broadcast_rows``; beyond that single words join the set by shuffle and candidates are verified in a second join.

Defined cases: null or empty texts have no words and are never hit; items without words give no
window; equal windows of several items are one entry with all their ids; null item ids are not listed;
repeated rows each get their result; an empty table on either side gives no hits; further columns are ignored
by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import GAPS, fresh, lower_words, raw_words, whole

WINDOW = 10
BROADCAST_ROWS = 1_000_000
SPANS = "array<struct<start:int,end:int>>"


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: gram (words), n, item_ids, and the word and place the window is filed under."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), lower_words(whole(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    grams = (
        words.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("gram"))
        .groupBy("gram").agg(F.collect_set("item_id").alias("item_ids"))
    )
    longest = F.array_max(F.transform("gram", lambda x, i: F.struct(F.length(x).alias("l"), (-i).alias("i"))))
    return (
        grams.withColumn("place", -longest["i"])
        .select("gram", F.size("gram").alias("n"), "item_ids", "place",
                F.element_at("gram", F.col("place") + 1).alias("filed"))
    )


def window_hits(docs: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified occurrences: doc_id, text_hash, start, n, item_ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_hash"),
                        lower_words(whole(text_col)).alias("words"))
    start = F.col("p") - F.col("place")
    here = F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("n")) == F.col("gram")
    fits = (start >= 0) & (start + F.col("n") <= F.size("words"))
    found = ["doc_id", "text_hash", start.alias("start"), "n", "item_ids"]
    if windows.limit(broadcast_rows + 1).count() <= broadcast_rows:
        # the word list is not copied: explode, probe and comparison run in one generated loop per document
        probed = texts.select("doc_id", "text_hash", "words", F.posexplode("words").alias("p", "word"))
        return probed.join(F.broadcast(windows), F.col("word") == F.col("filed")).filter(fits).filter(here).select(*found)
    # too many to broadcast: join single words, then bring the candidates back to their texts
    single = texts.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), F.posexplode("words").alias("p", "word"))
    candidates = single.join(windows, F.col("word") == F.col("filed")).drop("word", "filed").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))
    return candidates.join(texts, same).filter(fits).filter(here).select(*found)


def merged(hits: Column) -> Column:
    """Sorted (start, n) hits as disjoint word spans."""
    def add(spans, hit):
        end = hit["start"] + hit["n"]
        last = F.try_element_at(spans, F.lit(-1))
        return F.when(
            (F.size(spans) > 0) & (hit["start"] <= last["end"]),
            F.concat(F.slice(spans, 1, F.size(spans) - 1),
                     F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end")))),
        ).otherwise(F.concat(spans, F.array(F.struct(hit["start"].alias("start"), end.alias("end")))))
    return F.aggregate(hits, F.array().cast(SPANS), add)


def hit_spans(hits: DataFrame) -> DataFrame:
    """Per document with hits: spans (disjoint, in words) and the ids of the items."""
    return hits.groupBy("doc_id", "text_hash").agg(
        merged(F.array_sort(F.collect_set(F.struct("start", "n")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: doc_id, text_hash, n_words, spans, item_ids (both empty where nothing is hit)."""
    found = hit_spans(window_hits(docs, item_windows(items, size), broadcast_rows, id_col, text_col))
    counts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_hash"),
                         F.size(raw_words(whole(text_col))).cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "f_id", "text_hash": "f_hash"})
    return (
        counts.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
        .select("doc_id", "text_hash", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
                F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, mode: str = "documents",
                  broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows without benchmark passages: drop hit documents, or (``mode="spans"``) only the hit words."""
    key, digest, cut = fresh(docs, "__id", "__hash", "__spans")
    found = hit_spans(window_hits(docs, item_windows(items, size), broadcast_rows, id_col, text_col)).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("spans").alias(cut))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(whole(text_col)) == F.col(digest))
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    word_class = "[^" + GAPS[1:-2] + "]+"
    pieces = F.regexp_extract_all(whole(text_col), F.lit(f"{GAPS[:-1]}*{word_class}"), F.lit(0))
    kept = F.filter(pieces, lambda x, i: ~F.exists(cut, lambda s: (s["start"] <= i) & (i < s["end"])))
    tail = F.regexp_extract(whole(text_col), f"{GAPS}$", 0)
    return (
        docs.join(found, same, "left")
        .withColumn(text_col, F.when(F.col(cut).isNull(), F.col(text_col))
                    .otherwise(F.concat(F.array_join(kept, ""), tail)))
        .drop(key, digest, cut)
    )
