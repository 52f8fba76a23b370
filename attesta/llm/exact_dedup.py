"""Exact duplicates: group by a 128-bit content hash, compare bytes inside a group, keep one row.

Two texts are equal when they are the same after all ASCII white space is
deleted. The hash and the normalised text are grouped together, so the
bytes decide and texts that only share the hash stay apart. Counting starts on
the map side, so a group with a third of all rows costs one row per task. A row
then finds its group by both digests of its text.

Defined cases: a null text counts as empty (all empty texts are one group); a null id
loses every tie and stays only where its group has no other; repeated rows are
members of their group like any others; an empty table gives an empty result; other columns are
ignored by ``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import fresh, whole

WHITE_SPACE = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c)), WHITE_SPACE, text)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_of) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(whole(text_col)).alias("n"),
                       normalised(whole(text_col)).alias("norm"))
    return rows.select("doc_id", "n", "norm", hash_of(F.col("norm")).alias("h"))


def _groups(keyed: DataFrame) -> DataFrame:
    """One row per distinct normalised text: digests, the id that stays, the number of rows."""
    # longest text first, then smallest id, as one number: keeps the aggregate a hash aggregate
    order = (F.col("n").cast("decimal(10,0)") * F.lit(Decimal(10) ** 20)
             - F.coalesce("doc_id", F.lit(LAST_ID)).cast("decimal(20,0)"))
    return (
        keyed.groupBy("h", "norm")
        .agg(F.max_by("doc_id", order).alias("keep_id"), F.max("n").alias("keep_n"),
             F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "keep_n", "group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_of=content_hash) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_col, text_col, hash_of)
    light = keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return (
        light.join(_groups(keyed), ["h", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                "text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_of=content_hash) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows one stays."""
    keys = h, sha, key, n = fresh(docs, "__h", "__sha", "__id", "__n")
    norm = normalised(whole(text_col))
    named = docs.withColumns({h: hash_of(norm), sha: F.sha2(norm, 256), n: F.length(whole(text_col)),
                              key: F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))})
    keep = _groups(_keyed(docs, id_col, text_col, hash_of)).select(
        F.col("h").alias(h), F.col("text_sha256").alias(sha),
        F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias(key), F.col("keep_n").alias(n))
    return named.dropDuplicates(keys).join(keep, keys, "left_semi").drop(*keys)
