"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hot_keys(rows: DataFrame, keys: list[str], rows_per_part: int) -> DataFrame:
    """Keys with more than ``rows_per_part`` rows and the number of parts to cut them into.

    There are at most (rows / ``rows_per_part``) of them; how they are joined is left to Spark's size-checked choice.
    """
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_part)
        .select(*keys, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts"))
    )


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame,
                spread: list[str]) -> DataFrame:
    """Inner equi-join; rows of a hot key on the left are spread over salts.

    The salt is a hash of ``spread`` (never random, so a recomputed task gives
    the same rows), and only the right rows of hot keys are repeated.
    """
    lhs = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int"))
        .drop("_parts")
    )
    rhs = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(
            F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return lhs.join(rhs, [*keys, "_salt"]).drop("_salt")


def numbered(df: DataFrame, key: list[str], order: list[str], block_of: Column,
             name: str, start: int = 0) -> DataFrame:
    """Dense positions within ``key`` in ``order``, without one task per key.

    Rows are numbered inside blocks (``block_of`` must not decrease along
    ``order``); block sizes are summed per key, and only those sums are
    ordered in one place.
    """
    blocked = df.withColumn("_block", block_of)
    sizes = blocked.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    inside = W.partitionBy(*key, "_block").orderBy(*order)
    return (
        blocked.withColumn("_rn", F.row_number().over(inside))
        .join(offsets.drop("_size"), [*key, "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_rn") - 1 + start).cast("int"))
        .drop("_block", "_rn", "_offset")
    )


def with_halo(df: DataFrame, position: str, before: int, after: int, block: int) -> DataFrame:
    """Copy edge rows into neighbouring blocks so a short frame can be read per block.

    Adds ``_block`` and ``_home`` (the row's own block). A window partitioned
    by (key, ``_block``) then sees every row a frame of ``before``/``after``
    rows needs; keep only rows with ``_block = _home`` afterwards.
    """
    home = F.floor(F.col(position) / block)
    first = F.floor((F.col(position) - after) / block)
    last = F.floor((F.col(position) + before) / block)
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
