"""Shuffled shards in two passes: scatter rows into memory-sized buckets by a seeded hash, then shuffle each bucket.

Pass one counts rows and bytes per bucket (the number of buckets follows the total of bytes). Pass two brings
a bucket together, puts it in an order that does not depend on arrival, draws a Fisher-Yates permutation seeded by
the bucket, and writes the rows. A row's place in the whole is its bucket's offset plus its place in it; shard s holds
an equal run of places, so shard sizes differ by one row at most (law ``rows``). Seeds and order are fixed, so a bucket computed
again after a lost executor gives the same rows in the same places.

The hash covers id and text, so neither one id with many texts nor many copies of one text fill a bucket.

Defined cases: a null text has no bytes and stays null; a null id is a value like others; repeated rows each get a
place of their own; fewer rows than shards leave shards empty; an empty table gives no rows; further columns are written
along, columns named ``shard``, ``slot``, ``size`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from attesta.llm.words import fresh, whole
from attesta.operators.staging import stage

SHARDS = 24
BUCKET_BYTES = 16 << 20
ADDED = ["size", "shard", "slot"]


def _shuffle(seed: int, names: tuple[str, str, str]) -> Callable[[pa.Table], pa.Table]:
    bucket, digest, place = names

    def run(table: pa.Table) -> pa.Table:
        """One bucket in its random order, with places from 0."""
        table = table.sort_by([(digest, "ascending"), ("size", "ascending")])
        n = len(table)
        drawn = np.random.default_rng([seed, table.column(bucket)[0].as_py()]).random(n)
        order = np.arange(n)
        for i in range(n - 1, 0, -1):  # Fisher-Yates
            j = int(drawn[i] * (i + 1))
            order[i], order[j] = order[j], order[i]
        return table.take(pa.array(order)).append_column(place, pa.array(np.arange(n, dtype=np.int64)))
    return run


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 11, bucket_bytes: int = BUCKET_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot (gapless from 0 in each shard), written once in the order of the places."""
    rows = docs.drop(*ADDED)
    bucket, digest, place, before = fresh(rows, "__bucket", "__hash", "__place", "__before")
    size = F.octet_length(whole(text_col)).cast("long") + 8
    total = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    named = rows.withColumns({
        "size": size, digest: F.xxhash64(F.col(id_col), F.col(text_col)),
        bucket: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(buckets)).cast("int")})
    counts = named.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    counts = stage(counts.select(bucket, "n", F.coalesce(ahead, F.lit(0)).cast("long").alias(before)), "bucket-sizes")
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    schema = T.StructType([*named.schema.fields, T.StructField(place, T.LongType())])
    done = stage(named.groupBy(bucket).applyInArrow(_shuffle(seed, (bucket, digest, place)), schema), "buckets")
    # place p of n rows lies in shard floor(p * shards / n), whose first place is ceil(shard * n / shards)
    at = f"(`{before}` + `{place}`)"
    return (
        done.join(counts.drop("n"), bucket)
        .withColumn("shard", F.expr(f"CAST({at} * {shards} DIV {max(1, n_rows)} AS INT)"))
        .withColumn("slot", F.expr(f"{at} - (shard * {n_rows}L + {shards - 1}) DIV {shards}"))
        .drop(digest, bucket, place, before)
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write one folder per shard; rows carry their slot."""
    shard(docs, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
