"""Nearest source claims by vector: a plugged encoder, or hashed token counts.

Sentences are encoded in Arrow batches and packed into tiles of one source each. A row joins a tile with a block of the claims
that hit its source, and one numpy call keeps the k nearest of every claim in it; the tiles of a source are merged last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from attesta.functions import text as tx
from attesta.functions import vectors as vx
from attesta.operators.evidence import CLAIM
from attesta.operators.skew import hot_keys

WIDTH = 64          # of the hashed vectors
DIGITS = 6
Encoder = Callable[[Iterator[pd.Series]], Iterator[np.ndarray]]


def hashed(text) -> Column:
    """Token counts in ``WIDTH`` hash buckets, of unit length (zeros without tokens)."""
    def unit(buckets: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
        return tx.let(counts, lambda c: tx.let(
            F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
    return tx.let(F.transform(tx.tokens(text), lambda t: F.pmod(vx.hashed_bucket(t), F.lit(WIDTH)).cast("int")), unit)


def encoded(rows: DataFrame, text: str, encoder: Encoder | None = None) -> DataFrame:
    """``rows`` with ``vector``. ``encoder`` gets an iterator of text series and yields one matrix for each; it can load its
    model once, before the loop. Without one the vectors are hashed."""
    if encoder is None:
        return rows.withColumn("vector", hashed(text))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for matrix in encoder(batches):
            yield pd.Series([list(map(float, row)) for row in matrix])
    return rows.withColumn("vector", run(F.coalesce(F.col(text), F.lit(""))))


def nearest(hits: DataFrame, claims: DataFrame, source_claims: DataFrame, encoder: Encoder | None = None, key: str = "doc_id",
            k: int = 5, tile_rows: int = 256, hot_key_rows: int = 1_000) -> DataFrame:
    """The k nearest of ``source_claims(key, source_claim_id, source_claim)`` per (claim, source) by squared distance.

    Output: claim key, ``search_rank``, key, ``source_claim_id``, ``dist``, ``dist_rank``. Ties go to the lower source claim id.
    ``hits`` is read more than once: pass a staged table.
    """
    hot = hot_keys(hits, [key], hot_key_rows)
    wanted = source_claims.join(hits.select(key).distinct(), key, "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("source_claim_id", "vector")))
    tiles = encoded(wanted, "source_claim", encoder).groupBy(key, F.floor(F.col("source_claim_id") / tile_rows).alias("tile")).agg(listed.alias("rows"))
    block = F.pmod(F.xxhash64(*CLAIM), F.coalesce("_parts", F.lit(1))).cast("int").alias("_block")
    asked = hits.join(encoded(claims.select(*CLAIM, "claim"), "claim", encoder), CLAIM).join(hot, key, "left")
    blocks = asked.groupBy(key, block).agg(F.collect_list(F.struct(*CLAIM, "search_rank", "vector")).alias("askers"))
    dealt = tiles.join(hot, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    rows = dealt.join(blocks, [key, "_block"]).select(
        key, F.transform("rows", lambda r: r["source_claim_id"]).alias("ids"), F.transform("rows", lambda r: r["vector"]).alias("tile"),
        F.transform("askers", lambda a: F.struct(*[a[c].alias(c) for c in (*CLAIM, "search_rank")])).alias("who"),
        F.transform("askers", lambda a: a["vector"]).alias("asked"))
    found = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("source_claim_id", T.LongType()), T.StructField("dist", T.DoubleType())])
    schema = T.StructType([rows.schema[key], rows.schema["who"], T.StructField("found", T.ArrayType(found))])
    near = rows.mapInArrow(_tile_nearest(key, k), schema).select(key, "who", F.explode("found").alias("f"))
    by_hit = W.partitionBy(*CLAIM, "search_rank", key).orderBy("dist", "source_claim_id")
    return (near.select(key, F.get("who", F.col("f.at")).alias("w"), "f.source_claim_id", "f.dist").select("w.*", key, "source_claim_id", "dist")
            .withColumn("dist_rank", F.row_number().over(by_hit)).filter(F.col("dist_rank") <= k)
            .select(*CLAIM, "search_rank", key, F.col("source_claim_id").cast("int").alias("source_claim_id"), "dist", "dist_rank"))


def _tile_nearest(key: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 16) for b in batches for at in range(0, len(b), 16)):
            out = []
            for ids, tile, asked in zip(*(batch.column(c) for c in ("ids", "tile", "asked"))):
                x, q = _matrix(tile), _matrix(asked)
                ids = ids.values.to_numpy(zero_copy_only=False)
                dist = np.round(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2.0 * q @ x.T, 0.0), DIGITS)
                best = np.argsort(dist, axis=1, kind="stable")[:, :k]       # ids ascend, so ties go to the lower one
                out.append([{"at": i, "source_claim_id": int(ids[j]), "dist": float(dist[i, j])} for i in range(len(q)) for j in best[i]])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("source_claim_id", pa.int64()), ("dist", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("who"), pa.array(out, kind)], names=[key, "who", "found"])
    return run


def _matrix(vectors: pa.ListScalar) -> np.ndarray:
    return vectors.values.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors.values), -1)
