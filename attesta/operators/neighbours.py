"""Exact and approximate nearest neighbours of dense vectors, in bounded tiles.

Queries and vectors are cut into blocks by id hash. One task compares one
query block with one vector block in numpy and returns only the k nearest per
query, so neither a pair table nor a broadcast exists, and a group (source,
bucket) of any size becomes as many tiles as it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from attesta.functions.vectors import projection_buckets

QUERY_BLOCK = 20_000
VECTOR_BLOCK = 20_000
STRIP = 128             # query rows per distance matrix inside a task
PROBE = 4_096           # vectors whose distances give a first bound of the k-th
LOOSE = 32              # a bound is made anew if it leaves this many times k vectors
PAIRS = 100_000         # exact distances that are computed at once


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as rows of doubles."""
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), -1)


class Rough:
    """Squared distances to some vectors in single precision, all by one matrix product.

    They are scaled and lack the query's own square, so they compare only within a query. What is lower than another by more than
    the margin that comes with them (two errors and ``near``, in the units of the vectors) is nearer.
    """

    def __init__(self, base: np.ndarray):
        fine = np.isfinite(base).all(axis=1)
        self.mean = base[fine].mean(axis=0) if fine.any() else np.zeros(base.shape[1])
        moved = base - self.mean
        self.scale = float(np.abs(moved[fine]).max(initial=0.0)) or 1.0
        moved = (moved / self.scale).astype(np.float32)
        squares = (moved * moved).sum(axis=1)
        self.longest = float(np.sqrt(squares[fine].max(initial=0.0)))
        self.base = np.ascontiguousarray(np.c_[-2.0 * moved, squares].T, dtype=np.float32)

    def __call__(self, queries: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        moved = ((queries - self.mean) / self.scale).astype(np.float32)
        far = np.sqrt((moved.astype(np.float64) ** 2).sum(axis=1, keepdims=True)) + self.longest
        margin = 4 * (moved.shape[1] + 4) * float(np.finfo(np.float32).eps) * far * far + near / self.scale**2
        return np.c_[moved, np.ones(len(moved), np.float32)] @ self.base, margin


def _same(qids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids in the queries and in ascending ``ids``."""
    first, last = np.searchsorted(ids, qids), np.searchsorted(ids, qids, side="right")
    n = np.where(qids == qids, last - first, 0)
    row = np.repeat(np.arange(len(qids)), n)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(n) - n), n)


def _tile_nearest(queries: pa.Table, vectors: pa.Table, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k nearest rows of ``vectors`` for each of ``queries``, as places in both and distances; ties to the lower id."""
    ids, qids = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, base, asked = ids[order], matrix(vectors.column("vector"))[order], matrix(queries.column("vector"))
    base_sq, rough = (base * base).sum(axis=1), Rough(base)
    out = []
    take = min(k + skip_self, len(ids))
    step = max(1, len(ids) // max(PROBE, take))
    for lo in range(0, len(qids), STRIP):
        q = asked[lo:lo + STRIP]
        guess, margin = rough(q, 2e-6)
        if skip_self:
            guess[_same(qids[lo:lo + STRIP], ids)] = np.inf
        # what the k-th of some vectors rules out need not be compared exactly
        some = np.ascontiguousarray(guess[:, ::step])
        for part in (some, guess):
            kth = np.partition(part, take - 1, axis=1)[:, take - 1:take]
            left = guess <= np.where(kth < np.inf, kth + margin, np.finfo(np.float32).max).astype(np.float32)
            if step == 1 or np.count_nonzero(left) <= LOOSE * take * len(q):
                break
        row, at = np.divmod(np.flatnonzero(left), len(ids))
        near = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            r, c = row[i:i + PAIRS], at[i:i + PAIRS]
            near[i:i + PAIRS] = np.maximum((q * q).sum(axis=1)[r] + base_sq[c] - 2.0 * np.einsum("ij,ij->i", q[r], base[c]), 0.0)
        near = np.round(near, 6)
        # ids are ascending, so (distance, position) order is (distance, id) order
        by = np.lexsort((at, near, row))
        row, at, near = row[by], at[by], near[by]
        kept = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(near)
        out.append((row[kept] + lo, order[at[kept]], near[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, on: tuple[str, ...] = (),
                    skip_self: bool = False, query_block: int = QUERY_BLOCK,
                    vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """``query_id, on..., vec_id, dist, dist_rank``: the k nearest by squared L2.

    ``on`` restricts neighbours to the same group. Block counts come from the
    group sizes, so every tile is bounded by the two block sizes.
    """
    keys = list(on)
    one = F.lit(1)

    def sizes(df: DataFrame, block: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(one) / block).cast("int").alias(name))

    q_parts, v_parts = sizes(queries, query_block, "_qn"), sizes(vectors, vector_block, "_vn")
    if keys:
        parts = q_parts.join(v_parts, keys)
        lhs, rhs = queries.join(parts, keys), vectors.join(parts, keys)
    else:
        qn, vn = q_parts.first()["_qn"], v_parts.first()["_vn"]
        lhs = queries.withColumn("_qn", F.lit(qn)).withColumn("_vn", F.lit(vn))
        rhs = vectors.withColumn("_qn", F.lit(qn)).withColumn("_vn", F.lit(vn))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    tile = [*keys, "_qb", "_vb"]
    lhs = (lhs.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_qn")).cast("int"))
           .withColumn("_vb", every("_vn")).select(*[F.col(c).alias(c) for c in (*tile, "query_id", "vector")]))
    rhs = (rhs.withColumn("_vb", F.pmod(F.xxhash64("vec_id"), F.col("_vn")).cast("int"))
           .withColumn("_qb", every("_qn")).select(*[F.col(c).alias(c) for c in (*tile, "vec_id", "vector")]))
    group_fields = [queries.schema[c] for c in keys]
    schema = T.StructType([*group_fields, T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("vec_id", vectors.schema["vec_id"].dataType),
                           T.StructField("dist", T.DoubleType())])

    def run(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        if q.num_rows == 0 or v.num_rows == 0:
            return pa.table({**{c: q.column(c)[:0] if c in q.column_names else v.column(c)[:0] for c in keys},
                             "query_id": q.column("query_id")[:0], "vec_id": v.column("vec_id")[:0], "dist": pa.array([], pa.float64())})
        row, at, dist = _tile_nearest(q, v, k, skip_self)
        near = q.select([*keys, "query_id"]).take(pa.array(row))
        return near.append_column("vec_id", v.column("vec_id").take(pa.array(at))).append_column("dist", pa.array(dist))

    best = lhs.groupBy(*tile).cogroup(rhs.groupBy(*tile)).applyInArrow(run, schema)
    ranked = W.partitionBy("query_id", *keys).orderBy("dist", "vec_id")
    return best.withColumn("dist_rank", F.row_number().over(ranked)).filter(F.col("dist_rank") <= k)


def nearest_by_projection(queries: DataFrame, vectors: DataFrame, k: int, dims: int, tables: int = 16,
                          bits: int = 4, skip_self: bool = False) -> DataFrame:
    """Approximate k nearest: only vectors sharing a projection bucket are compared.

    A bucket holding much of the data is cut into tiles like any group, so it
    costs more tasks, not one long one. Recall has to be measured against the
    exact form (see ``recall``).
    """
    def bucketed(df: DataFrame, ident: str) -> DataFrame:
        return df.select(ident, "vector", F.posexplode(
            projection_buckets("vector", dims, tables, bits)).alias("table", "bucket"))

    found = nearest_vectors(bucketed(queries, "query_id"), bucketed(vectors, "vec_id"), k,
                            on=("table", "bucket"), skip_self=skip_self)
    ranked = W.partitionBy("query_id").orderBy("dist", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("dist").alias("dist"))
        .withColumn("dist_rank", F.row_number().over(ranked)).filter(F.col("dist_rank") <= k)
    )


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact neighbours, how many the approximate result has, their share."""
    marked = exact.select("query_id", "vec_id").join(
        approximate.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return marked.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"),
                      F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
