"""Vector columns: distances, text vectors, projection buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import text as tx

BUCKETS = 1024          # fixed width of the hashed text vectors


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision, summed left to right, 6 digits."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.round(F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d * d), 6)


def hashed_bucket(term: Column) -> Column:
    """First four hex digits of the term's md5, modulo the vector width."""
    return (F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def hashed_text(text) -> Column:
    """Sparse text vector ``array<struct<bucket, value>>``: hashed token counts, unit length."""
    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c["tf"] * c["tf"]))
        return tx.let(norm, lambda n: F.transform(counts, lambda c: F.struct(
            c["term"].alias("bucket"), F.round(c["tf"] / n, 6).alias("value"))))

    return tx.let(tx.term_counts(F.transform(tx.tokens(text), hashed_bucket)), unit)


def projection_buckets(vector, dims: int, tables: int, bits: int, seed: int = 7) -> Column:
    """One bucket per table: signs of ``bits`` seeded random projections."""
    planes = np.random.default_rng(seed).standard_normal((dims, tables * bits))
    powers = 1 << np.arange(bits)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
                continue
            signs = (np.stack(batch.to_numpy()).astype(np.float64) @ planes) > 0
            codes = (signs.reshape(len(batch), tables, bits) * powers).sum(axis=2)
            yield pd.Series(list(codes.astype(np.int32)))

    return run(tx.col(vector))
