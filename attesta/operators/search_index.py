"""The stored search index: tokenised corpus with document frequencies, written once and opened again; inverted when asked to be.

A document is one row with its distinct terms and their counts, which is all that a scan needs (see ``search``). The inverted form is made from it
at the first search that prunes by bounds, and kept. In it copies are kept once: documents with the same tokens are one document with a count.
Documents are dealt into tiles of about ``TILE``; a posting row holds one term's entries in one tile, so a frequent term is many rows. Each row and
each term carries the highest gain any of its entries can have, which is what a search prunes by. Postings lie in shelves, folders
by hash of the term, so a search opens only the folders of its own terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from attesta.functions import text as tx
from attesta.operators.staging import stage, stage_path

TILE = 2048                     # documents of a tile
SHELF_TOKENS = 100_000_000      # tokens of the corpus to a shelf
SHELVES = 4096                  # shelves at most
SHELF_PARTS = 4                 # files of a shelf
K1, B = 1.2, 0.75               # the gains stored are bounds for these


@dataclass(frozen=True)
class SearchIndex:
    """Tables of an index.

    ``forward``: ``doc_id, dl, digest, terms array<struct<term, tf>>``;
    ``terms``: ``term, df`` with copies counted. Made when first read:
    ``groups``: the lowest ``doc_id`` of each distinct token sequence, its
    ``digest``, number of copies ``n``, ``tile`` and ``pos`` (by id in the tile);
    ``postings``: ``shelf, term, tile, posts array<struct<pos, tf, dl>>``;
    ``bounds``: ``term, df``, ``n`` documents without copies, ``top`` gain.
    """

    path: str
    forward: DataFrame
    terms: DataFrame
    n_docs: int
    n_groups: int
    n_tiles: int
    n_shelves: int
    avg_len: float
    has_copies: bool
    repeated: bool          # ids that stand for more than one row: searched by the inverted form, where an id is found once

    @property
    def groups(self) -> DataFrame:
        return self._inverted("groups")

    @property
    def postings(self) -> DataFrame:
        return _postings(self.forward.sparkSession, self.path, self._inverted("groups"))

    @property
    def bounds(self) -> DataFrame:
        return self._inverted("bounds")

    def _inverted(self, name: str) -> DataFrame:
        """A table of the inverted form; ``bounds`` is written last, so where it lies the others do."""
        spark = self.forward.sparkSession
        try:
            spark.read.parquet(f"{self.path}/bounds")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            _invert(self)
        return spark.read.parquet(f"{self.path}/{name}")

    def shelved(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``terms`` with their shelf, and the postings of these terms only.

        The distinct terms are written, so Spark knows their size and can drop other terms' postings before any is shuffled.
        """
        placed = terms.withColumn("shelf", shelf_of("term", self.n_shelves))
        asked, postings = stage(placed.select("shelf", "term").distinct(), "asked-terms"), self.postings
        if self.n_shelves > 1:
            opened = [r["shelf"] for r in asked.select("shelf").distinct().collect()]  # SHELVES numbers at most
            postings = postings.filter(F.col("shelf").isin(opened))
        return placed, postings.join(asked.select("term"), "term", "left_semi")


def dealt(key: str, rows: int, size: int) -> Column:
    """A block number by hash, so that blocks hold about ``size`` rows."""
    return F.pmod(F.xxhash64(F.lit("deal"), key), F.lit(max(1, -(-rows // size))))


def shelf_of(term: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shelf"), term), F.lit(n)).cast("int")


def bm25_gain(tf: Column, dl: Column, avg_len: float, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avg_len))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, tile: int = TILE,
                shelf_tokens: int = SHELF_TOKENS) -> SearchIndex:
    """Tokenise every document once and write the index (to ``path``, to be opened again, or to the checkpoint folder)."""
    spark, toks = docs.sparkSession, F.col("_toks")
    path = path or stage_path(spark, "index")
    cut = docs.select(F.col(doc_id).alias("doc_id"), tx.tokens(text).alias("_toks")).select(
        "doc_id", F.md5(F.array_join(toks, " ")).alias("digest"), "_toks")
    kinds = T.StructType([cut.schema["doc_id"], T.StructField("dl", T.IntegerType()), T.StructField("digest", T.StringType()),
                          T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])))])
    cut.mapInArrow(_counted, kinds).write.parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    distinct = forward.groupBy("digest", "dl").agg(F.count(F.lit(1)).alias("n"))
    sizes = distinct.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dl")).alias("len"),
                         F.max("n").alias("top")).first()
    n_docs, total = sizes["n"] or 0, sizes["len"] or 0
    repeated = not forward.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()
    facts = {"n_docs": n_docs, "n_groups": sizes["groups"], "n_tiles": max(1, -(-sizes["groups"] // tile)),
             "n_shelves": min(SHELVES, max(1, -(-total // shelf_tokens)))}
    rest = {"avg_len": total / n_docs if total else 1.0, "has_copies": (sizes["top"] or 0) > 1, "repeated": repeated}
    if repeated:
        bounds = SearchIndex(path, forward, forward, **facts, **rest).bounds
        bounds.select("term", "df").write.parquet(f"{path}/terms")
    else:
        (forward.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
         .write.parquet(f"{path}/terms"))
    spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in facts.items()], *[F.lit(v).alias(c) for c, v in rest.items()]).coalesce(
        1).write.parquet(f"{path}/facts")
    return open_index(spark, path)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number of tokens, and its distinct ones in order with their counts."""
    for batch in (b.slice(at, 1_000) for b in batches for at in range(0, len(b), 1_000)):
        toks = batch.column("_toks")
        sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
        coded = toks.flatten().dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        width = max(1, len(by_name))
        held, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + place[coded.indices.to_numpy()], return_counts=True)
        ends = np.cumsum(np.bincount(held // width, minlength=len(sizes)))
        terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(by_name[held % width])), pa.array(tf, pa.int32())], names=["term", "tf"])
        offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[toks.is_null().to_numpy(zero_copy_only=False), False])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.list_value_length(toks), batch.column("digest"), pa.ListArray.from_arrays(offsets, terms)],
            names=["doc_id", "dl", "digest", "terms"])


def _invert(index: SearchIndex) -> None:
    """Write ``groups``, ``postings`` and ``bounds`` from the documents."""
    spark, path, n_shelves = index.forward.sparkSession, index.path, index.n_shelves
    distinct = stage(
        index.forward.groupBy("digest", "dl").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "copies")
    in_tile = W.partitionBy("tile").orderBy("doc_id")
    (distinct.select("doc_id", "digest", "n", F.pmod(F.xxhash64(F.lit("deal"), "digest"), F.lit(index.n_tiles)).alias("tile"))
     .withColumn("pos", F.row_number().over(in_tile) - 1).write.mode("overwrite").parquet(f"{path}/groups"))
    groups = spark.read.parquet(f"{path}/groups")
    entries = (index.forward.select("doc_id", "dl", "terms").join(groups.select("doc_id", "n", "tile", "pos"), "doc_id")
               .select("tile", "pos", "dl", "n", F.inline("terms")))
    rows = entries.groupBy("term", "tile").agg(
        F.sum("n").alias("copies"), F.max(bm25_gain(F.col("tf"), F.col("dl"), index.avg_len)).alias("top"),
        F.collect_list(F.struct("pos", "tf", "dl")).alias("posts"))
    if n_shelves > 1:
        rows = rows.withColumn("shelf", shelf_of("term", n_shelves))
        rows = rows.repartition(n_shelves * SHELF_PARTS, "shelf", F.pmod(F.xxhash64("term", "tile"), F.lit(SHELF_PARTS)))
        rows.sortWithinPartitions("shelf", "term", "tile").write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/postings")
    else:
        rows.write.mode("overwrite").parquet(f"{path}/postings/shelf=0")
    (_postings(spark, path, groups).groupBy("term").agg(F.sum("copies").alias("df"), F.sum(F.size("posts")).alias("n"), F.max("top").alias("top"))
     .write.mode("overwrite").parquet(f"{path}/bounds"))


def _postings(spark: SparkSession, path: str, groups: DataFrame) -> DataFrame:
    kinds = groups.schema
    schema = (f"term string, tile {kinds['tile'].dataType.simpleString()}, copies long, top double, "
              f"posts array<struct<pos: int, tf: int, dl: int>>, shelf int")
    return spark.read.schema(schema).parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """An index written before."""
    facts = spark.read.parquet(f"{path}/facts").first().asDict()
    return SearchIndex(path, spark.read.parquet(f"{path}/forward"), spark.read.parquet(f"{path}/terms"), **facts)
