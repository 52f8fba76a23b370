"""Stored source claims, so later runs process only sources they have not seen.

The store is a folder of data files and a manifest. A commit writes its files first and then one manifest folder with its number, which makes
it visible; a commit whose number is taken fails, so one of two writers that meet has to try again. The manifest has, for every
file, the lowest and highest URL and bitmaps of the hashes of its URLs, so a lookup opens only files that may hold
what it asks for. Compaction rewrites the files that are in use as few sorted ones in a commit of its own. Earlier
snapshots stay readable: files are never changed.

A source without claims is stored as well, as one row without a claim, and so is not processed again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from attesta.functions import text as tx

BUCKETS = 64            # parts that a store's domains are dealt into
FILE_ROWS = 2_000_000   # rows of a compacted file
SLOTS = 16              # bitmaps of a file, at most
BITS = 32_768           # bits of a bitmap

ROWS = T.StructType([
    T.StructField("domain", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("claim_id", T.IntegerType()), T.StructField("claim", T.StringType()),
    T.StructField("run", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("made", T.LongType()),
])
STORE = T.StructType([*ROWS.fields, T.StructField("bucket", T.IntegerType())])
MANIFEST = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("file", T.StringType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("low", T.StringType()), T.StructField("high", T.StringType()), T.StructField("slot", T.IntegerType()),
    T.StructField("bits", T.BinaryType()), T.StructField("run", T.StringType()), T.StructField("batch", T.LongType()),
    T.StructField("commit", T.LongType()),
])


def bucket_of(domain) -> Column:
    return F.pmod(F.xxhash64(tx.col(domain)), F.lit(BUCKETS)).cast("int")


def claims_of(content: DataFrame, domains: DataFrame) -> DataFrame:
    """``domain, url, claim_id, claim`` from pages with text."""
    return (
        content.select("url", F.posexplode(tx.sentences("text")).alias("claim_id", "claim"))
        .join(domains, "url").select("domain", "url", "claim_id", "claim")
    )


def manifest(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """Manifest rows up to a snapshot: ``file`` rows (one per bitmap), ``gone`` rows and one ``batch`` row per append."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], MANIFEST)
    return rows if snapshot is None else rows.filter(F.col("commit") <= snapshot)


def last_commit(spark: SparkSession, path: str) -> int:
    return manifest(spark, path).agg(F.max("commit")).first()[0] or 0


def _files(rows: DataFrame) -> DataFrame:
    """Bitmap rows of the files in use."""
    gone = rows.filter("kind = 'gone'").select("file")
    return rows.filter("kind = 'file'").join(gone, "file", "left_anti")


def _position() -> tuple[Column, Column]:
    h = F.xxhash64("url")
    return F.pmod(h, F.lit(SLOTS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(BITS))


def _commit(spark: SparkSession, path: str, data: str | None, extra: DataFrame, number: int) -> None:
    """Describe the files under ``data`` and make them visible."""
    rows = extra
    if data is not None:
        slot, bit = _position()
        written = spark.read.schema(STORE).parquet(data).select("url", "bucket", F.input_file_name().alias("file"), slot.alias("slot"), bit.alias("bit"))
        described = written.groupBy("file", "bucket", "slot").agg(
            F.min("url").alias("low"), F.max("url").alias("high"), F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
        rows = described.withColumn("kind", F.lit("file")).unionByName(extra, allowMissingColumns=True)
    names = [f.name for f in MANIFEST.fields if f.name != "commit"]
    missing = [F.lit(None).cast(MANIFEST[c].dataType).alias(c) for c in names if c not in rows.columns]
    rows.select("*", *missing).select(names).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/commit={number}")


def append(claims: DataFrame, path: str, batch: int = 0, run: str | None = None) -> None:
    """Add one batch of ``domain, url, claim_id, claim``. Writing the same batch of the same run again replaces it, so a
    retry adds nothing twice.

    Without a ``run`` every call is a run of its own and replaces nothing.
    """
    spark, run = claims.sparkSession, run or uuid.uuid4().hex
    number = last_commit(spark, path) + 1
    data = f"{path}/data/{number}-{uuid.uuid4().hex}"
    rows = claims.select(
        "domain", "url", F.col("claim_id").cast("int").alias("claim_id"), "claim", F.lit(run).alias("run"),
        F.lit(batch).cast("long").alias("batch"), F.lit(number).cast("long").alias("made"), bucket_of("domain").alias("bucket"))
    rows.sortWithinPartitions("bucket", "url").write.partitionBy("bucket").parquet(data)
    done = spark.range(1).select(F.lit("batch").alias("kind"), F.lit(run).alias("run"), F.lit(batch).cast("long").alias("batch"))
    try:
        _commit(spark, path, data, done, number)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        _commit(spark, path, None, done, number)    # a batch without rows wrote no file


def _read(spark: SparkSession, path: str, files: list[str], rows: DataFrame) -> DataFrame:
    """Rows of these files, without those of batches that were written again later."""
    if not files:
        return spark.createDataFrame([], STORE)
    found = spark.read.schema(ROWS).parquet(*files).withColumn("bucket", bucket_of("domain"))
    batches = rows.filter("kind = 'batch'").select("run", "batch", F.col("commit").alias("made"))
    newest = F.max("made").over(W.partitionBy("run", "batch"))
    old = batches.withColumn("newest", newest).filter("made < newest").select("run", "batch", "made")
    return found.join(old, ["run", "batch", "made"], "left_anti").select([f.name for f in STORE.fields])


def load(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """All claims of the store as of a commit (None: now); empty when nothing has been stored yet."""
    rows = manifest(spark, path, snapshot)
    files = [r["file"] for r in _files(rows).select("file").distinct().collect()]   # names, as Spark's own listing has them
    return _read(spark, path, files, rows).filter("claim_id IS NOT NULL")


def files_for(spark: SparkSession, path: str, urls: DataFrame) -> list[str]:
    """Files whose bounds and bitmaps admit one of ``urls``."""
    slot, bit = _position()
    asked = urls.select("url").distinct().select("url", slot.alias("slot"), bit.alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(_byte, cast(bit % 8 AS int)) % 2 = 1")
    met = (_files(manifest(spark, path)).join(asked, "slot").filter(F.col("url").between(F.col("low"), F.col("high")))
           .withColumn("_byte", byte).filter(set_))
    return [r["file"] for r in met.select("file").distinct().collect()]


def of_urls(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """Rows of some URLs, also the ones without a claim; other files are not opened."""
    rows = _read(spark, path, files_for(spark, path, urls), manifest(spark, path))
    return rows.join(urls.select("url").distinct(), "url", "left_semi")


def load_domains(spark: SparkSession, path: str, domains: DataFrame) -> DataFrame:
    """Claims of some domains; only files of their buckets are opened."""
    wanted = domains.select("domain").distinct()
    buckets = [r["b"] for r in wanted.select(bucket_of("domain").alias("b")).distinct().collect()]      # BUCKETS at most
    rows = manifest(spark, path)
    files = [r["file"] for r in _files(rows).filter(F.col("bucket").isin(buckets)).select("file").distinct().collect()]
    return _read(spark, path, files, rows).filter("claim_id IS NOT NULL").join(wanted, "domain", "left_semi")


def compact(spark: SparkSession, path: str, file_rows: int = FILE_ROWS) -> int:
    """Rewrite the files in use as one per bucket, or as many as ``file_rows`` asks for, sorted by URL; the number of files before."""
    rows = manifest(spark, path)
    files = [r["file"] for r in _files(rows).select("file").distinct().collect()]
    if not files:
        return 0
    number = last_commit(spark, path) + 1
    data = f"{path}/data/{number}-{uuid.uuid4().hex}"
    kept = _read(spark, path, files, rows)
    parts = max(1, -(-kept.count() // (BUCKETS * file_rows)))
    (kept.repartition(BUCKETS * parts, "bucket", F.pmod(F.xxhash64("url"), F.lit(parts)))
     .sortWithinPartitions("bucket", "url").write.partitionBy("bucket").parquet(data))
    gone = spark.createDataFrame([(f,) for f in files], "file string").withColumn("kind", F.lit("gone"))
    _commit(spark, path, data, gone, number)
    return len(files)


def missing(sources: DataFrame, store: DataFrame) -> DataFrame:
    """Sources whose URL the store does not hold."""
    return sources.join(store.select("url").distinct(), "url", "left_anti")


def first_per_domain(hits: DataFrame) -> DataFrame:
    """``domain, origin_url``: the best-ranked page stands for its whole domain."""
    return (
        hits.groupBy("domain").agg(F.min(F.struct("search_rank", "url")).alias("m"))
        .select("domain", F.col("m.url").alias("origin_url"))
    )


def by_domain(hits: DataFrame) -> DataFrame:
    """Hits with the page whose claims a domain-keyed store would use.

    The evidence is credited to the current ``url``; ``origin_url`` tells
    where its claims come from.
    """
    return hits.join(first_per_domain(hits), "domain")
