"""Bias ratings from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.skew import numbered

COLUMNS = ["url", "bias_rating", "factual_reporting_rating"]
MISSING_COLUMN = "N/A"


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``row_no, url, bias_rating, factual_reporting_rating``.

    A column the file lacks reads as 'N/A'; empty cells stay null. ``row_no``
    is the file's own column when it has one, otherwise the row's place, from 0, over all files by path. It does not depend on
    how the files are split: rows are numbered inside their split, and splits by where they begin.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([
        T.StructField(c, T.LongType() if c == "row_no" else T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    if "row_no" not in header:
        split = F.struct("_metadata.file_path", "_metadata.file_block_start")
        placed = raw.select("*", F.monotonically_increasing_id().alias("_at"), split.alias("_split"))
        raw = numbered(placed, [], ["_at"], F.col("_split"), "row_no").withColumn("row_no", F.col("row_no").cast("long"))
    return raw.select("row_no", *[
        F.col(c) if c in header else F.lit(MISSING_COLUMN).alias(c) for c in COLUMNS])
