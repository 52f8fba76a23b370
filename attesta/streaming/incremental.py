"""Incremental runs: new articles against a fixed index, new pages into the claim store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from attesta.config import VerifyConfig
from attesta.flows import verify
from attesta.operators import search
from attesta.operators import sites as st
from attesta.sources import claim_store as cs
from attesta.sources import pages as pg

VERDICT_COLUMNS = ["article_id", "claim_id", "claim", "verdict", "source_url", "source_claim"]


def run_name(checkpoint: str) -> str:
    """A stream keeps its name as long as it keeps its checkpoint; batch numbers start again with a new one."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()


def verify_stream(spark: SparkSession, article_dir: str, schema: StructType, sources: DataFrame,
                  index: search.SearchIndex, sink: str, checkpoint: str,
                  config: VerifyConfig = VerifyConfig(), files_per_batch: int = 1000):
    """Verify each new article file once; verdicts land in ``sink/run=<checkpoint>/batch=<n>``.

    A batch that is run again after a failure overwrites its own folder, so
    every claim gets exactly one verdict. Returns the running query.
    """
    name = run_name(checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        done = verify(batch, sources, config, index=index).verdicts
        done.select(*VERDICT_COLUMNS).write.mode("overwrite").parquet(f"{sink}/run={name}/batch={batch_id}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(article_dir)
    return (
        arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def store_stream(spark: SparkSession, page_dir: str, schema: StructType, suffixes: DataFrame, store: str,
                 checkpoint: str, repeated: DataFrame, lateness: str = "30 minutes",
                 files_per_batch: int = 1000):
    """Put each page's claims into the store once.

    ``repeated`` is the boilerplate table of the corpus so far: one batch
    alone does not show what a host repeats.

    Repeats that arrive within ``lateness`` are dropped by URL in the stream
    state; later ones by an anti join with what is stored.
    """
    name = run_name(checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        # only the store's files that may hold one of the batch's URLs are opened
        known = cs.of_urls(spark, store, batch).filter(f"run <> '{name}' OR batch <> {batch_id}").select("url")
        new = cs.missing(batch, known)
        content = pg.main_content(new, repeated=repeated).filter("text <> ''")
        cs.append(cs.claims_of(content, st.registrable_domains(new, suffixes)), store, batch_id, name)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(page_dir)
    return (
        arriving.withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["url"])
        .writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
