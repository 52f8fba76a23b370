import numpy as np

from attesta.llm import quality_net
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


def test_scores_held_out_rows_well_and_calibrated(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_net.score(docs, quality_net.fit(docs, labels)).withColumn("held_out", quality_net.held_out()).join(labels, "doc_id")
    rows = scored.filter("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad).mean() > 0.95
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    assert right > 0.95 and abs(np.mean([r.score - r.quality for r in rows])) < 0.1


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality_net.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_net.fit(docs, x, sample=100) for x in (labels, flipped))
    assert all(np.array_equal(p, q) for p, q in zip(a, b))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 0), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    for learned in (labels, labels.filter("quality = 1"), labels.limit(0)):
        model = quality_net.fit(odd_docs, learned)
        got = quality_net.score(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert quality_net.keep_good(odd_docs, model, 0.0).count() == len(got)
    assert quality_net.score(no_docs, model).count() == 0
