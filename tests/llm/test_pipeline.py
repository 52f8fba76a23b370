import corpus_pipeline
from attesta.llm import decontaminate, exact_dedup, sketch_join

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), name)
        assert docs.columns == columns and docs.count() < before
        before = docs.count()
    assert exact_dedup.exact_groups(docs).filter("not kept").count() == 0
    assert sketch_join.near_components(docs).filter("doc_id <> component_id").count() == 0
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.contamination(docs, items).filter("size(spans) > 0").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == before


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, step in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), name)
    assert docs.count() == 5
