from attesta.llm import shards


def test_each_row_once_and_slots_without_gaps(spark, odd_docs, no_docs):
    many = odd_docs.unionByName(spark.range(500).selectExpr("id + 100 AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text"), allowMissingColumns=True)
    done = shards.shard(many, shards=7, bucket_bytes=2000)
    rows = done.collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in many.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((r.text or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(7))
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in shards.shard(many.repartition(5), shards=7, bucket_bytes=2000).collect()}
    first = {(r.doc_id, r.text): (r.shard, r.slot) for r in rows}
    same = [k for k in first if k[0] is not None and k[0] >= 100]
    assert all(first[k] == again[k] for k in same)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id]
    assert order != sorted(order)
    assert shards.shard(no_docs).count() == 0


def test_written_shards_are_read_back(spark, odd_docs, tmp_path):
    shards.write_shards(odd_docs, str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()
