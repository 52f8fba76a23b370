import re

from pyspark.sql import functions as F

from attesta.llm import exact_dedup


def brute(rows):
    norm = [(i, len(t or ""), re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    out = []
    for i, _, t in norm:
        group = [(j, n) for j, n, u in norm if u == t]
        keep = min(group, key=lambda g: (-g[1], g[0] is None, g[0] or 0))[0]
        out.append((i, keep, len(group), i == keep))
    return out


def plain(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_groups_match_brute_force(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert plain(exact_dedup.exact_groups(odd_docs)) == sorted(brute(rows), key=str)


def test_colliding_hashes_stay_apart(odd_docs):
    def same(text):
        return F.lit(b"x")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert plain(exact_dedup.exact_groups(odd_docs, hash_of=same)) == sorted(brute(rows), key=str)


def test_one_row_of_each_group_is_kept_whole(odd_docs, no_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([3, 6, None, 7, 8, 9], key=str)
    assert [r.text for r in kept.filter("doc_id = 3").collect()] == ["The  same text\there for all of us\nto read"]
    assert exact_dedup.drop_copies(no_docs).count() == exact_dedup.exact_groups(no_docs).count() == 0


def test_empty_texts_keep_the_longest_then_the_smallest_id(spark):
    docs = spark.createDataFrame([(5, ""), (4, None), (8, ""), (None, None)], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_groups(docs).collect()} == {4}
    assert exact_dedup.drop_copies(docs).count() == 1
