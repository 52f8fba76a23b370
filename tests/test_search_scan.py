import numpy as np
import pyarrow as pa
import pytest

from attesta.operators import search
from tests.conftest import values
from tests.test_search import KEYS, brute, corpus


def test_a_scan_shuffles_no_postings(spark, monkeypatch):
    """Parts and tiles of any size give the brute-force result, copies included, and nothing is inverted for it."""
    def never(*_):
        raise AssertionError("the inverted form was made")
    monkeypatch.setattr("attesta.operators.search_index._invert", never)
    for name, value in (("BLOCK", 3), ("BLOCKS", 2), ("PART_TOKENS", 300), ("WIDTH", 7)):
        monkeypatch.setattr(search, name, value)
    docs, queries = corpus(5)
    index = search.build_index(spark.createDataFrame(docs + [(5000, None)], "doc_id long, text string"))
    asked = spark.createDataFrame(queries, "article_id long, claim_id int, claim string")
    found = search.top_k_search(index, asked, KEYS, "claim", k=5, scheme="overlap")
    got = sorted((a, c, r, d, round(s, 5)) for a, c, r, d, s in values(found, *KEYS, "search_rank", "doc_id", "score"))
    assert got == brute(docs, queries, 5, "overlap", None)


def test_an_id_on_two_rows_is_found_once(spark):
    docs = [(1, "red fox"), (1, "red fox"), (2, "red hen"), (3, "blue hen")]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame([(0, 0, "red fox")], "article_id long, claim_id int, claim string")
    found = search.top_k_search(index, asked, KEYS, "claim", k=5, scheme="overlap")
    assert values(found, "doc_id", "search_rank") == [(1, 1), (2, 2)]


@pytest.mark.parametrize("common, slice_, entries", [(128, 256, 2**18), (4, 2, 5), (0, 3, 1), (10**9, 1, 7)])
def test_common_and_rare_terms_add_up(monkeypatch, common, slice_, entries):
    """Whichever terms go through products and however they are cut, a score is the sum over the terms that query and document share."""
    for name, value in (("COMMON", common), ("SLICE", slice_), ("ENTRIES", entries)):
        monkeypatch.setattr(search, name, value)
    rng, n, width, terms = np.random.default_rng(1), 9, 40, 30
    asks = rng.random((n, terms)) < np.linspace(0.05, 0.9, terms)
    holds = rng.random((terms, width)) < np.linspace(0.02, 0.95, terms)[:, None]
    weight, gains = rng.random((n, terms)) * asks, rng.random((terms, width)) * holds
    row, pos = np.nonzero(holds)
    col, who = np.nonzero(asks.T)
    p, q = np.r_[0, np.cumsum(holds.sum(1))], np.r_[0, np.cumsum(asks.sum(0))]
    got = search._summed(p[:-1], p[1:], q[:-1], q[1:], pos, gains[row, pos], who, weight[who, col], n, width)
    assert np.allclose(got, weight @ gains, atol=1e-12)


def test_no_term_is_met():
    none = np.zeros(0, np.int64)
    assert not search._summed(none, none, none, none, none, np.zeros(0), none, np.zeros(0), 2, 3).any()


def test_documents_are_repeated_for_no_row_of_queries(spark, monkeypatch):
    """Parts and rows of queries meet as a product: neither is written again for each of the other."""
    for name, value in (("BLOCK", 3), ("BLOCKS", 2), ("PART_TOKENS", 300)):
        monkeypatch.setattr(search, name, value)
    docs, queries = corpus(5)
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(queries, "article_id long, claim_id int, claim string")
    plan = search.top_k_search(index, asked, KEYS, "claim", k=5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroups" not in plan


@pytest.mark.parametrize("tokens, width", [(1, 3), (7, 2), (10**6, 2048)])
def test_best_of_parts_in_any_order(tokens, width):
    """The best are kept over parts whose ids lie in any order; ties go to the lower id, by its fields."""
    rng, k = np.random.default_rng(3), 3
    kind = pa.struct([("a", pa.int64()), ("b", pa.int32())])
    ids = [{"a": int(a), "b": int(b)} for a, b in rng.permutation([(a, b) for a in range(8) for b in range(5)])]
    terms = [sorted({f"t{x}" for x in rng.integers(0, 4, 3)}) for _ in ids]
    docs = pa.table({"doc_id": pa.array(ids, kind), "dl": pa.array([len(t) for t in terms], pa.int32()), "term": terms,
                     "tf": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))})
    asks = {(0, 0): ["t0", "t1"], (0, 1): ["t3"], (5, 0): ["t2", "zz"], (5, 1): ["t0", "t1", "t2"]}
    rows = [{"_super": 0, "_block": b, "term": t, "_qn": [q for (c, q), ts in asks.items() if c == b and t in ts]}
            for b in (5, 0) for t in sorted({t for (c, _), ts in asks.items() if c == b for t in ts})]
    given = pa.table({"_super": pa.array([0] * len(rows), pa.int32()), "_block": [r["_block"] for r in rows], "term": [r["term"] for r in rows],
                      "_qn": pa.array([r["_qn"] for r in rows], pa.list_(pa.int32())), "weight": [[1.0] * len(r["_qn"]) for r in rows]})
    held = search._Asked(search._packed_queries(given).column("asked")[0], k, kind)
    for part in search._packed_parts(tokens, width)(docs.to_batches()):
        held.meet(part.column("part")[0], lambda tf, dl: np.ones(len(tf)), width)
    got = sorted((r["_block"], r["_qn"], -r["score"], r["doc_id"]["a"], r["doc_id"]["b"]) for r in held.found().to_pylist())
    want = []
    for (block, q), ts in asks.items():
        scored = sorted((-float(len(set(ts) & set(t))), d["a"], d["b"]) for d, t in zip(ids, terms) if set(ts) & set(t))
        want += [(block, q, *s) for s in scored[:k]]
    assert got == sorted(want)


def test_only_asked_terms_leave_the_postings(spark):
    """What joins the queries are the postings of their terms, not the whole corpus."""
    index = search.build_index(spark.createDataFrame(corpus(5)[0], "doc_id long, text string"), tile=7)
    _, opened = index.shelved(spark.createDataFrame([("w1",), ("w2",), ("w1",), ("unseen",)], "term string"))
    assert values(opened.select("term").distinct(), "term") == [("w1",), ("w2",)]
    assert opened.count() == index.postings.filter("term IN ('w1', 'w2')").count()
