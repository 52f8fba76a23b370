import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import vectors as vx
from attesta.operators import neighbours as nb
from attesta.operators import quality as ql
from attesta.operators import retrieval
from attesta.operators.similar_sets import _meeting, prefixes
from tests.conftest import values


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [
    ("The lake is deep.", ql.CHECKWORTHY), ("The roof is green.", ql.CHECKWORTHY),
    ("I can whistle all my songs backwards.", ql.PERSONAL), ("Rye bread goes better with butter.", ql.OPINION),
    ("Is the lake deep?", ql.NOT_A_CLAIM), ("Please close the gate.", ql.NOT_A_CLAIM), ("", ql.NOT_A_CLAIM)])
def test_checkworthiness(spark, text, want):
    assert one(spark, text, ql.checkworthiness) == want


@pytest.mark.parametrize("claims, want", [
    (["- a.", "- b."], ["a", "b"]), (["- a", "b"], ["- a", "b"]), (["The text x", "The text y"], ["x", "y"]),
    (["The a.", "The b"], ["a.", "b"]), ([], []), ([" a ", " "], ["a"])])
def test_clean_claims(spark, claims, want):
    assert one(spark, claims, ql.clean_claims, "array<string>") == want


def test_all_satisfy_is_true_on_nothing(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int")
    everyone = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert values(ql.all_satisfy(rows, everyone, "k", "ok", F.col("v") < 2), "k", "ok") == [(1, False), (2, True), (3, True)]


def test_chrf_bounds(spark):
    df = spark.createDataFrame([("same text", "same text"), ("abc", "xyz"), ("", "abc"), ("aab", "ab")], "h string, r string")
    got = [r["s"] for r in df.select(ql.chrf("h", "r").alias("s")).collect()]
    assert got[:3] == [1.0, 0.0, 0.0]
    p, r = (2 / 3 + 1 / 2) / 2, (2 / 2 + 1 / 1) / 2
    assert got[3] == pytest.approx(5 * p * r / (4 * p + r), abs=1e-6)


def test_chrf_counts_many_pairs_at_once(spark, monkeypatch):
    """Slices of any size give what counting each pair's n-grams gives."""
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("aab é\n\U0001f600") for _ in range(rng.choice((0, 1, 3, 5, 9, 40)))) for _ in "hr") for _ in range(200)]

    def brute(h, r):
        h, r = (re.sub(r"[ \n]+", "", t) for t in (h, r))
        p, q = [], []
        for n in range(1, 7):
            a, b = (Counter(t[i:i + n] for i in range(len(t) - n + 1)) for t in (h, r))
            if a and b:
                p.append((a & b).total() / a.total())
                q.append((a & b).total() / b.total())
        p, q = (sum(x) / max(1, len(x)) for x in (p, q))
        return 5 * p * q / (4 * p + q) if p else 0.0

    want = [brute(*pair) for pair in pairs]
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)] + [(200, None, "a")], "i int, h string, r string")
    got = values(df.select("i", ql.chrf("h", "r").alias("s")), "s", "i")
    assert [s for s, i in sorted(got, key=lambda x: x[1])] == pytest.approx([*want, 0.0], abs=1e-6)
    bare = [[re.sub(r"[ \n]+", "", t) for t in side] for side in zip(*pairs)]
    for size in (1, 7, 100):
        monkeypatch.setattr(ql, "CHRF_CHARS", size)
        assert list(ql._gram_scores(*bare, 6, 2.0)) == pytest.approx(want)
    assert list(ql._gram_scores([], [], 6, 2.0)) == [] and list(ql._gram_scores([""], [""], 6, 2.0)) == [0.0]


def test_sets_that_share_one_word_do_not_meet(spark):
    """A shared rare token alone makes no pair of long sets, and tokens of one set are not kept."""
    rows = [(i, ["a", *[f"w{i}-{j}" for j in range(9)]]) for i in range(20)] + [(20, ["b", *[f"v{j}" for j in range(9)]]), (21, ["c", *[f"v{j}" for j in range(9)]])]
    first = prefixes(spark.createDataFrame(rows, "id long, toks array<string>"), 0.7)
    assert first.filter("id < 20").select("token").distinct().count() <= 1
    assert values(_meeting(first, first, 0.7), "a", "b") == [(20, 21)]


def test_unique_and_near_claims(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, " ".join(words).upper() + "!"), (3, " ".join(words[:19] + ["other"])), (4, "short and different")]
    df = spark.createDataFrame(rows, "id int, claim string")
    assert values(ql.unique_claims(df, ["id"], "claim"), "id", "n_copies") == [(1, 2), (3, 1), (4, 1)]
    near = values(ql.near_unique(df, ["id"], "claim"), "id", "repeats_id", "jaccard")
    assert near == [(3, 1, round(19 / 21, 6))]


def test_near_claims_are_complete_and_point_at_kept_ones(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    claims = [" ".join(rng.sample(words, rng.randint(3, 9))) for _ in range(150)]
    family = [f"x{i}" for i in range(14)]
    claims += [" ".join(rng.sample(family, 13)) + f" y{i % 5}" for i in range(60)] + ["", "w1 w1"]
    df = spark.createDataFrame(list(enumerate(claims)), "id int, claim string")
    sets = {i: frozenset(c.split()) for i, c in enumerate(claims) if c}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) >= 0.7 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    first = {}
    for i, c in enumerate(claims):
        first.setdefault(c, i)
    want = sorted((i, root[i], round(len(sets[i] & sets[root[i]]) / len(sets[i] | sets[root[i]]), 6)) for c, i in first.items() if c and root[i] != i)
    got = values(ql.near_unique(df, ["id"], "claim"), "id", "repeats_id", "jaccard")
    assert got == want and not {r[1] for r in got} & {r[0] for r in got}


def test_criteria_shares(spark):
    df = spark.createDataFrame([(1, "The text says it works"), (1, "Ann runs and Bob sits")], "a int, c string")
    row = ql.criteria(df, "a", "c").first()
    assert (row["n_claims"], row["joined_share"], row["pronoun_share"], row["reporting_share"]) == (2, 0.5, 0.5, 0.5)


def brute_knn(vectors, k, groups=None):
    out = []
    for i, v in enumerate(vectors):
        d = [(round(float(((v - w) ** 2).sum()), 6), j) for j, w in enumerate(vectors)
             if j != i and (groups is None or groups[i] == groups[j])]
        out += [(i, j, dist, r + 1) for r, (dist, j) in enumerate(sorted(d)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1000, 1000), (7, 5), (3, 100)])
def test_tiled_neighbours_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((40, 6)).round(3)
    vectors[5] = vectors[6] = vectors[7]
    groups = [0 if i % 3 else i % 2 for i in range(40)]          # one group holds most rows
    rows = spark.createDataFrame([(i, groups[i], [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "vec_id long, label int, vector array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    cols = ("query_id", "vec_id", "dist", "dist_rank")
    q, v = blocks
    overall = nb.nearest_vectors(asked.drop("label"), rows.drop("label"), 4, skip_self=True, query_block=q, vector_block=v)
    assert values(overall, *cols) == brute_knn(vectors, 4)
    inside = nb.nearest_vectors(asked, rows, 3, on=("label",), skip_self=True, query_block=q, vector_block=v)
    assert values(inside, *cols) == brute_knn(vectors, 3, groups)


def test_projection_search_is_a_subset_with_exact_distances(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 8)).round(3)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    near = nb.nearest_by_projection(asked, rows, 5, dims=8, tables=10, bits=2, skip_self=True)
    exact = nb.nearest_vectors(asked, rows, 5, skip_self=True)
    row = nb.recall(near, exact).first()
    assert row["n_exact"] == 300 and row["recall"] > 0.8
    for q, v, d in values(near, "query_id", "vec_id", "dist"):
        assert d == pytest.approx(((vectors[q] - vectors[v]) ** 2).sum(), abs=1e-5)


def test_hashed_text_has_unit_length(spark):
    got = one(spark, "a b a c", vx.hashed_text)
    assert sum(g["value"] ** 2 for g in got) == pytest.approx(1, abs=1e-5)
    assert one(spark, "", vx.hashed_text) == []
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(vx.squared_l2(df.a, df.b).alias("d")).first()["d"] == 5.0


def test_fusion_and_comparison(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, doc_id int, search_rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, doc_id int, search_rank int")
    fused = retrieval.reciprocal_rank_fusion(a, b, ["q"], "doc_id", k=2)
    assert values(fused, "fused_rank", "doc_id") == [(1, 11), (2, 10)]
    row = retrieval.compare(a, b, ["q"], "doc_id").first()
    assert (row["common"], row["jaccard"]) == (1, 0.333333)


def test_entity_filter_keeps_hits_that_share_a_name(spark):
    claims = spark.createDataFrame([(1, 0, "Later on Ada Lovelace wrote notes")], "article_id long, claim_id int, claim string")
    docs = spark.createDataFrame([(7, "Once more Ada Lovelace spoke. End."), (8, "Ada opened. Nobody else Came.")], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 0, 7, 1), (1, 0, 8, 2)], "article_id long, claim_id int, doc_id long, search_rank int")
    assert values(retrieval.entity_filter(hits, claims, docs, ["article_id", "claim_id"]), "doc_id") == [(7,)]


def test_rerank_orders_by_closest_sentence(spark):
    rows = [(1, 1, 10, 0.5), (1, 1, 10, 0.2), (1, 2, 11, 0.1), (1, 3, 12, 0.2)]
    pairs = spark.createDataFrame(rows, "q int, search_rank int, doc_id int, dist double")
    assert values(retrieval.rerank(pairs, ["q"]), "new_rank", "doc_id") == [(1, 11), (2, 10), (3, 12)]
