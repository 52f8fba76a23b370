import math
import random
import re
from collections import Counter

import pytest

from attesta.operators import search
from tests.conftest import values

KEYS = ["article_id", "claim_id"]


def tok(s):
    return [t for t in re.split(r"[\W_]+", s.lower()) if t]


def brute(docs, queries, k, scheme, share):
    toks = {d: tok(t) for d, t in docs}
    df = Counter(t for ts in toks.values() for t in set(ts))
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = []
    for a, c, text in queries:
        terms = set(tok(text))
        scored = []
        for d, ts in toks.items():
            tf, score, hit = Counter(ts), 0.0, False
            for t in terms:
                if not tf[t] or (share is not None and df[t] > share * n):
                    continue
                hit = True
                if scheme == "overlap":
                    score += 1 / len(terms)
                else:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    score += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / avg))
            if hit:
                scored.append((-round(score, 6), d))
        out += [(a, c, r + 1, d, round(-s, 5)) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed, n_docs=80, n_queries=12, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n_docs)]
    docs += [(1000 - i, docs[i % 3][1].upper()) for i in range(30)]         # many copies of three documents
    queries = [(i // 3, i % 3, " ".join(rng.choices(words, weights, k=rng.randint(1, 9)))) for i in range(n_queries)]
    queries += [(50 + i, 0, queries[1][2]) for i in range(8)]                # copies of one query
    return docs, queries + [(90, 0, ""), (91, 0, "unseen words")]


@pytest.mark.parametrize("scheme, share", [("bm25", 0.2), ("bm25", None), ("overlap", None)])
@pytest.mark.parametrize("tile, block, hot", [(2048, 512, 200_000), (7, 3, 3), (3, 20, 10)])
def test_search_equals_brute_force(spark, monkeypatch, scheme, share, tile, block, hot):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "HOT_QUERIES", hot)
    monkeypatch.setattr(search, "DIRECT", 10**9 if tile == 2048 else 0)
    docs, queries = corpus(tile + (scheme == "overlap"))
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), tile=tile, shelf_tokens=300 if tile == 7 else 10**9)
    asked = spark.createDataFrame(queries, "article_id long, claim_id int, claim string")
    found = search.top_k_search(index, asked, KEYS, "claim", k=5, scheme=scheme, max_df_share=share)
    got = sorted((a, c, r, d, round(s, 5)) for a, c, r, d, s in values(found, *KEYS, "search_rank", "doc_id", "score"))
    assert got == brute(docs, queries, 5, scheme, share)


def test_pruning_falls_with_the_corpus_and_shelves_are_opened_by_term(spark, tmp_path, monkeypatch):
    """A query scores about as many documents whatever the corpus holds besides; a stored index opens again."""
    monkeypatch.setattr(search, "DIRECT", 0)
    rng = random.Random(9)
    shares = []
    for n in (300, 3000):
        docs = [(i, " ".join(["the", "of"] + rng.choices([f"w{j}" for j in range(n // 3)], k=20))) for i in range(n)]
        path = f"{tmp_path}/index-{n}"
        search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), path=path, tile=64, shelf_tokens=5_000)
        index = search.open_index(spark, path)
        queries = [(i, 0, " ".join(["the of"] + docs[i * 7][1].split()[2:8])) for i in range(20)]
        asked = search.identified(spark.createDataFrame(queries, "article_id long, claim_id int, claim string"), KEYS, "claim")
        pairs = search.scored_pairs(index, asked, 5).count()
        shares.append(pairs / (20 * n))
        found = search.top_k_search(index, spark.createDataFrame(queries, "article_id long, claim_id int, claim string"), KEYS, "claim", k=5)
        got = sorted((a, c, r, d, round(s, 5)) for a, c, r, d, s in values(found, *KEYS, "search_rank", "doc_id", "score"))
        assert got == brute(docs, queries, 5, "bm25", None)
    assert shares[1] < shares[0] / 3
    assert index.n_shelves > 10
    _, opened = index.shelved(spark.createDataFrame([("w1",)], "term string"))
    assert opened.select("shelf").distinct().count() == 1
