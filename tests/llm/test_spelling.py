import random
import re
import zlib
from collections import Counter

import pytest

from attesta.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(counts, factor=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def found(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = [tuple(r) for r in spelling.variants(words, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("group,bucket", [(2_000, 8_000), (3, 40)])
def test_all_near_words(spark, group, bucket):
    rng = random.Random(7)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(400)} | {"aaaaaa", "aaaaaaa", "aaaaab", "b" * 300, "b" * 301, "a" + "b" * 299}
    words |= {"shared" + w for w in list(words)[:150]}  # a beginning that many words share
    counts = {w: rng.choice([5, 6, 30, 200, 1_500]) for w in sorted(words)}
    assert found(spark, counts, group=group, bucket=bucket) == brute(counts)


def test_pieces_stay_small_where_a_beginning_is_shared(spark, monkeypatch):
    counts = {"common" + "".join(c): 5 for c in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 9)] * 3)}
    assert found(spark, counts, group=2, bucket=5) == brute(counts)


def test_vocabulary(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["Wörterbuch", "spelling", "SPELLING", "the", "naïveté×", "longer-words", "Ünder_score7s", "漢字"], k=200)) for _ in range(60)] + [None, "", "x" * 9]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    want = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{i if i % 7 else ''}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 19 == 0 else run] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs, every=19).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert len(got) > 5


def test_empty_and_odd_tables(spark, odd_docs, no_docs):
    assert spelling.variants(spelling.vocabulary(no_docs)).count() == 0
    assert spelling.variants(spelling.vocabulary(odd_docs, min_n=1)).count() == spelling.vocabulary(odd_docs, min_n=1).count()
