import random

import pytest

from attesta.llm import shingles, sketch_join


def sets_of(rows):
    out = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed, n=220):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(400))
    passage = [word() for _ in range(30)]
    rows, bases = [], [[word() for _ in range(draw.choice([1, 3, 4, 5, 6, 8, 12, 30, 60, 200]))] for _ in range(25)]
    for k in range(n):
        w = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            at = draw.randrange(len(w) + 1)
            draw.choice([lambda: w.insert(at, word()), lambda: w.pop(min(at, len(w) - 1)) if len(w) > 1 else None, lambda: w.extend(w[:3])])()
        if k % 3 == 0:
            at = draw.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((k, draw.choice([" ", "\n"]).join(w).upper() if k % 7 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("group", [32, 3])
def test_components_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(sketch_join, "GROUP", group)
    for seed in (1, 2):
        rows = corpus(seed)
        got = sketch_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_family_with_texts_just_below_the_threshold(spark, monkeypatch):
    """Most link to one centre; the rest share only frequent words with them, and some link among themselves or by a bridge."""
    monkeypatch.setattr(sketch_join, "GROUP", 4)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in draw.sample(range(80), draw.choice([0, 1, 1, 2, 3, 4])):
            w[at] = f"x{draw.randrange(10**6)}"
        if k % 5 == 0:
            w = w[:draw.choice([56, 62, 66, 72])]
        rows.append((k, " ".join(w)))
    got = sketch_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sketch_join.near_components(odd_docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)
    kept = sketch_join.drop_near(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "None", "None", "7", "9"])
    assert sketch_join.near_components(no_docs).count() == sketch_join.drop_near(no_docs).count() == 0


def test_linked_sets_meet_in_a_band():
    for a in range(1, 400):
        for b in range(a, a * 4 // 3 + 1):
            assert {k for k, _, _ in sketch_join.keys_of(a)} & {k for k, _, _ in sketch_join.keys_of(b)}


def test_differing_sketch_words_never_exceed_the_symmetric_difference():
    draw = random.Random(8)
    for _ in range(200):
        a = {draw.randrange(2**64) for _ in range(draw.randrange(40, 300))}
        b = set(draw.sample(sorted(a), len(a) - draw.randrange(10))) | {draw.randrange(2**64) for _ in range(draw.randrange(10))}
        x, y = (set(sketch_join.sketch(shingles.np.array(sorted(s), shingles.np.uint64), 17, 300).tolist()) for s in (a, b))
        assert max(len(x - y), len(y - x)) <= len(a ^ b)


def test_rows_are_dropped_by_id_and_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a + " end"), (5, "quite another text that equals nothing else here"), (None, b), (None, b + " end"), (7, a), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in sketch_join.drop_near(docs).collect()]
    assert sorted(x for x in kept if x[0]) == sorted([(1, a), (1, a), rows[2]])
    assert len([x for x in kept if x[0] is None]) == 1


def test_words_that_fall_together_when_sent_count_once():
    words = shingles.np.array([5, 5 | 1 << 45, 7 | 1 << 63], shingles.np.uint64)
    assert [sketch_join.sent_words(words, bits) for bits in (0, 1, 23)] == [2, 2, 3 if (1 << 45) >> 41 else 2]
    found = shingles.np.unique(shingles.np.random.default_rng(1).integers(0, 2**63, 300, dtype=shingles.np.uint64))
    assert sketch_join.fine_slack(found, 4) == len(found) - len(found) // 4 - 1
