import random
import re
from collections import Counter, defaultdict

import pytest

from attesta.llm import divergence


def brute(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for lang, source, text in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=str.encode)

        def shares(counted):
            total = sum(counted[t] for t in kept)
            return [1 + 10**9 * (counted[t] + 2) // (total + 2 * len(kept)) for t in kept]
        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [(-((a - b) ** 2 // (a + b)), t) for t, a, b in zip(kept, p[s], whole) if counts[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, ordinal string")
    got = [tuple(r) for r in divergence.audit(docs, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé漢", k=rng.randint(1, 5))) for _ in range(60)] + ["The", "THE", "the"]
    return [(rng.choice(["en", "de", None, "en", "xx"]), rng.choice(["s1", "s2", "S2", None, "é"]),
             rng.choice([None, "", "12 34 _", " ".join(rng.choices(words, k=30)), "-".join(rng.choices(words, k=40))])) for _ in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"part_bytes": 40, "pass_bytes": 1}])
def test_as_brute_force(spark, bounds):
    rows = texts(260, 4) + [("solo", "only", "ünique words")] * 12 + [("none", "a", "x"), ("none", "b", "y"), ("none", "b", "y")]
    assert audited(spark, rows, **bounds) == brute(rows)


def test_many_sources_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    rows = [("en", f"s{rng.randint(0, 12)}", " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=6))) for _ in range(150)]
    assert audited(spark, rows) == brute(rows)


def test_transducer_is_minimal_and_ordered():
    made = divergence.Builder()
    terms = sorted(w.encode() for w in ["tap", "taps", "top", "tops", "é", "éa", "stops", "a"])
    for t in terms:
        made.add(t)
    made.end_language("en")
    row = made.row(b"")
    part = divergence.Part(*[divergence.np.frombuffer(row[k], t) for k, t in (("keys", "int64"), ("targets", "int32"), ("outputs", "int32"), ("final", "bool"))],
                           {r["lang"]: (r["root"], 0, r["n"]) for r in row["roots"]})
    root = part.roots["en"][0]
    assert [part.spell(root, i).encode() for i in range(len(terms))] == terms
    futures = {}
    for state, final in enumerate(part.final):
        low, high = divergence.np.searchsorted(part.keys, [state << 8, (state + 1) << 8])
        futures.setdefault((bool(final), tuple(zip(part.keys[low:high] & 255, part.targets[low:high]))), []).append(state)
    assert all(len(s) == 1 for s in futures.values())  # no two states with one future
    data = divergence.np.frombuffer(b"tops tip", divergence.np.uint8)
    at = divergence.np.array([0, 5]), divergence.np.array([4, 3])
    assert part.walk(data, *at, divergence.np.array([root, root])).tolist() == [terms.index(b"tops"), -1]


def test_empty_and_odd_tables(spark, odd_docs, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert audited(spark, rows, min_docs=2) == brute(rows, min_docs=2)
