import random
import re

from attesta.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(size, len(v))
            grams = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1 if v else 0):
                if tuple(w[s:s + n]) in grams:
                    hit.update(range(s, s + n))
                    found.add(str(item))
        out[i, text] = (len(w), len(hit), sorted(found))
    return out


def test_hits_match_brute_force(spark):
    draw = random.Random(3)
    vocabulary = ["alpha", "BETA", "gamma7", "été", "x", "the"]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 3, 9, 10, 14, 30])))) for k in range(25)] + [(99, None), (98, items_text := "the " * 12)]
    docs = []
    for k in range(60):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(50))]
        if k % 2:
            base += (draw.choice(items)[1] or "").split() + base[:5]
        docs.append((k, draw.choice([" ", ", ", "-"]).join(base)))
    docs += [(100, None), (101, ""), (None, items_text), (102, items_text), (102, items_text)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert len(rows) == len(docs)
    want = brute(docs, items)
    seen = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in rows)
    assert seen == sorted((str(i), *want[i, t]) for i, t in docs)


def test_without_broadcast_and_empty_sides(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same text here for all"), (2, None)], "item_id long, text string")
    for limit in (0, 10):
        kept = decontaminate.decontaminate(odd_docs, items, broadcast_rows=limit)
        assert kept.columns == odd_docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "6", "None", "None", "7", "8", "9"])
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontaminate.decontaminate(no_docs, items).count() == decontaminate.contamination(no_docs, items).count() == 0


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep, this One two THREE! and this."), (2, "one TWO three"), (3, "nothing"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, mode="spans").collect()}
    assert got == {1: "Keep, this! and this.", 2: "", 3: "nothing", 4: None}
