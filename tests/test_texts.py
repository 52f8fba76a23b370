import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import context as cx
from attesta.operators import requests as rq
from attesta.operators import segment as sg
from attesta.operators import skew
from tests.conftest import values


def split_like_a_splitter(text, size, overlap, seps=("\n\n", "\n", " ")):
    """Plain restatement: pieces carry their separator; pack greedily; back up over whole pieces."""
    def pieces(t, sep):
        cut, out = t.split(sep), []
        for i, p in enumerate(cut):
            p = p if i == 0 else sep + p
            if p:
                out.append(p)
        return out

    def pack(parts):
        out, cur = [], []
        for p in parts:
            if cur and sum(map(len, cur)) + len(p) > size:
                out.append("".join(cur))
                while cur and (sum(map(len, cur)) > overlap or sum(map(len, cur)) + len(p) > size):
                    cur.pop(0)
            cur.append(p)
        return out + (["".join(cur)] if cur else [])

    def run(t, left):
        if not left:
            step, out, at = size - overlap, [], 0
            while True:
                out.append(t[at:at + size])
                if at + size >= len(t):
                    return out
                at += step
        out, good = [], []
        for p in pieces(t, left[0]):
            if len(p) < size:
                good.append(p)
            else:
                out += pack(good) + run(p, left[1:])
                good = []
        return out + pack(good)

    ws = " \t\n\r\f\x0b"
    return [c.strip(ws) for c in run(text, seps) if c.strip(ws)]


@pytest.mark.parametrize("size, overlap", [(20, 0), (20, 8), (7, 3), (50, 10)])
def test_chunks_equal_plain_restatement(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    texts = ["", "   ", "x" * 100, "ab " * 40, "line one\nline two\n\npara two " + "y" * 30 + " end"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "bb", "cccc", "d" * 12, " ", "\n", "\n\n", " ", "e" * 25])
                             for _ in range(rng.randint(1, 60))).replace("\n\n\n", "\n\n"))
    texts = [t for t in texts if "\n\n\n" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["c"] for r in df.select("id", sg.chunks(F.col("text"), size, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == split_like_a_splitter(t, size, overlap), repr(t)


def test_word_windows_have_no_tail_of_overlap(spark):
    def cut(n):
        df = spark.createDataFrame([(" ".join(map(str, range(n))),)], "text string")
        return [len(c.split()) for c in df.select(sg.word_windows(F.col("text"), 200, 50).alias("c")).first()["c"]]
    assert cut(0) == [] and cut(10) == [10] and cut(200) == [200] and cut(201) == [200, 51] and cut(350) == [200, 200]


def test_claims_keep_chunk_and_dense_positions(spark):
    text = "One fact. Two facts.\n\nThird fact here. Fourth one."
    df = spark.createDataFrame([(1, text), (2, " ")], "doc_id long, text string")
    got = values(sg.claims_with_chunks(df, ["doc_id"], size=30, overlap=0), "doc_id", "claim_id", "chunk_id", "claim")
    assert [g[1] for g in got] == [0, 1, 2, 3] and [g[3] for g in got] == ["One fact.", "Two facts.", "Third fact here.", "Fourth one."]
    assert {g[0] for g in got} == {1} and [g[2] for g in got] == [0, 0, 1, 1]


def test_plugged_extractor_numbers_across_blocks(spark):
    def extractor(batches):
        for chunks in batches:
            yield [[f"{c}-{j}" for j in range(2)] for c in chunks]

    rows = [(1, i, f"c{i:03d}") for i in range(600)] + [(2, 0, " "), (2, 1, "z")]
    df = spark.createDataFrame(rows, "article_id long, chunk_id int, chunk string")
    got = sg.extracted_claims(df, ["article_id"], extractor)
    assert values(got.filter("article_id = 1"), "claim_id", "claim") == [(2 * i + j, f"c{i:03d}-{j}") for i in range(600) for j in range(2)]
    assert values(got.filter("article_id = 2"), "claim_id", "claim") == [(0, "z-0"), (1, "z-1")]


@pytest.mark.parametrize("block", [2, 3, 100])
def test_claim_context_does_not_depend_on_blocks(spark, block):
    n = 17
    df = spark.createDataFrame([(1, i, f"<{i}>") for i in range(n)] + [(2, 0, "x")], "a int, claim_id int, claim string")
    got = {(r[0], r[1]): r[2:] for r in values(cx.claim_context(df, ["a"], block=block), "a", "claim_id", "before", "after")}
    for i in range(n):
        assert got[(1, i)] == ("".join(f"<{j}>" for j in range(max(0, i - 5), i)), f"<{i + 1}>" if i + 1 < n else "")
    assert got[(2, 0)] == ("", "") and len(got) == n + 1


@pytest.mark.parametrize("n", [1, 4, 5, 6, 10, 11, 12])
def test_excerpt_marks(spark, n):
    sentences = [f"S{i}." for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(sentences))], "doc_id int, text string")
    got = dict(values(cx.excerpts(df, ["doc_id"], "text"), "i", "excerpt"))
    for i in range(n):
        want = (["[...]"] + sentences[i - 5:i] if i >= 5 else sentences[:i]) + [sentences[i]]
        want += sentences[i + 1:] if i > n - 5 else sentences[i + 1:i + 6] + ["[...]"]
        assert got[i] == "\n".join(want)


def test_rewrites_feed_later_contexts(spark):
    df = spark.createDataFrame([(1, ["Ada Lovelace wrote.", "She slept.", "it ran."])], "a int, claims array<string>")
    assert cx.rewrite_in_order(df).first()["rewritten"] == ["Ada Lovelace wrote.", "Ada Lovelace slept.", "Ada Lovelace ran."]
    seen = cx.rewrite_in_order(df, rewriter=lambda before, text, after: f"[{len(before)}|{len(after)}]").first()["rewritten"]
    assert seen == ["[0|10]", "[6|7]", "[11|0]"]


def test_numbered_is_dense_with_many_blocks(spark):
    df = spark.createDataFrame([(k, i * 3) for k in (1, 2) for i in range(50)], "k int, at int")
    got = values(skew.numbered(df, ["k"], ["at"], F.floor(F.col("at") / 20), "n"), "k", "n", "at")
    assert got == sorted((k, i, i * 3) for k in (1, 2) for i in range(50))


# ---- replies ---------------------------------------------------------------------------

def parse_one(spark, kind, reply, sentence="Original."):
    replies = spark.createDataFrame([("r", kind, 0, "old"), ("r", kind, 1, reply)],
                                    "request_id string, kind string, received_no int, reply string")
    asked = spark.createDataFrame([("r", sentence)], "request_id string, sentence string")
    row = rq.parse(replies, asked).first()
    return row["outcome"], row["claims"]


@pytest.mark.parametrize("kind, reply, want", [
    ("marked", "<s>\n- a\n- b\n</s>\n<s>\n- c\n</s>", ("claims", ["a", "b", "c"])),
    ("marked", "nothing marked", (None, [])),
    ("json", '{"claims": ["x", "y"]}', ("claims", ["x", "y"])), ("json", '{"claims": []}', ("No verifiable claims", [])),
    ("json", "1. Los Angeles\n2. x", (None, [])), ("json", '{"other": 1}', (None, [])), ("json", '{"claims": ["x", null]}', (None, [])),
    ("fenced", 'Sure: ```old``` and ```{"claims": ["z"]}', ("claims", ["z"])), ("fenced", '```{"claims": ["z"]}```', (None, [])),
    ("selection", "Final submission:\nContains a specific and verifiable proposition\n\nSentence with only verifiable information:\nNew one.\n---",
     ("rewritten", ["New one."])),
    ("selection", "Final submission:\nContains\n\nSentence with only verifiable information:\nremains unchanged", ("kept", ["Original."])),
    ("selection", "Final submission:\nDoes NOT\n\nSentence with only verifiable information:\nNone\n---", ("No verifiable claims", [])),
    ("selection", "free text", (None, [])),
    ("disambiguation", "x\nDecontextualizedSentence: In 2010, John Smith led.", ("rewritten", ["In 2010, John Smith led."])),
    ("disambiguation", "DecontextualizedSentence: Cannot be decontextualized", ("Cannot be disambiguated", [])),
    ("disambiguation", "no header", (None, []))])
def test_reply_formats(spark, kind, reply, want):
    assert parse_one(spark, kind, reply) == want


def test_requests_are_rendered_once_and_deduplicated(spark):
    row = spark.createDataFrame([("{sentence}", "b")], "headline string, sentence string").select(
        rq.render("H {headline} S {sentence} {other}", headline="headline", sentence="sentence").alias("p")).first()
    assert row["p"] == "H {sentence} S b {other}"
    asked = spark.createDataFrame([("k", "p1"), ("k", "p1"), ("k", "p2"), ("j", "p1")], "kind string, prompt string")
    made = rq.build_requests(asked)
    assert values(made, "kind", "prompt") == [("j", "p1"), ("k", "p1"), ("k", "p2")]
    assert values(rq.build_requests(asked, made.filter("kind = 'k'")), "kind", "prompt") == [("j", "p1")]


def test_grade_gate(spark):
    rows = [("a", '{"accuracy":10,"clarity":7,"completeness":7,"conciseness":8}'), ("b", '{"accuracy":10,"clarity":6,"completeness":7,"conciseness":8}'),
            ("c", '{"accuracy":10,"clarity":7,"completeness":7}'), ("d", '{"accuracy":11,"clarity":7,"completeness":7,"conciseness":8}'), ("e", "?")]
    got = dict(values(rq.graded(spark.createDataFrame(rows, "id string, reply string")), "id", "passed"))
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}



def test_entity_groups_join_neighbours(spark):
    text = "We met Ada Lovelace. Then Ada Lovelace left. It rained in Rome. In old Rome it was wet."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert values(sg.entity_groups(df, ["doc_id"]), "i", "group_id") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_clause_and_discourse_cuts(spark):
    df = spark.createDataFrame([("It rained. However, we left because it ended; all went home, and he slept.",)], "text string")
    row = df.select(sg.discourse_pieces(F.col("text")).alias("d"), sg.clause_claims(F.col("text"), 2).alias("c")).first()
    assert row["d"] == ["It rained.", "However we left", "because it ended; all went home, and he slept."]
    assert row["c"] == ["It rained.", "However, we left because it ended", "all went home", "he slept."]


def test_batch_rewriter_equals_the_walk_with_few_calls(spark, tmp_path):
    lists = [[f"a{i}" for i in range(7)], [], ["b0"], None, ["c0", "c1", "c2"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(lists)], "id int, claims array<string>").coalesce(1)
    log = str(tmp_path / "calls")

    def one(before, text, after):
        return f"{text}<{before[-9:]}|{after}>"

    def many(befores, texts, afters):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [one(*row) for row in zip(befores, texts, afters)]
    walked = {r.id: r.rewritten for r in cx.rewrite_in_order(df, rewriter=one).collect()}
    together = {r.id: r.rewritten for r in cx.rewrite_in_order(df, batch_rewriter=many).collect()}
    assert walked == together and len(walked[0]) == 7
    with open(log) as f:
        assert f.read().split() == ["3", "2", "2", "1", "1", "1", "1"]


def test_runs_are_numbered_in_one_pass(spark):
    long = " ".join(f"{'Anna Bell went' if i % 5 else 'It rained on'} day{i}." for i in range(3000))
    df = spark.createDataFrame([(1, long), (2, ""), (3, "One. two.")], "doc_id int, text string")
    groups = sg.entity_groups(df, ["doc_id"]).filter("doc_id = 1").orderBy("i").collect()
    assert [r.i for r in groups] == list(range(3000)) and groups[-1].group_id > 500
    segments = sg.topic_segments(df, ["doc_id"])
    assert segments.filter("doc_id = 1").count() == 3000 and segments.filter("doc_id = 3").count() == 2
