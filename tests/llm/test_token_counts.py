import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from attesta.llm import token_counts
from attesta.llm.queries import unigrams


def library(pieces, unk, by_bytes):
    found = Tokenizer(models.Unigram(pieces, unk_id=unk, byte_fallback=by_bytes))
    found.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return found


def texts(draw, parts, n):
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("scores", ["ties", "random"])
def test_small_vocabularies(scores):
    draw = random.Random(scores)
    for _ in range(30):
        names = sorted({"▁", *("".join(draw.choice("▁abc")[0] if i == 0 else draw.choice("abc") for i in range(draw.randrange(1, 5))) for _ in range(14))})
        pieces = [("<unk>", 0.0)] + [(n, float(-draw.randrange(1, 4)) if scores == "ties" else -draw.random() * 9) for n in names]
        reference, counter = library(pieces, 0, False), token_counts.WordCounter(pieces)
        for text in texts(draw, ["a", "b", "c", "d", "é", " ", "ab", "cab", "dd"], 40):
            assert token_counts.text_count(counter, text) == len(reference.encode(text).ids), (text, pieces)


def test_public_vocabulary():
    pieces = unigrams()
    reference, counter = library(pieces, 0, True), token_counts.WordCounter(pieces)
    draw = random.Random(1)
    for text in texts(draw, ["the ", "ing", "erth", " Öber", "ción", "漢字", "😀", "\n", "  ", "42", "<s>", ",", "zz"], 300):
        assert token_counts.text_count(counter, text) == len(reference.encode(text).ids), text


def test_odd_rows(odd_docs, no_docs):
    pieces = unigrams()
    reference = library(pieces, 0, True)
    for row in token_counts.count_tokens(odd_docs, pieces).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert row.n_tokens == (len(reference.encode(row.text).ids) if row.text else 0)
        assert row.n_chars == len(row.text or "")
    assert token_counts.count_tokens(odd_docs, pieces).count() == odd_docs.count()
    assert token_counts.count_tokens(no_docs, pieces).count() == 0
