import hashlib
import random

import numpy as np
import pytest

from attesta.llm import bpe_chunks
from attesta.llm.queries import vocabulary


@pytest.fixture(scope="module")
def codec():
    return bpe_chunks.Codec(vocabulary())


def whole(codec, text):
    return codec.exact.encode(text, add_special_tokens=False).ids


def random_text(draw):
    parts = ["the ", "word", " it's", "don't ", "  ", "\n", "\n\n ", "12 345", "!!", " %%% ", "é", "ñandú ", "漢字", "😀", "<|endoftext|>", "'", " ", "\t", "x" * 40, " ", "Ǆ "]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(900)))


def test_chunks_join_to_the_ids_of_the_whole_text(codec):
    draw = random.Random(4)
    shared = " ".join(draw.choice(["alpha", "beta's", "gamma,", "Δelta", "12"]) for _ in range(800))
    texts = [random_text(draw) for _ in range(300)] + [shared, "new start " + shared, shared[7:] + " tail", "a" * 30_000, " " * 9000, "", "<|endoftext|>" * 300]
    for text in texts:
        assert codec.encode(text).tolist() == whole(codec, text)
        assert codec.decode(codec.encode(text)) == codec.exact.decode(whole(codec, text), skip_special_tokens=False)


def test_shared_passages_share_chunks(codec):
    draw = random.Random(2)
    shared = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    a, b = "one more " + shared, "quite another beginning " + shared
    cut = [{t[i:j] for i, j in zip([0, *bpe_chunks.cut_places(t)], [*bpe_chunks.cut_places(t), len(t)])} for t in (a, b)]
    assert len(cut[0] & cut[1]) >= len(cut[0]) - 2


def test_odd_rows(spark, codec, odd_docs, no_docs):
    definition = vocabulary()
    done = bpe_chunks.decode(bpe_chunks.encode(odd_docs, definition), definition).collect()
    assert len(done) == odd_docs.count()
    for row in done:
        want = whole(codec, row.text or "")
        assert row.n_tokens == len(want)
        assert hashlib.sha256(row.ids).hexdigest() == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded == (row.text or "")
    assert bpe_chunks.encode(no_docs, definition).count() == 0
