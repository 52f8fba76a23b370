"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary match of a word with its end; dynamic programming over the ends carries the
best score and the number of pieces of the path that has it. Tie rules are those of the tokenizers library's unigram
model: scores are compared as doubles and only a strictly better path replaces one found earlier, which for matches with the
same end means the longest match first; a character without a match of its own may be unknown, at ten below the lowest score;
unknown runs count as one piece, or, if all byte pieces exist, as one piece per UTF-8 byte.

Words are the parts of a text from one space to the next, each with the space mark before it, as the library's Metaspace
splits them, so a word's count does not depend on its neighbours and a task counts each distinct word once (in a cache
of at most ``CACHE`` words).

Defined cases: null and empty texts have no tokens; texts of any length are counted whole; repeated rows count
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 400_000


class WordCounter(dict):
    """word -> number of pieces, counted at the first look-up."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.count(SPACE + word)
        return found

    def count(self, text: str) -> int:
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        end, match = next(matches, (n, None))
        for e in range(n):
            best, single = None, False
            while end == e:  # the longest match of an end comes first
                size, worth = match
                s = e + 1 - size
                single = size == 1
                if best is None or score[s] + worth > best:
                    best, count[e + 1] = score[s] + worth, count[s] + 1
                end, match = next(matches, (n, None))
            if not single and (best is None or score[e] + self.unknown > best):
                best, unknown[e + 1] = score[e] + self.unknown, True
                if self.by_bytes:
                    count[e + 1] = count[e] + len(text[e].encode("utf-8", "surrogatepass"))
                else:
                    count[e + 1] = count[e] + (not unknown[e])
            score[e + 1] = best
        return count[n]


def text_count(counter: WordCounter, text: str) -> int:
    if not text:
        return 0
    return sum(map(counter.__getitem__, (text[1:] if text[0] == " " else text).split(" ")))


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_chars, n_tokens. ``pieces``: (piece, score) of the vocabulary, read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(shared.value)
        for batch in batches:
            counts = [text_count(counter, v.as_py() or "") for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), pa.array(counts, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
