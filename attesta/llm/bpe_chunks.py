"""Byte-level BPE with chunk reuse: texts are cut where a rolling hash says so, equal chunks are encoded once.

Cuts depend on the last ``WINDOW`` characters only, so a passage shared by many documents falls into the same chunks. A task
keeps the ids of the chunks it has met (at most ``CACHE`` of them). A cut may fall inside a piece of the pre-tokenizer, so
each joint is repaired: the text from the last certain boundary before it to the first one after it is encoded again,
and the window grows until its ends agree with token ends of both chunks. A certain boundary is a space between two
letters, where a new piece starts whatever stands further away. The result equals encoding the whole text.

Chunks of characters below U+0250 go through the faster of two encoders of the same vocabulary, others (whose
character classes may differ between Unicode versions) through the tokenizers library itself; so do chunks with a
special token.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; texts of any length are encoded
whole; repeated rows are encoded alike; other columns pass through both functions (columns named like the results are replaced);
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attesta.llm.words import row_slices, tidied

WINDOW, AVERAGE, LONGEST = 8, 512, 8192
CACHE = 5_000
ROWS = 500
_SHIFT = np.random.default_rng(6).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_FAR = re.compile("[^\x00-ɏ]")


class Codec:
    """Encoder and decoder of one byte-level vocabulary, given as the library's JSON."""

    def __init__(self, definition: str) -> None:
        import json

        self.definition = definition
        read = json.loads(definition)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in printable} | {
            b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        byte_of = {c: b for b, c in chars.items()}
        added = {t["id"]: t["content"] for t in read["added_tokens"]}
        self.ranks = {bytes(byte_of[c] for c in t): i for t, i in read["model"]["vocab"].items() if i not in added}
        self.pieces = np.full(max([*self.ranks.values(), *added]) + 1, b"", object)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        for i, content in added.items():
            self.pieces[i] = content.encode()
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.special = re.compile("|".join(re.escape(c) for c in added.values()) or "(?!)")
        self.cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_str(self.definition)
        found.no_truncation()
        found.no_padding()
        return found

    @cached_property
    def fast(self):
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of this kind of vocabulary
        return tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def _ids(self, text: str) -> np.ndarray:
        if _FAR.search(text) or self.special.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)

    def _chunk(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the byte offset at which each ends."""
        found = self.cache.get(text)
        if found is None:
            ids = self._ids(text)
            found = ids, np.cumsum(self.sizes[ids]).astype(np.uint32)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        cuts = cut_places(text)
        if not len(cuts):
            return self._chunk(text)[0]
        bounds = [0, *cuts.tolist(), len(text)]
        windows: list[list[int]] = []
        for cut in bounds[1:-1]:
            if windows and cut < windows[-1][1]:
                continue
            windows.append([certain_before(text, cut), certain_after(text, cut)])
        out, at = [], 0
        joints = iter([*windows, None])
        window = next(joints)
        k = 0
        while at < len(text):
            # whole chunks' tokens up to the next window
            to = window[0] if window else len(text)
            while k < len(bounds) - 2 and bounds[k + 1] <= at:
                k += 1
            if at < to:
                ids, ends = self._chunk(text[bounds[k]:bounds[k + 1]])
                first = self._token_at(text, bounds[k], at, ends)
                last = self._token_at(text, bounds[k], to, ends)
                if first is None or last is None:  # no agreement: encode from the last certain boundary to the text's next one
                    return self._ids(text)
                out.append(ids[first:last])
            if window:
                out.append(self._ids(text[max(at, window[0]):window[1]]))
                at = window[1]
                window = next(joints)
            else:
                at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    @staticmethod
    def _token_at(text: str, start: int, place: int, ends: np.ndarray) -> int | None:
        """Index of the token that starts at a place of the text, if one does."""
        offset = len(text[start:place].encode("utf-8", "surrogatepass"))
        if offset == 0:
            return 0
        i = int(np.searchsorted(ends, offset))
        return i + 1 if i < len(ends) and ends[i] == offset else None

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.pieces[ids].tolist()).decode("utf-8", "replace")


def cut_places(text: str) -> np.ndarray:
    """Content-defined cuts: at least WINDOW characters in, a run without one is cut after LONGEST."""
    if len(text) < AVERAGE // 4:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = len(codes) - WINDOW
    rolling = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        rolling += codes[j:j + m] * _SHIFT[j]
    rolling ^= rolling >> np.uint64(29)
    cuts = np.flatnonzero(rolling % np.uint64(AVERAGE) == 0) + WINDOW
    edges = np.concatenate([[0], cuts, [len(codes)]])
    long = np.flatnonzero(np.diff(edges) > LONGEST)
    if len(long):
        more = [np.arange(edges[i] + LONGEST, edges[i + 1], LONGEST) for i in long]
        cuts = np.sort(np.concatenate([cuts, *more]))
    return cuts


def _certain(text: str, p: int) -> bool:
    return 0 < p < len(text) - 1 and "ɐ" > text[p - 1] and text[p - 1].isalpha() and "ɐ" > text[p + 1] and text[p + 1].isalpha()


def certain_before(text: str, place: int) -> int:
    p = text.rfind(" ", 0, place)
    while p > 0 and not _certain(text, p):
        p = text.rfind(" ", 0, p)
    return max(p, 0)


def certain_after(text: str, place: int) -> int:
    p = text.find(" ", place)
    while p >= 0 and not _certain(text, p):
        p = text.find(" ", p + 1)
    return p if p >= 0 else len(text)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _over(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def _with(docs: DataFrame, names: dict[str, T.DataType], run) -> DataFrame:
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in names.items()]])
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``definition`` is the tokenizer's JSON, read by the driver; it travels to the tasks as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in _parts(batches):
            found = [codec.encode(text) for text in _over(batch.column(text_col))]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in ("ids", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in kept], pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()),
                 pa.array([len(f) for f in found], pa.int64())], names=[*[n for n, _ in kept], "ids", "n_tokens"])
    return _with(docs, {"ids": T.BinaryType(), "n_tokens": T.LongType()}, run)


def decode(encoded: DataFrame, definition: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text its ids stand for; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in _parts(batches):
            texts = [codec.decode(np.frombuffer(v.as_py() or b"", "<u4")) for v in batch.column(ids_col)]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(texts, pa.string())], names=[*[n for n, _ in kept], "decoded"])
    return _with(encoded, {"decoded": T.StringType()}, run)


def round_trip(docs: DataFrame, definition: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded`` from one worker per task, which holds one vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    names = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in row_slices(batches, text_col):
            ids = [codec.encode(text) for text in _over(batch.column(text_col))]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in names]
            made = [pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([codec.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *made], names=[*[n for n, _ in kept], *names])
    return _with(docs, names, tidied(run))
