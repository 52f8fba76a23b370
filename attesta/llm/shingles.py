"""Sets of five-word shingles as sorted 64-bit hashes, computed over Arrow text buffers in numpy.

A word is a run of bytes without ASCII white space, A to Z lower-cased. A word's hash is a polynomial
over a table of random byte values, so all words of a block come from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK = 1 << 19
ROWS = 500
_rng = np.random.default_rng(20)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACES = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES = _BYTES[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        _powers[:] = _powers_to(BLOCK * 2)
    up, down = _powers if n <= BLOCK * 2 else _powers_to(n)  # a longer text's are not kept
    return up[:n], down[:n]


def _powers_to(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BACK)]


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a text column of about BLOCK bytes: first row, bytes, row offsets. Null counts as empty."""
    for first in range(0, len(column), ROWS):  # a whole batch is never copied
        for at, data, offsets in _blocks(column.slice(first, ROWS)):
            yield first + at, data, offsets


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block; no word crosses a row."""
    n = len(data)
    solid = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans of a block, from one prefix sum."""
    up, down = _power(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block in order, and the number of words before each row."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_bounds(data, offsets)
    return span_hashes(_BYTES[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row in order."""
    for at, data, offsets in text_blocks(column):
        words, before = word_hashes(data, offsets)
        m = max(0, len(words) - WIDTH + 1)
        runs = np.zeros(m, np.uint64)
        for j in range(WIDTH):
            runs += words[j:j + m] * _PLACES[j]
        runs = mix(runs)
        for k in range(len(offsets) - 1):
            a, b = before[k], before[k + 1]
            if b - a >= WIDTH:
                yield at + k, np.unique(runs[a:b - WIDTH + 1])
            elif b > a:  # fewer words: the whole sequence, told apart by its length
                whole = (words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64)
                yield at + k, mix(np.array([(int(whole) + 0xABCD0000 + int(b - a)) % 2**64], np.uint64))
            else:
                yield at + k, np.zeros(0, np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """Signed 64-bit identity of a set."""
    both = int(np.bitwise_xor.reduce(mix(found))) * _BASE + int(found.sum(dtype=np.uint64)) + len(found)
    return int(mix(np.array([both % 2**64], np.uint64)).view(np.int64)[0])
