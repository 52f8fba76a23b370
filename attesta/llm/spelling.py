"""Spelling variants: words one edit apart, found in a bidirectional FM-index with a two-half search scheme.

Scheme. If two words differ by one inserted, deleted or replaced code point, one half of either is found
unchanged in the other at the same end. So a word is matched from its start through its first half exactly and then across
the second with one error, and from its end through the second half exactly and then across the first with one error.
A search begins at the delimiter, keeps an interval of suffix ranks, and narrows it by one symbol a step. It runs
to one side only: to the right in the index of the reversed text, to the left in that of the text itself. At the closing
delimiter the interval holds one suffix, and its rank is the word's ordinal.

Index. The text is the sorted vocabulary with a delimiter before each word, read as a cycle; rotations are sorted by
prefix doubling, and a rank step is one binary search in the sorted (symbol, place) pairs of the
Burrows-Wheeler transform. All searches of a bucket move together, symbol by symbol, in numpy.

Scale. No task holds the whole vocabulary. A word goes to the buckets of the pieces that any word searching
for it may match exactly: its first and last halves, for words of its own length, one less and one more. A piece that
more than ``GROUP`` entries share is made longer: half of the part that may hold the error becomes exact as well, on either side,
again until the part is one symbol, so that a shared beginning of any number of words is split. Nothing is sampled or
capped. Occurrences are summed before they are shuffled.

Defined cases: null texts have no words; a null id counts as empty in ``spoil_key``; repeated rows count each time; words of equal
frequency go by code-point order; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import ascii_lower, whole
from attesta.operators.skew import union_all
from attesta.operators.staging import stage

#: Letters of a word once A to Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"
GROUP, BUCKET = 2_000, 8_000
PAIR = "word string, near string, near_n long"


def spoil_key(doc_id: Column, run: Column) -> Column:
    """Unsigned CRC-32 of ``id:run``."""
    return F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))


def spoilt(run: Column, key: Column, every: int) -> Column:
    """``run`` without one code point, chosen by ``key``, where ``every`` divides the key."""
    k = F.pmod(key, F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), k), F.substr(run, k + 2))
    return F.when(key % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = 6, min_n: int = 5, every: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of at least ``min_length`` code points and ``min_n`` occurrences: word, n.

    ``every`` deletes a code point from those runs whose key it divides (None: from none).
    """
    runs = F.regexp_extract_all(ascii_lower(whole(text_col)), F.lit(LETTERS), F.lit(0))
    long = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(runs, lambda r: F.length(r) >= min_length)).alias("run"))
    word = F.col("run") if every is None else spoilt(F.col("run"), spoil_key(F.col("id"), F.col("run")), every)
    counted = long.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_n))


class Index:
    """Suffix ranks of a delimited vocabulary, narrowed one symbol to the left at a time."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        raw = np.frombuffer(("\0" + "\0".join(self.words)).encode("utf-32-le"), dtype=np.uint32)
        self.letters, text = np.unique(raw, return_inverse=True)  # the delimiter is the smallest symbol
        self.base, rank, width = len(text) + 1, text, 1
        while rank.max() < len(text) - 1:
            _, rank = np.unique(rank * self.base + np.roll(rank, -width), return_inverse=True)
            width *= 2
        places = np.empty_like(rank)
        places[rank] = np.arange(len(rank))
        self.bwt = text[places - 1]
        self.steps = np.sort(self.bwt * self.base + np.arange(len(text)))

    def narrow(self, symbol: np.ndarray | int, rank: np.ndarray) -> np.ndarray:
        """Bound of the interval after putting ``symbol`` in front."""
        return np.searchsorted(self.steps, symbol * self.base + rank)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every letter that may stand in front: row, letter, low, high. An interval is looked through or all letters tried."""
        wide, size = high - low > len(self.letters), high - low
        rows = np.flatnonzero(~wide)
        n = size[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[rows], n)
        seen = np.unique(np.repeat(rows, n) * len(self.letters) + self.bwt[at])
        tried = (np.flatnonzero(wide)[:, None] * len(self.letters) + np.arange(len(self.letters))).ravel()
        row, letter = np.divmod(np.concatenate([seen, tried]), len(self.letters))
        row, letter = row[letter > 0], letter[letter > 0]
        low, high = self.narrow(letter, low[row]), self.narrow(letter, high[row])
        return tuple(x[low < high] for x in (row, letter, low, high))


def search(index: Index, words: np.ndarray, exact: int, loose: int) -> tuple[np.ndarray, np.ndarray]:
    """Words one edit away from ``words`` (rows of symbols in reading order): row, ordinal; a pair may come twice.

    The first ``exact`` symbols match, the error lies in the next ``loose``, the rest matches again.
    """
    rows = np.arange(len(words))
    low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(index.words))
    erred = [np.zeros(0, dtype=np.int64)] * 3
    for at in range(words.shape[1] + 1):
        later = []
        if exact <= at <= exact + loose:
            row, letter, lo, hi = index.branches(low, high)
            erred = [np.concatenate(x) for x in zip(erred, (rows[row], lo, hi))]  # inserted before this place
            if at < exact + loose:
                other = letter != words[rows[row], at]
                later = [(rows[row][other], lo[other], hi[other]), (rows, low, high)]  # replaced, deleted
        if at == words.shape[1]:
            break

        def step(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
            symbol = words[row, at]
            lo, hi = index.narrow(symbol, lo), index.narrow(symbol, hi)
            return tuple(x[lo < hi] for x in (row, lo, hi))
        erred = [np.concatenate(x) for x in zip(step(*erred), *later)]
        if at < exact + loose:
            rows, low, high = step(rows, low, high)
    row, low, high = erred[0], index.narrow(0, erred[1]), index.narrow(0, erred[2])
    return row[low < high], low[low < high]


def _near(bucket: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of a bucket: each word that searches here, with each word of the bucket one edit away."""
    counts = dict(zip(bucket["word"], bucket["n"]))
    ahead, back = Index(list(counts)), Index([w[::-1] for w in counts])
    asked = bucket[bucket["size"] == bucket["word"].str.len()].drop_duplicates(["word", "first", "last"])
    out = []
    for (size, first, last), group in asked.groupby(["size", "first", "last"]):
        words = group["word"].to_numpy()
        # the longer exact piece leads; a search that starts at a word's first letter runs in the reversed index
        index, exact = (back, first) if first >= size - last else (ahead, size - last)
        raw = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), size)
        symbols = np.searchsorted(index.letters, raw if index is back else raw[:, ::-1])
        row, rank = search(index, symbols, exact, last - first)
        for i, r in set(zip(row.tolist(), rank.tolist())):
            near = index.words[r][::-1] if index is back else index.words[r]
            out.append((words[i], near, counts[near]))
    return pd.DataFrame(out, columns=["word", "near", "near_n"])


def _keyed(entries: DataFrame) -> DataFrame:
    """The piece that must match exactly: what lies before ``first`` and, counted from the end, after ``last``."""
    tail = F.col("size") - F.col("last")
    start, end = F.substr("word", F.lit(1), F.col("first")), F.when(tail > 0, F.right(F.col("word"), tail)).otherwise("")
    return entries.withColumn("key", F.xxhash64("size", "first", "last", start, end))


def _segments(first: Column, last: Column, middle: Column) -> Column:
    return F.explode(F.array(F.struct(first.alias("first"), middle.alias("last")), F.struct(middle.alias("first"), last.alias("last"))))


def near_pairs(words: DataFrame, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """All ordered pairs of words (columns word, n) one edit apart: word, near, near_n."""
    size = F.explode(F.array(*[(F.length("word") + d).cast("int").alias("size") for d in (-1, 0, 1)]))
    sized = words.select("word", "n", size.alias("size")).filter("size >= 2")
    halves = sized.select("word", "n", "size", _segments(F.lit(0), F.col("size"), F.floor(F.col("size") / 2).cast("int")).alias("s"))
    open_ = stage(_keyed(halves.select("word", "n", "size", "s.first", "s.last")), "pieces")
    total, dealt = open_.count(), []
    while True:
        hot = stage(open_.filter("last - first > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m"))
                    .filter(F.col("m") > group).select("key"), "hot_pieces")
        if hot.isEmpty():
            break
        dealt.append(open_.join(hot, "key", "left_anti"))
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        finer = open_.join(hot, "key", "left_semi").select(
            "word", "n", "size", _segments(F.col("first"), F.col("last"), middle).alias("s"))
        open_ = stage(_keyed(finer.select("word", "n", "size", "s.first", "s.last")), "pieces")
        total += open_.count()
    buckets = max(1, math.ceil(total / bucket))
    rows = union_all([*dealt, open_]).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    found = rows.select("bucket", "word", "n", "size", "first", "last").groupBy("bucket").applyInPandas(_near, PAIR)
    return found.dropDuplicates(["word", "near"])


def _rounds(top: int, factor: int) -> Iterator[int]:
    """As many doublings as the longest chain of forms needs: each form occurs ``factor`` times as often."""
    return range(math.ceil(math.log2(1 + math.log(max(top, factor), factor))))


def variants(words: DataFrame, factor: int = 5, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """Words (columns word, n) with form, root, n, n_near and form_n.

    A word's form is its most frequent near word, if that occurs at least ``factor`` times as often.
    """
    words = stage(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    told = near_pairs(words, group, bucket).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                   F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))
    takes = F.col("near_n") >= factor * F.col("n")
    formed = stage(joined.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"),
                                 F.when(takes, F.col("near_n")).alias("form_n")), "forms")
    hops = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in _rounds(words.agg(F.max("n")).first()[0] or 0, factor):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stage(hops.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return formed.join(hops, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
