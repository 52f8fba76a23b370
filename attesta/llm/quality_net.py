"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Words (runs without white space, case kept) fall into hashed vocabulary buckets. Every bucket, every word shape (the kinds of
characters a word is made of) and the mark "seen before in this text" has a sparse random index vector. A word's vector is
the sum of the index vectors found around it in the sample, scaled to length one. A document is the mean of its words' vectors next
to the mean of their own shape and repeat vectors. A two-layer network scores it; a temperature fitted on rows that
the network has not seen turns its output into a probability.

Only fitting uses a sample: at most ``SAMPLE`` labelled rows, those with the smallest hash of their id. Sums of the
vocabulary (bounded: ``BUCKETS`` x ``DIM``) and pooled sample rows are all that reaches the driver. Scoring reads whole texts.

Defined cases: null and empty texts are scored from a zero vector; a null label or id is not learned from; with labels of one
class only, every score is that class's share, without labels 0.5; repeated rows score alike; an empty table gives an empty
result; further columns are ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import shingles
from attesta.llm.words import row_slices, tidied, whole

SAMPLE = 8_000
BUCKETS, DIM, HIDDEN, REACH = 1 << 14, 32, 32, 2
_rng = np.random.default_rng(3)
_CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SHAPES = 256
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
for _marks, _bit in ((".,;:'\"()-", 16), ("!?", 32), ("#$%&*@^~+=", 64), ("|<>{}[]\\/_`", 128)):
    _KIND[[ord(c) for c in _marks]] = _bit


def _index(n: int, seed: int) -> np.ndarray:
    """Sparse random index vectors: four entries of plus or minus one."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for _ in range(4):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice([-1, 1], n)
    return out


WORD_INDEX, SHAPE_INDEX = _index(BUCKETS, 1), _index(_SHAPES + 2, 2)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every word of a block, and the number of words before each row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    starts, ends = shingles.word_bounds(data, offsets)
    hashes = shingles.span_hashes(_CASED[data], starts, ends)
    # a word's kinds, up to the next word's start: white space in between has no kind
    shapes = np.bitwise_or.reduceat(_KIND[data], starts) if len(starts) else np.zeros(0, np.uint8)
    return hashes, shapes, np.searchsorted(starts, offsets)


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """True for words that stand earlier in the same text."""
    seen = np.ones(len(hashes), bool)
    seen[np.unique(hashes, return_index=True)[1]] = False
    return seen


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: the sums of the index vectors around each bucket's words."""
    total = np.zeros((BUCKETS, DIM), np.float32)
    for batch in batches:
        for _, data, offsets in shingles.text_blocks(batch.column("text")):
            hashes, shapes, before = _words(data, offsets)
            bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
            for a, b in zip(before[:-1], before[1:]):
                k, s = bucket[a:b], shapes[a:b]
                own = WORD_INDEX[k] + SHAPE_INDEX[s] + SHAPE_INDEX[_SHAPES + _repeats(hashes[a:b]).astype(np.int64)]
                around = SHAPE_INDEX[s].copy()
                for d in range(1, REACH + 1):
                    around[d:] += own[:-d]
                    around[:-d] += own[d:]
                np.add.at(total, k, around)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, mean shape and repeat vector."""
    out = np.zeros((len(column), 2 * DIM), np.float32)
    for at, data, offsets in shingles.text_blocks(column):
        hashes, shapes, before = _words(data, offsets)
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        for i, (a, b) in enumerate(zip(before[:-1], before[1:])):
            if b > a:
                again = _repeats(hashes[a:b])
                out[at + i, :DIM] = vectors[bucket[a:b]].mean(0)
                kinds = np.bincount(shapes[a:b], minlength=_SHAPES + 2).astype(np.float32)
                kinds[_SHAPES:] = (~again).sum(), again.sum()
                out[at + i, DIM:] = kinds @ SHAPE_INDEX / (b - a)
    return out


class Network(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = 400, rate: float = 0.01) -> Network:
    """Full-batch Adam on four fifths of the rows; the temperature from the last fifth."""
    rng = np.random.default_rng(5)
    order = rng.permutation(len(x))
    train, rest = order[:max(1, len(x) * 4 // 5)], order[max(1, len(x) * 4 // 5):]
    mean, spread = x[train].mean(0), x[train].std(0) + 1e-3
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t = (x[train] - mean) / spread, y[train].astype(float)
    for step in range(1, epochs + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, mean, spread, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if not len(rest):
        return net
    logit, truth = net.logits(x[rest]), y[rest]

    def loss(temperature: float) -> float:
        return float(np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / temperature)))
    return net._replace(temperature=min(np.geomspace(0.25, 8, 41), key=loss))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network from at most ``sample`` labelled rows that are not held out; a share if there is but one class."""
    spark = docs.sparkSession
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", whole("text").alias("text")).join(chosen, "doc_id").repartition(8, "doc_id")
    sums = sum((np.frombuffer(r["sums"], np.float32).reshape(BUCKETS, DIM)
                for r in rows.select("text").mapInArrow(tidied(context_sums), "sums binary").toLocalIterator()), np.zeros((BUCKETS, DIM), np.float32))
    vectors = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pooled(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in found], pa.binary())],
                                             names=["doc_id", "quality", "x"])
    got = sorted((r["doc_id"], r["quality"], r["x"]) for r in rows.mapInArrow(tidied(pool), "doc_id long, quality int, x binary").collect())
    y = np.array([q for _, q, _ in got])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fit_network(np.stack([np.frombuffer(x, np.float32) for _, _, x in got]).astype(float), y, vectors)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """Every row: doc_id, text_hash, score (likelier of good quality), from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            column = batch.column("text")
            s = np.full(len(column), net) if isinstance(net, float) else net.probabilities(pooled(column, net.vectors))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(s, pa.float64())], names=["doc_id", "text_hash", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole("text")).alias("text_hash"), whole("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, score double")


def keep_good(docs: DataFrame, model: Network | float, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in row_slices(batches, "text"):
            column = batch.column("text")
            s = np.full(len(column), net) if isinstance(net, float) else net.probabilities(pooled(column, net.vectors))
            yield batch.filter(pa.array(s >= least))
    return docs.mapInArrow(tidied(run), docs.schema)
