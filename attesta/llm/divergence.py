"""Source divergence: how each source's use of its language's vocabulary differs from the other sources and the language.

Vocabulary. Terms in enough documents of a language are sorted and built into a minimal acyclic transducer, which
maps a term's UTF-8 bytes to its ordinal in that order: equal suffixes share states, and every transition carries the
number of terms that it passes over. All texts are then streamed through it and the terms it accepts are counted by
ordinal, so no term travels as text. Ordinals break ties, and are spelled out by the same transducer for rows that are returned.

Scale. The sorted vocabulary is cut into transducers of at most ``PART_BYTES`` of terms, each built in one task from
its own range; all that fit in ``PASS_BYTES`` together are broadcast for one pass over the texts of their
languages, so a vocabulary of any size takes as many passes as it needs and nothing unbounded reaches the driver or a task.
Counts are summed in each task before they are shuffled. Sources are compared in
(block of ordinals, block of sources, block of sources) tiles that are added up, never as pairs of rows per term.

Defined cases: null text, lang and source count as ''; every occurring (lang, source) is a group, with or without terms;
repeated rows count each time, and as documents; a language without kept terms has divergence 0 between all its sources;
a language's only source has no pairs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.words import ascii_lower, whole
from attesta.operators.skew import union_all
from attesta.operators.staging import stage

#: Letters of a term once A to Z are lower-cased: ASCII letters and all beyond ASCII.
TERM = r"[^\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
PART_BYTES, PASS_BYTES, SLICE_BYTES = 4 << 20, 64 << 20, 8 << 20
TILE_TERMS, TILE_SOURCES = 4_096, 256
#: Cells of a part's table of arcs, and sums that a task holds.
TABLE_CELLS, HELD = 8_000_000, 1_000_000
PARTS = "first binary, keys binary, targets binary, outputs binary, final binary, roots array<struct<lang:string,root:int,n:long>>, size long"
_IN = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Builder:
    """Minimal acyclic transducer of byte strings that come in order, for one language after another."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.arcs: list[tuple[int, int, int]] = []
        self.finals: list[bool] = []
        self.roots: list[tuple[str, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.last, self.path = b"", [(False, [])]

    def _freeze(self, final: bool, arcs: list[tuple[int, int]]) -> int:
        """The state with this future; one that is known is taken again."""
        key = (final, tuple(arcs))
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.sizes)
            before = int(final)
            for byte, target in arcs:
                self.arcs.append((state << 8 | byte, target, before))
                before += self.sizes[target]
            self.sizes.append(before)
            self.finals.append(final)
        return state

    def _close(self, depth: int) -> None:
        while len(self.path) - 1 > depth:
            state = self._freeze(*self.path.pop())
            self.path[-1][1].append((self.last[len(self.path) - 1], state))

    def add(self, term: bytes) -> None:
        same = 0
        while same < len(self.last) and same < len(term) and self.last[same] == term[same]:
            same += 1
        self._close(same)
        self.path += [(False, []) for _ in term[same:]]
        self.path[-1] = (True, self.path[-1][1])
        self.last = term

    def end_language(self, lang: str) -> None:
        self._close(0)
        root = self._freeze(*self.path[0])
        self.roots.append((lang, root, self.sizes[root]))
        self._open()

    def row(self, first: bytes) -> dict:
        keys, targets, outputs = np.array(sorted(self.arcs), dtype=np.int64).reshape(-1, 3).T
        blobs = [keys.tobytes(), targets.astype(np.int32).tobytes(), outputs.astype(np.int32).tobytes(),
                 np.array(self.finals, dtype=bool).tobytes()]
        return {"first": first, **dict(zip(("keys", "targets", "outputs", "final"), blobs)),
                "roots": [{"lang": lang, "root": root, "n": n} for lang, root, n in self.roots], "size": sum(map(len, blobs))}


class Part(NamedTuple):
    """A built transducer; ``roots`` has state, first ordinal and number of terms by language."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    final: np.ndarray
    roots: dict[str, tuple[int, int, int]]

    def table(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Arc by (state, class of byte), one past the last where there is none, for a transducer small enough."""
        used = np.unique(self.keys & 255)
        if (len(used) + 1) * len(self.final) > TABLE_CELLS:
            return None
        classes = np.full(256, len(used), dtype=np.int64)
        classes[used] = np.arange(len(used))
        arcs = np.full((len(self.final), len(used) + 1), len(self.keys), dtype=np.int32)
        arcs[self.keys >> 8, classes[self.keys & 255]] = np.arange(len(self.keys))
        return classes, arcs

    def walk(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray,
             table: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Ordinal (from this part's root) of each token of ``data``, -1 where it is not accepted. All tokens move together."""
        found, passed = np.full(len(start), -1, dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        moving, state, at = np.arange(len(start)), state.astype(np.int64), 0
        while len(moving) and len(self.keys):
            byte = data[start[moving] + at]
            if table:
                arc = table[1][state, table[0][byte]]
                on = arc < len(self.keys)
            else:
                key = state << 8 | byte
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[arc] == key
            moving, arc, at = moving[on], arc[on], at + 1
            passed[moving] += self.outputs[arc]
            state = self.targets[arc].astype(np.int64)
            done = length[moving] == at
            accepted = done & self.final[state]
            found[moving[accepted]] = passed[moving[accepted]]
            moving, state = moving[~done], state[~done]
        return found

    def spell(self, state: int, ordinal: int) -> str:
        """The term with this ordinal."""
        out = bytearray()
        while not (self.final[state] and ordinal == 0):
            low, high = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            arc = low + np.searchsorted(self.outputs[low:high], ordinal, side="right") - 1
            out.append(int(self.keys[arc]) & 255)
            ordinal -= int(self.outputs[arc])
            state = int(self.targets[arc])
        return out.decode()


def _build(part_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (lang, term) rows to transducers of at most ``part_bytes`` of terms."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lang, held, first = Builder(), None, 0, b""

        def flush() -> pa.RecordBatch:
            made.end_language(lang)
            return pa.RecordBatch.from_pylist([made.row(first)], schema=PART_SCHEMA)
        for batch in batches:
            for name, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = term.encode()
                if held and held + len(raw) > part_bytes:
                    yield flush()
                    made, held = Builder(), 0
                elif held and name != lang:
                    made.end_language(lang)
                if not held:
                    first = name.encode() + b"\0" + raw
                lang, held = name, held + len(raw)
                made.add(raw)
        if held:
            yield flush()
    return build


PART_SCHEMA = pa.schema([
    ("first", pa.binary()), ("keys", pa.binary()), ("targets", pa.binary()), ("outputs", pa.binary()), ("final", pa.binary()),
    ("roots", pa.list_(pa.struct([("lang", pa.string()), ("root", pa.int32()), ("n", pa.int64())]))), ("size", pa.int64())])


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """Terms in at least ``min_docs`` documents of their language: lang, term."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    return (docs.select("lang", F.explode(terms).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
            .filter(F.col("df") >= min_docs).select("lang", "term"))


def transducers(kept: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Transducers of the sorted vocabulary, each over a range of it."""
    size = kept.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    ranges = kept.repartitionByRange(max(1, math.ceil(size / part_bytes)), "lang", "term").sortWithinPartitions("lang", "term")
    return ranges.mapInArrow(_build(part_bytes), PARTS)


def _passes(parts: DataFrame, pass_bytes: int) -> list[list[tuple[bytes, dict[str, int]]]]:
    """Parts in order, packed into passes, each with the ordinals its languages begin at. Only sizes and roots are read."""
    packed: list[list[tuple[bytes, dict[str, int]]]] = []
    held, seen = 0, {}
    for row in parts.select("first", "size", "roots").orderBy("first").collect():
        if not packed or held + row["size"] > pass_bytes:
            packed.append([])
            held = 0
        held += row["size"]
        packed[-1].append((row["first"], {r["lang"]: seen.get(r["lang"], 0) for r in row["roots"]}))
        for r in row["roots"]:
            seen[r["lang"]] = seen.get(r["lang"], 0) + r["n"]
    return packed


def _load(parts: DataFrame, chosen: list[tuple[bytes, dict[str, int]]]) -> list[Part]:
    """Read the transducers of one pass: at most ``PASS_BYTES``, or one part."""
    starts = dict(chosen)
    return [Part(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["targets"], np.int32), np.frombuffer(r["outputs"], np.int32),
                 np.frombuffer(r["final"], bool), {x["lang"]: (x["root"], starts[bytes(r["first"])][x["lang"]], x["n"]) for x in r["roots"]})
            for r in parts.filter(F.col("first").isin([bytearray(first) for first in starts])).collect()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], list[bytes]]]:
    """lang, source and text of as many rows as make up ``SLICE_BYTES``."""
    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        start, held = 0, 0
        for i in range(len(texts)):
            held += len(texts[i].as_buffer()) + 1
            if held >= SLICE_BYTES or i == len(texts) - 1:
                yield tuple([x.as_py() for x in c.slice(start, i + 1 - start)] for c in (langs, sources, texts))
                start, held = i + 1, 0


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    merged, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(merged), dtype=np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return merged, total


def _count(parts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to (lang, source, ordinal, n), summed per task as far as ``HELD`` sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known, keys, counts = [part.table() for part in parts.value], {}, [], []

        def sent() -> pa.RecordBatch:
            pairs, n = _summed(keys, counts)
            names = list(known)
            langs, sources = zip(*(names[g] for g in pairs >> 40)) if len(pairs) else ((), ())
            keys.clear(), counts.clear(), known.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()),
                                               pa.array(pairs & ((1 << 40) - 1)), pa.array(n)], ["lang", "source", "ordinal", "n"])
        for langs, sources, texts in _slices(batches):
            data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN[data]]).astype(np.int8)))
            start, length = edge[::2], edge[1::2] - edge[::2]
            row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
            group = np.array([known.setdefault(name, len(known)) for name in zip(langs, sources)], dtype=np.int64)[row]
            for part, table in zip(parts.value, tables):
                root, base = np.array([part.roots.get(lang, (-1, 0, 0))[:2] for lang, _ in known], dtype=np.int64).T
                mine = np.flatnonzero(root[group] >= 0)
                ordinal = part.walk(data, start[mine], length[mine], root[group[mine]], table)
                met = ordinal >= 0
                who = group[mine[met]]
                pairs, n = np.unique(who << 40 | (ordinal[met] + base[who]), return_counts=True)
                keys.append(pairs)
                counts.append(n.astype(np.int64))
            if sum(map(len, keys)) > HELD:
                pairs, n = _summed(keys, counts)
                keys[:], counts[:] = [pairs], [n]
                if len(pairs) > HELD // 2:
                    yield sent()
        if keys:
            yield sent()
    return count


def _spelled(parts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose ordinal lies in these parts, with the term."""
    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for part in parts.value:
                    root, base, n = part.roots.get(row["lang"], (0, 0, 0))
                    if base <= row["ordinal"] < base + n:
                        rows.append(row | {"item": part.spell(root, row["ordinal"] - base)})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("item", pa.string())))
    return spelled


def _held(parts: DataFrame, passes: list, rows: DataFrame, worker: Callable, schema: str, label: str) -> DataFrame:
    """``rows`` of each pass's languages through ``worker`` with that pass's transducers; each pass is written."""
    done, spark = [rows.limit(0).mapInArrow(lambda batches: iter(()), schema)], rows.sparkSession
    for chosen in passes:
        held = spark.sparkContext.broadcast(_load(parts, chosen))
        langs = sorted({lang for _, starts in chosen for lang in starts})
        done.append(stage(rows.filter(F.col("lang").isin(langs)).mapInArrow(worker(held), schema), label))
        held.destroy()
    return union_all(done[1:] or done)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return (1 + F.call_function("div", above, (total + 2 * terms).cast("decimal(20,0)"))).cast("long")


def _tile(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of floor((p-q)^2/(p+q)) over a tile's terms for every pair of its two blocks of sources."""
    groups = groups.sort_values(["block", "source"], ignore_index=True)
    place = {s: i for i, s in enumerate(groups["source"])}
    p = np.repeat(groups["p0"].to_numpy(dtype=np.int64)[:, None], int(groups["width"].iloc[0]), axis=1)
    p[counts["source"].map(place).to_numpy(dtype=np.int64), counts["ordinal"].to_numpy() % TILE_TERMS] = counts["p"].to_numpy()
    block, out = groups["block"].to_numpy(), []
    across = block[0] != block[-1]
    for i in range(len(groups)):
        mates = np.flatnonzero(block != block[0]) if across else np.arange(i + 1, len(groups))
        if across and block[i] != block[0]:
            break
        value = ((p[mates] - p[i]) ** 2 // (p[mates] + p[i])).sum(axis=1)
        out.append(pd.DataFrame({"a": groups["source"][i], "b": groups["source"].to_numpy()[mates], "value": value}))
    return pd.concat(out or [pd.DataFrame({"a": [], "b": [], "value": []})]).assign(lang=groups["lang"].iloc[0])


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for unordered pairs of sources."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("blocks"))
    placed = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    mates = placed.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = stage(mates.select("lang", "source", "block", "total", "terms", F.least("block", "mate").alias("one"),
                              F.greatest("block", "mate").alias("two")), "blocks")
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / TILE_TERMS) - 1, F.lit(0))))
    width = F.least(F.lit(TILE_TERMS), F.col("terms") - F.col("tile") * TILE_TERMS).cast("int")
    right = both.withColumn("tile", tiles).select(
        "lang", "tile", "one", "two", "source", "block", width.alias("width"),
        F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0).alias("p0"))
    left = counts.join(both.select("lang", "source", "one", "two"), ["lang", "source"]).select(
        "lang", F.floor(F.col("ordinal") / TILE_TERMS).alias("tile"), "one", "two", "source", "ordinal", "p")
    keys = ["lang", "tile", "one", "two"]
    dealt = stage(left, "dealt")
    return (dealt.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile, "a string, b string, value long, lang string")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, part_bytes: int = PART_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank; terms to rank ``top`` only."""
    docs = docs.select(whole("lang").alias("lang"), whole("source").alias("source"), whole("text").alias("text"))
    kept = stage(kept_terms(docs, min_docs), "kept")
    parts = stage(transducers(kept, part_bytes), "transducers")
    passes = _passes(parts, pass_bytes)
    streamed = _held(parts, passes, docs.select("lang", "source", F.col("text").cast("binary").alias("text")), _count,
                     "lang string, source string, ordinal long, n long", "streamed")
    summed = stage(streamed.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = summed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stage(
        docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = summed.withColumn("lang_n", F.sum("n").over(W.partitionBy("lang", "ordinal"))).join(groups, ["lang", "source"])
    shares = stage(known.join(langs, "lang").select(
        "lang", "source", "ordinal", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "shares")

    raised = shares.filter("p > q").select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))
    best = stage(raised.withColumn("rank", place).filter(F.col("rank") <= top), "raised")
    named = _held(parts, passes, best, _spelled, "lang string, source string, ordinal long, value long, rank int, item string", "spelled")

    pairs = stage(_pairs(shares, groups), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(columns).unionByName(named.withColumn("part", F.lit("term")).select(columns))
