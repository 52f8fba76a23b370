"""Ranked corpus search: exact top-k by BM25 or token overlap, by a scan or pruned by score bounds.

A scan packs the documents, where they lie, into parts of about ``PART_TOKENS`` tokens and the queries into blocks, ``BLOCKS`` of which are one row.
Rows of both kinds meet as a product, which repeats neither on disk. A task has one row of queries, goes through its parts and
keeps the k best of all it has seen, so what is shuffled and written grows with documents and with queries but not with their product.

From ``DIRECT`` (query, document) pairs on, bounds are looked for first. That has three steps, and no result depends on how far it prunes.

1. Threshold. Some documents that hold a query's rarest terms are scored; the k-th best score of these is one that
   the k-th best of all cannot fall below.
2. Candidates. A query's terms are put in order of the highest gain they can bring. Those that together stay below the threshold
   cannot lift a document into the result, so a document without any other term is never looked at. The postings of the
   other, mostly rare, terms are added up per tile, and a document goes on if what the common terms may still bring can reach the threshold.
3. Scores. Candidates are scored whole, from the postings of their tiles.

Queries with the same tokens are searched once; so are, with bounds, documents with the same tokens. Both are
expanded at the end. No table of all (query, document) pairs exists. Terms are added in one fixed order, so scores do not depend on how rows were
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from attesta.functions import text as tx
from attesta.operators.search_index import B, K1, SearchIndex, build_index, dealt, open_index
from attesta.operators.skew import hot_keys, salted_join
from attesta.operators.staging import stage

__all__ = ["DIGITS", "QID", "SearchIndex", "build_index", "identified", "open_index", "scored_pairs", "top_k_search"]

DIGITS = 6                  # scores are rounded to this many digits before ranking
BLOCK = 256                 # queries of a block
WIDE_BLOCK = 2048           # queries of a block that is pruned by bounds: a tile's postings travel once for each
BLOCKS = 128                # blocks that are scored in one task
TASKS = 4                   # tasks to a core, when there are so few rows of queries that parts are dealt out too
TASK_TOKENS = 500_000_000   # tokens that a task goes through, at most
PART_TOKENS = 2_000_000     # tokens of a part of the documents
WIDTH = 2048                # documents of a part that are scored at once
COMMON = 128                # a term is common if this many times (its askers x its entries) is all queries x documents of a tile
SLICE = 256                 # common terms of one matrix product
ENTRIES = 2**18             # (query, entry) pairs of other terms that are added at once
DIRECT = 10**13             # (query, document) pairs that are scored without looking for bounds first
LEAD = 4                    # this many times k documents give a query its threshold
SLACK = 1e-5                # more than rounding and the order of additions can change
HOT_QUERIES = 200_000       # copies of one query in one join partition

# a few rows of many MB: Parquet would count only every hundredth
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(2**25),
             "parquet.enable.dictionary": "false"}
QID = ["_q1", "_q2"]       # two 64-bit hashes of a query's terms
PLACE = [*QID, "_block", "_qn", "tile", "pos"]
PLACED = "_q1 long, _q2 long, _block long, _qn int, tile long, pos int"


def _best(scores: DataFrame, by: str, k: int, keys: list[str]) -> DataFrame:
    ranked = W.partitionBy(*keys).orderBy(F.desc(by), "doc_id")
    return scores.withColumn("search_rank", F.row_number().over(ranked)).filter(F.col("search_rank") <= k)


def identified(queries: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Queries with their sorted distinct terms (``_t``) and two hashes of these."""
    return queries.select(*keys, F.array_sort(F.array_distinct(tx.tokens(text))).alias("_t")).select(
        *keys, F.xxhash64("_t").alias("_q1"), F.xxhash64(F.lit("2"), "_t").alias("_q2"), "_t")


def top_k_search(index: SearchIndex, queries: DataFrame, keys: list[str], text: str,
                 k: int = 10, scheme: str = "bm25", k1: float = K1, b: float = B,
                 max_df_share: float | None = None) -> DataFrame:
    """``keys, search_rank, doc_id, score``: the k best documents per query.

    Ties go to the lower document id (a long or a struct of parts). Every term
    counts unless ``max_df_share`` is set, which leaves out terms found in a
    larger share of the corpus. Documents sharing no kept term are absent.
    """
    asked = identified(queries, keys, text)
    wanted = _wanted(asked)
    if not index.repeated and wanted.count() * index.n_docs <= DIRECT:
        best = _scanned(index, wanted, k, scheme, k1, b, max_df_share)
    else:
        found = scored_pairs(index, wanted, k, scheme, k1, b, max_df_share)
        # ties stay until the ids are known
        near = found.withColumn("_r", F.rank().over(W.partitionBy(*QID).orderBy(F.desc("score")))).filter(F.col("_r") <= k)
        best = _best(near.join(index.groups.select("tile", "pos", "doc_id"), ["tile", "pos"]).select(*QID, "doc_id", "score"),
                     "score", k, QID)
        if index.has_copies:
            best = _with_copies(index, stage(best.drop("search_rank"), "best"), k)
    copies = asked.select(*keys, *QID)
    hits = salted_join(copies, best, QID, hot_keys(copies, QID, HOT_QUERIES), spread=keys)
    return hits.select(*keys, "search_rank", "doc_id", "score")


def scored_pairs(index: SearchIndex, asked: DataFrame, k: int, scheme: str = "bm25", k1: float = K1, b: float = B,
                 max_df_share: float | None = None) -> DataFrame:
    """Every (query, document) pair that had to be scored, once: ``_q1, _q2, tile, pos, score``.

    ``asked`` has ``_q1, _q2, _t`` (the query's sorted distinct terms). Among the pairs are each query's k best.
    """
    gain = _gain(scheme, k1, b, index.avg_len)
    terms = _asked_terms(_weighted(index, _numbered(_wanted(asked), WIDE_BLOCK), scheme, k1, b, max_df_share, True), LEAD * k)
    lead = _pairs(index, terms.filter("lead"), LEAD * k)
    first = _scores(index, lead, terms, gain)
    worst = W.partitionBy(*QID).orderBy(F.desc("score"))
    theta = (first.withColumn("_r", F.row_number().over(worst)).filter(F.col("_r") == k)
             .select(*QID, F.col("score").alias("theta")))
    bounded = terms.join(theta, QID, "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    minor = F.col("below") + SLACK < F.col("theta")
    rest = F.coalesce(F.max(F.when(minor, F.col("below"))).over(W.partitionBy(*QID)), F.lit(0.0))
    major = bounded.withColumn("need", F.col("theta") - rest - SLACK).filter(~minor)
    askers = _askers(major, ["_block"], "need")
    placed, postings = index.shelved(askers)
    met = postings.join(placed, ["shelf", "term"]).select(
        "tile", "_block", "term", *_flat("posts", "pos", "tf", "dl"), *_flat("askers", "_qn", *QID, "weight", "need"))
    survivors = met.groupBy("tile", "_block").applyInArrow(_surviving(gain), PLACED)
    more = stage(survivors.join(lead.select(*QID, "tile", "pos"), [*QID, "tile", "pos"], "left_anti"), "candidates")
    return first.unionByName(_scores(index, more, terms, gain))


def _wanted(asked: DataFrame) -> DataFrame:
    return stage(asked.groupBy(*QID).agg(F.first("_t").alias("_t")), "queries")


def _numbered(wanted: DataFrame, block: int) -> DataFrame:
    return wanted.withColumn("_block", dealt("_q1", wanted.count(), block)).withColumn(
        "_qn", F.row_number().over(W.partitionBy("_block").orderBy(*QID)) - 1)


def _weighted(index: SearchIndex, numbered: DataFrame, scheme: str, k1: float, b: float, max_df_share: float | None, bounds: bool) -> DataFrame:
    """One row per query and term of the index: ``_block, _qn`` (the query in its block), ``weight``, and with ``bounds`` the highest gain
    ``top`` and ``n`` documents."""
    terms = index.bounds if bounds else index.terms
    if max_df_share is not None:
        terms = terms.filter(F.col("df") <= F.lit(max_df_share) * F.lit(index.n_docs))
    if scheme == "overlap":
        weight, top = F.lit(1.0) / F.col("n_terms"), F.lit(1.0)
    else:
        weight = F.log(F.lit(1.0) + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        top = F.col("top") if (k1, b) == (K1, B) else F.lit(k1 + 1.0)
    known = [F.col("n"), top.alias("top")] if bounds else []
    return (numbered.select(*QID, "_block", "_qn", F.size("_t").alias("n_terms"), F.explode("_t").alias("term"))
            .join(terms, "term").select(*QID, "_block", "_qn", "term", weight.alias("weight"), *known))


def _asked_terms(rows: DataFrame, lead: int) -> DataFrame:
    """The weighted terms with ``below`` (what this and all weaker terms of the query can bring) and ``lead`` (among the
    rarest terms, up to ``lead`` documents)."""
    mine = W.partitionBy(*QID)
    rarer = F.sum("n").over(mine.orderBy("n", "term").rowsBetween(W.unboundedPreceding, -1))
    strength = F.col("weight") * F.col("top")
    below = F.sum(strength).over(mine.orderBy(strength, "term").rowsBetween(W.unboundedPreceding, W.currentRow))
    return stage(rows.withColumns({"lead": F.coalesce(rarer, F.lit(0)) < lead, "below": below}).drop("top"), "terms")


def _scanned(index: SearchIndex, wanted: DataFrame, k: int, scheme: str, k1: float, b: float, max_df_share: float | None) -> DataFrame:
    """``_q1, _q2, search_rank, doc_id, score``: the k best of all documents, each scored for every query that shares a term."""
    numbered = stage(_numbered(wanted, BLOCK), "numbered")
    terms = _weighted(index, numbered, scheme, k1, b, max_df_share, False)
    blocks = max(1, -(-numbered.count() // BLOCK))
    supers = -(-blocks // BLOCKS)
    together = -(-blocks // supers)
    asked = (terms.groupBy("term", "_block").agg(F.collect_list(F.struct("_qn", "weight")).alias("a"))
             .select(F.floor(F.col("_block") / together).cast("int").alias("_super"), "_block", "term", *_flat("a", "_qn", "weight"))
             .groupBy("_super").applyInArrow(_packed_queries, "_super int, asked binary"))
    docs = index.forward.filter("dl > 0").select("doc_id", "dl", F.col("terms.term").alias("term"), F.col("terms.tf").alias("tf"))
    parts = docs.mapInArrow(_packed_parts(PART_TOKENS, WIDTH), "part binary")
    if supers > 1:
        # each part is read for every row of queries, by few tasks when there are many such rows
        spark = wanted.sparkSession
        asked = stage(asked, "asked").repartitionByRange(supers, "_super")
        parts = stage(parts, "parts", **WIDE_ROWS)
        tasks = max(-(-TASKS * spark.sparkContext.defaultParallelism // supers), -(-int(index.n_docs * index.avg_len) // TASK_TOKENS))
        parts = parts.coalesce(tasks)
    else:
        asked = asked.coalesce(1)
    kinds = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_qn", T.IntegerType()), docs.schema["doc_id"],
                          T.StructField("score", T.DoubleType())])
    found = parts.hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(_all_best(k, _gain(scheme, k1, b, index.avg_len), WIDTH, docs.schema["doc_id"]), kinds)
    place = ["_block", "_qn"]
    return _best(found, "score", k, place).join(numbered.select(*place, *QID), place).select(*QID, "search_rank", "doc_id", "score")


def _flat(rows: str, *names: str) -> list[Column]:
    return [F.col(f"{rows}.{c}").alias(c) for c in names]


def _askers(terms: DataFrame, by: list[str], *carry: str) -> DataFrame:
    """The queries of a block that ask for a term; a block's size bounds the list."""
    return terms.groupBy("term", *by).agg(F.collect_list(F.struct("_qn", *QID, "weight", *carry)).alias("askers"))


def _pairs(index: SearchIndex, lead: DataFrame, most: int) -> DataFrame:
    """Documents of the leading terms. Of a term with more than enough, the first tiles and entries do: any real
    document's score is a safe threshold."""
    tiles = F.ceil(F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("n")) * index.n_tiles)
    placed, postings = index.shelved(lead.select("term", *QID, "_block", "_qn", tiles.alias("tiles")))
    met = postings.select("shelf", "term", "tile", F.slice("posts.pos", 1, 2 * most).alias("pos")).join(placed, ["shelf", "term"])
    return stage(met.filter(F.col("tile") < F.col("tiles")).select(*QID, "_block", "_qn", "tile", F.explode("pos").alias("pos")).distinct(), "lead")


def _scores(index: SearchIndex, pairs: DataFrame, terms: DataFrame, gain: Callable) -> DataFrame:
    """Whole scores of chosen pairs, each from its tile's postings of all terms of the query."""
    near = pairs.select(*QID, "tile").distinct().join(terms.select(*QID, "_block", "_qn", "term", "weight"), QID)
    placed, postings = index.shelved(near.groupBy("term", "_block", "tile").agg(F.collect_list(F.struct("_qn", "weight")).alias("askers")))
    met = postings.join(placed, ["shelf", "term", "tile"]).select(
        "tile", "_block", "term", *_flat("posts", "pos", "tf", "dl"), *_flat("askers", "_qn", "weight"))
    scored = met.groupBy("tile", "_block").cogroup(pairs.groupBy("tile", "_block")).applyInArrow(
        _tile_scores(gain), "_q1 long, _q2 long, tile long, pos int, score double")
    return stage(scored, "scores")


def _gain(scheme: str, k1: float, b: float, avg_len: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def gain(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        if scheme == "overlap":
            return np.ones(len(tf))
        tf = tf.astype(float)
        return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avg_len))
    return gain


def _columns(met: pa.Table, posts: list[str], askers: list[str]) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """Flattened list columns of the rows by term, and each row's bounds in both kinds."""
    met = met.sort_by("term")
    flat = {c: met.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in (*posts, *askers)}
    ends = [np.cumsum(met.column(c[0]).combine_chunks().value_lengths().to_numpy(zero_copy_only=False)) for c in (posts, askers)]
    return flat, list(zip(np.r_[0, ends[0][:-1]], ends[0], np.r_[0, ends[1][:-1]], ends[1]))


def _added(rows: list[tuple], pos: np.ndarray, gains: np.ndarray, who: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
    """Scores of a tile's documents for a block's queries, term by term."""
    scores, line = np.zeros((n, width)), np.zeros(width)
    for p0, p1, q0, q1 in rows:
        at, mine = pos[p0:p1], who[q0:q1]
        if 8 * len(at) >= width:
            line[:] = 0.0
            line[at] = gains[p0:p1]
            scores[mine] += weight[q0:q1, None] * line
        else:
            scores[mine[:, None], at] += weight[q0:q1, None] * gains[p0:p1]
    return scores


def _spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, as many as its size says, and which start they belong to."""
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) + np.repeat(start - (np.cumsum(size) - size), size), row


def _summed(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, q1: np.ndarray, pos: np.ndarray, gains: np.ndarray, who: np.ndarray,
            weight: np.ndarray, n: int, width: int) -> np.ndarray:
    """As ``_added`` where no document stands twice in a term's entries: common terms by matrix products, the others' entries many at once."""
    scores, held, asked = np.zeros((n, width)), p1 - p0, q1 - q0
    common = COMMON * held * asked >= n * width
    often = np.flatnonzero(common)
    for some in (often[at:at + SLICE] for at in range(0, len(often), SLICE)):
        lines, shares = np.zeros((len(some), width)), np.zeros((n, len(some)))
        entry, row = _spans(p0[some], held[some])
        lines[row, pos[entry]] = gains[entry]
        asker, row = _spans(q0[some], asked[some])
        shares[who[asker], row] = weight[asker]
        scores += shares @ lines
    seldom = np.flatnonzero(~common)
    total = np.cumsum(held[seldom] * asked[seldom])
    edges = np.unique(np.r_[0, np.searchsorted(total, np.arange(ENTRIES, total[-1], ENTRIES)) if len(total) else 0, len(seldom)])
    for some in (seldom[lo:hi] for lo, hi in zip(edges, edges[1:])):
        asker, row = _spans(q0[some], asked[some])
        entry, row = _spans(p0[some][row], held[some][row])
        np.add.at(scores.reshape(-1), (who[asker].astype(np.int64) * width)[row] + pos[entry], weight[asker][row] * gains[entry])
    return scores


def _ids(flat: dict[str, np.ndarray], who: np.ndarray) -> np.ndarray:
    ids = np.zeros((2, int(who.max()) + 1), np.int64)
    ids[0, who], ids[1, who] = flat["_q1"], flat["_q2"]
    return ids


def _surviving(gain: Callable) -> Callable:
    """Documents of a tile that a block's queries may still want, given what their stronger terms bring."""
    def run(met: pa.Table) -> pa.Table:
        flat, rows = _columns(met, ["pos", "tf", "dl"], ["_qn", *QID, "weight", "need"])
        asked, who = np.unique(flat["_qn"], return_inverse=True)
        scores = _added(rows, flat["pos"], gain(flat["tf"], flat["dl"]), who, flat["weight"], len(asked), int(flat["pos"].max()) + 1)
        ids, need = _ids(flat, who), np.zeros(len(asked))
        need[who] = flat["need"]
        row, col = np.nonzero((scores > 0) & (scores >= need[:, None]))
        return pa.table({"_q1": ids[0, row], "_q2": ids[1, row], "_block": np.full(len(row), met.column("_block")[0].as_py(), np.int64),
                         "_qn": asked[row].astype(np.int32), "tile": np.full(len(row), met.column("tile")[0].as_py(), np.int64),
                         "pos": col.astype(np.int32)})
    return run


def _in_id_order(docs: pa.Table) -> pa.Table:
    """Documents by id: a number, or a struct by its fields in order."""
    return docs.take(pa.array(_id_order(docs)))


def _id_order(docs: pa.Table) -> np.ndarray:
    ids = docs.select(["doc_id"])
    while any(pa.types.is_struct(kind) for kind in ids.schema.types):
        ids = ids.flatten()
    return pc.sort_indices(ids, sort_keys=[(c, "ascending") for c in ids.column_names], null_placement="at_start").to_numpy()


def _to_bytes(**columns: pa.Array) -> bytes:
    """Arrays of any lengths and types in one value."""
    rows = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    sink = pa.BufferOutputStream()
    batch = pa.record_batch(rows, names=list(columns))
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(value: pa.Scalar) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
    return {c: batch.column(c).flatten() for c in batch.schema.names}


def _whole(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)


def _packed_queries(asked: pa.Table) -> pa.Table:
    """Some blocks of queries as one value: their terms in order, and for each block and term who asks for it with what weight."""
    names = pc.unique(asked.column("term"))
    names = names.take(pc.sort_indices(names))
    asked = asked.append_column("code", pc.index_in(asked.column("term"), value_set=names)).sort_by([("_block", "ascending"), ("code", "ascending")])
    who, weight = _whole(asked.column("_qn")), _whole(asked.column("weight"))
    value = _to_bytes(names=names, block=_whole(asked.column("_block")), code=_whole(asked.column("code")), n=who.value_lengths(),
                      who=who.flatten(), weight=weight.flatten())
    return pa.table({"_super": asked.column("_super").slice(0, 1), "asked": pa.array([value], pa.binary())})


def _packed_parts(tokens: int, width: int) -> Callable:
    """Documents as parts of about so many tokens, in the order they come; a part is one value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(batch.column("dl").to_numpy())
            lo = 0
            while lo < len(ends):
                before = ends[lo - 1] if lo else 0
                hi = min(len(ends), int(np.searchsorted(ends, before + tokens - size)) + 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1] - before)
                lo = hi
                if size >= tokens:
                    yield _part(pa.Table.from_batches(held), width)
                    held, size = [], 0
        if held:
            yield _part(pa.Table.from_batches(held), width)
    return run


def _part(docs: pa.Table, width: int) -> pa.RecordBatch:
    """A part: its documents by id, its terms in order, and by tile of ``width`` documents and term the entries' places and counts."""
    docs = _in_id_order(docs)
    held = _whole(docs.column("term"))
    sizes = pc.list_value_length(held).to_numpy()
    coded = held.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    row = np.repeat(np.arange(len(sizes)), sizes)
    run = row // width * max(1, len(by_name)) + rank[coded.indices.to_numpy()]
    order = np.argsort(run, kind="stable")
    run = run[order]
    first = np.flatnonzero(np.r_[len(run) > 0, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    value = _to_bytes(ids=_whole(docs.column("doc_id")), dl=_whole(docs.column("dl")), names=coded.dictionary.take(pa.array(by_name)),
                      run=pa.array(run[first]), first=pa.array(first.astype(np.int32)), pos=pa.array((row % width)[order].astype(np.int32)),
                      tf=_whole(docs.column("tf")).flatten().take(pa.array(order)))
    return pa.record_batch([pa.array([value], pa.binary())], names=["part"])


class _Asked:
    """The queries of some blocks, and the k best documents that each has met."""

    def __init__(self, value: pa.Scalar, k: int, id_type: pa.DataType):
        held = _from_bytes(value)
        self.k, self.names = k, held["names"]
        self.codes, block, n, self.who, self.weight = (held[c].to_numpy() for c in ("code", "block", "n", "who", "weight"))
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        sizes = [int(self.who[self.starts[lo]:self.ends[hi - 1]].max()) + 1 for lo, hi in zip(edges, edges[1:])]
        self.base = np.r_[0, np.cumsum(sizes)]
        self.blocks = list(zip(edges, edges[1:], self.base, self.base[1:]))
        self.block = block[edges[:-1]]
        self.floor = np.zeros(self.base[-1])        # a place that the k-th best has reached
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], id_type))

    def meet(self, value: pa.Scalar, gain: Callable, width: int) -> None:
        part = _from_bytes(value)
        tiles = _tiles(part, self.names, gain, width)
        found = []
        for lo, hi, q0, q1 in self.blocks:
            best = np.full((2, q1 - q0, self.k), -1, np.int64)
            for first, size, terms, p0, p1, pos, gains in tiles:
                at = np.minimum(np.searchsorted(terms, self.codes[lo:hi]), len(terms) - 1)
                both = np.flatnonzero(terms[at] == self.codes[lo:hi])
                if len(both):
                    rows = (p0[at[both]], p1[at[both]], self.starts[lo:hi][both], self.ends[lo:hi][both])
                    best = _kept(best, _summed(*rows, pos, gains, self.who, self.weight, q1 - q0, size), first, self.floor[q0:q1])
            q, n = np.nonzero(best[0] >= 0)
            found.append((q + q0, best[0][q, n], best[1][q, n]))
        query, places, row = (np.concatenate(c) for c in zip(*found))
        if len(query):
            self._merge(query, places, part["ids"].take(pa.array(row)))

    def _merge(self, query: np.ndarray, places: np.ndarray, ids: pa.Array) -> None:
        """The k best of those kept and a part's, ties to the lower id."""
        met = np.zeros(len(self.floor), bool)
        met[query] = True
        again = np.flatnonzero(met[self.best[0]])
        stay = np.flatnonzero(~met[self.best[0]])
        rows = pa.table({"doc_id": pa.concat_arrays([self.best[2].take(pa.array(again)), ids])})
        by_id = _id_order(rows)
        query, places = np.r_[self.best[0][again], query][by_id], np.r_[self.best[1][again], places][by_id]
        order = np.lexsort((-places, query))
        query, places = query[order], places[order]
        some = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        kept = rows.column("doc_id").combine_chunks().take(pa.array(by_id[order][some]))
        self.best = (np.r_[self.best[0][stay], query[some]], np.r_[self.best[1][stay], places[some]],
                     pa.concat_arrays([self.best[2].take(pa.array(stay)), kept]))
        full = np.flatnonzero(np.bincount(self.best[0], minlength=len(self.floor)) >= self.k)
        least = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(least, self.best[0], self.best[1])
        self.floor[full] = least[full]

    def found(self) -> pa.RecordBatch:
        query, places, ids = self.best
        of = np.searchsorted(self.base, query, side="right") - 1
        return pa.record_batch([pa.array(self.block[of]), pa.array((query - self.base[of]).astype(np.int32)), ids, pa.array(places / 10.0**DIGITS)],
                               names=["_block", "_qn", "doc_id", "score"])


def _all_best(k: int, gain: Callable, width: int, doc_id: T.StructField) -> Callable:
    """The k best documents of all parts of a task for each query that they meet, ties to the lower id."""
    id_type = to_arrow_type(doc_id.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Asked] = {}
        for batch in batches:
            for some, part, asked in zip(batch.column("_super").to_pylist(), batch.column("part"), batch.column("asked")):
                if some not in held:
                    held[some] = _Asked(asked, k, id_type)
                held[some].meet(part, gain, width)
        for asked in held.values():
            found = asked.found()
            yield from (found.slice(at, 10_000) for at in range(0, len(found), 10_000))
    return run


def _tiles(part: dict[str, pa.Array], names: pa.Array, gain: Callable, width: int) -> list[tuple]:
    """Tiles of ``width`` rows: first row, rows, the asked terms in it, bounds of their entries, and all entries' places and gains."""
    run, first, pos, tf, dl = (part[c].to_numpy() for c in ("run", "first", "pos", "tf", "dl"))
    code = pc.fill_null(pc.index_in(part["names"], value_set=names), -1).to_numpy()
    tile, code = run // max(1, len(code)), code[run % max(1, len(code))]
    last = np.r_[first[1:], len(pos)]
    gains = gain(tf, dl[np.repeat(tile, last - first) * width + pos])
    some = np.flatnonzero(code >= 0)
    tile, code, first, last = tile[some], code[some], first[some].astype(np.int64), last[some].astype(np.int64)
    edges = np.searchsorted(tile, np.arange(-(-len(dl) // width) + 1))
    return [(t * width, min(width, len(dl) - t * width), code[lo:hi], first[lo:hi], last[lo:hi], pos, gains)
            for t, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]


def _kept(best: np.ndarray, scores: np.ndarray, first: int, floor: np.ndarray) -> np.ndarray:
    """The k best of those kept (places after rounding, rows) and a tile's; its rows are higher than all before, and what is below ``floor`` may go."""
    n, k = best.shape[1:]
    # a score goes on if it rounds to more than the k-th kept, and to the floor at least
    q, at = np.nonzero(scores > np.maximum(np.maximum(best[0][:, -1:] + 0.4, floor[:, None] - 0.6) / 10.0**DIGITS, 0.0))
    if not len(q):
        return best
    if len(q) > 8 * k * n:
        width = scores.shape[1]
        order = np.where(scores > 0, np.floor(scores * 10.0**DIGITS + 0.5) * width + np.arange(width)[::-1], -1.0)
        at = np.argpartition(-order, min(k, width) - 1, axis=1)[:, :k]
        q, at = np.repeat(np.arange(n), at.shape[1]), at.ravel()
        some = scores[q, at] > 0
        q, at = q[some], at[some]
    old, place = np.nonzero(best[0] >= 0)
    q = np.r_[old, q]
    places = np.r_[best[0][old, place], np.floor(scores[q[len(old):], at] * 10.0**DIGITS + 0.5).astype(np.int64)]
    rows = np.r_[best[1][old, place], at + first]
    order = np.lexsort((rows, -places, q))
    q, places, rows = q[order], places[order], rows[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    some = nth < k
    out = np.full_like(best, -1)
    out[0, q[some], nth[some]], out[1, q[some], nth[some]] = places[some], rows[some]
    return out


def _tile_scores(gain: Callable) -> Callable:
    def run(met: pa.Table, pairs: pa.Table) -> pa.Table:
        qn, pos = (pairs.column(c).to_numpy() for c in ("_qn", "pos"))
        order = np.argsort(qn, kind="stable")
        qn, pos = qn[order], pos[order]
        scores = np.zeros(len(qn))
        if len(qn) and met.num_rows:
            flat, rows = _columns(met, ["pos", "tf", "dl"], ["_qn", "weight"])
            gains = gain(flat["tf"], flat["dl"])
            first, n = np.searchsorted(qn, flat["_qn"]), np.searchsorted(qn, flat["_qn"], side="right")
            n = n - first
            for p0, p1, q0, q1 in rows:
                size = n[q0:q1]
                mine = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[q0:q1], size)
                by = np.argsort(flat["pos"][p0:p1])
                posts = flat["pos"][p0:p1][by]
                at = np.minimum(np.searchsorted(posts, pos[mine]), len(posts) - 1)
                has = posts[at] == pos[mine]
                scores[mine[has]] += np.repeat(flat["weight"][q0:q1], size)[has] * gains[p0:p1][by][at[has]]
        q1, q2, tile = (pairs.column(c).to_numpy()[order] for c in (*QID, "tile"))
        places = np.floor(scores * 10.0**DIGITS + 0.5)
        return pa.table({"_q1": q1, "_q2": q2, "tile": tile, "pos": pos, "score": places / 10.0**DIGITS})
    return run


def _with_copies(index: SearchIndex, best: DataFrame, k: int) -> DataFrame:
    """Put the copies of found documents back: of each, the k lowest ids are enough."""
    found = index.groups.filter("n > 1").join(best.select("doc_id").distinct(), "doc_id", "left_semi").select("digest", "doc_id")
    by_id = W.partitionBy("digest").orderBy("member")
    members = (
        index.forward.select("digest", F.col("doc_id").alias("member"))
        .join(found, "digest").filter("member <> doc_id")
        .withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") < k)
        .select("doc_id", "member")
    )
    copies = best.join(members, "doc_id").select(*QID, F.col("member").alias("doc_id"), "score")
    return _best(best.select(*QID, "doc_id", "score").unionByName(copies), "score", k, QID)
