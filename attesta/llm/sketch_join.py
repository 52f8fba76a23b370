"""Near duplicates by parity sketches: texts whose shingle sets have a Jaccard similarity of at least 3/4.

Sketch. Shingles are dealt by hash into the words of a sketch; a word is the XOR of the 64-bit hashes of the shingles
dealt to it. One shingle on one side only changes one word, so the number of differing words
(the sketches' Hamming distance, counted in words) is a lower bound of the symmetric difference.

Pigeonhole. Sizes fall into bands of ratio 4/3, so linked sets lie in one band or in neighbours, and
each set sends its sketch under its own band and the one below. Linked sets a, b differ in at most
(a+b)/7 shingles; a set with more non-empty words than it may have differences shares one of them with any partner.

Frequent words. A sketch word in more than ``GROUP`` sets makes no pairs. That loses nothing while a set keeps enough
other words (more than its differences). Sets that do not are sketched again among themselves, one shingle a word;
those still without enough are compared through the rarest of their frequent words, as many as it takes: first with the most central
sets of each group, then across what is not yet connected, where the numbers of frequent words allow a link.

Verification. Equal sets are one class. Members of a word's group are paired with its ends; what is linked is one component,
then pairs across components follow. Pairs inside a component are never made. A pair is first tried on parity
sketches of about one bit a shingle: if their Hamming distance exceeds the differences allowed, it cannot link. The rest is
decided on the whole sets.

Scale. Sketch words travel packed by hash bucket; the number of buckets follows the bytes of text. A frequent word is
cut to ``GROUP + 1`` sets per map task, the rest bypasses its bucket. Shingles and sets are compared by 64-bit hashes.

Defined cases: null and empty texts (no words) have an empty set and link with nothing; fewer than five words are one
shingle; equal texts and repeated rows are one class; a null id takes part and is the smallest id of a component only
if no other is there; an empty table gives an empty result; further columns are ignored, and kept by ``drop_near``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attesta.llm import shingles
from attesta.llm.words import fresh, row_slices, tidied, whole
from attesta.operators.staging import stage

GROUP = 32
BUCKET_WORDS = 1_000_000
FLUSH = 400_000
SENT = 4 << 20
FINE_BELOW = 32
LOW = np.uint64(0xFFFFFFFFFF)
_TAG = 0xD6E8FEB86659FD93


def _bands(up_to: int) -> np.ndarray:
    """Last size of every band."""
    ends = [1]
    while ends[-1] < up_to:
        ends.append((ends[-1] + 1) * 4 // 3)
    return np.array(ends, np.int64)


BANDS = _bands(2**40)


def keys_of(n: int) -> list[tuple[int, int, int]]:
    """(band, last size of the band, most differences from a partner) for every band a set is sketched under."""
    own = int(np.searchsorted(BANDS, n))
    found = [(own, int(BANDS[own]), (n + n * 4 // 3) // 7)]
    if own and n <= int(BANDS[own - 1]) * 4 // 3:
        end = int(BANDS[own - 1])
        found.append((own - 1, end, (n + end) // 7))
    return found


def sketch(found: np.ndarray, band: int, end: int) -> np.ndarray:
    """Non-empty sketch words under a band, with their places mixed in. ``found`` is sorted."""
    tag = np.uint64((band + 1) * _TAG % 2**64)
    if end < FINE_BELOW:
        return shingles.mix(found + tag)
    places = ((found >> np.uint64(32)) * np.uint64((end + 1) // 2)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return shingles.mix(np.bitwise_xor.reduceat(found, cut) + shingles.mix(places[cut] + tag))


def sent_words(words: np.ndarray, bits: int) -> int:
    """How many of these words differ as they are sent: by the ``bits`` of their bucket and the 40 low ones."""
    home = words >> np.uint64(64 - bits) if bits else np.zeros(len(words), np.uint64)
    return len(np.unique(home << np.uint64(40) | words & LOW))


def slack(found: np.ndarray, bits: int) -> int:
    """How many of a set's sent words may be too frequent before a link could be missed: a partner lacks as many as it has differences."""
    return min(sent_words(sketch(found, band, end), bits) - most - 1 for band, end, most in keys_of(len(found)))


def fine_slack(found: np.ndarray, bits: int) -> int:
    """The same with one shingle a word: a partner lacks a quarter of a set's own shingles at most."""
    return sent_words(shingles.mix(found), bits) - len(found) // 4 - 1


def parity(found: np.ndarray) -> bytes:
    """Bit sketch: each shingle flips one of m bits, m the power of two from the set's size up (64 at least)."""
    m = 1 << max(6, int(len(found) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Differing bits; a longer sketch is folded to the shorter one's length. Never above the symmetric difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


PROFILE = "key long, doc_id long, text_hash long, cls long, n long, slack long, fine_slack long, bits binary"


def _profiles(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            rows = [(shingles.fingerprint(s), len(s), slack(s, bits), fine_slack(s, bits), parity(s)) if len(s) else (None, 0, 0, 0, None)
                    for _, s in shingles.shingle_sets(batch.column("text"))]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "doc_id", "text_hash")], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["key", "doc_id", "text_hash", "cls", "n", "slack", "fine_slack", "bits"])
    return run


def _packed(words: np.ndarray, owner: np.ndarray, classes: np.ndarray, bits: int, salt: int) -> Iterator[tuple]:
    """Rows (bucket, home, classes, counts, low, high) of one flush; see ``_sketches``."""
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    new = np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])]) if len(words) else np.zeros(0, bool)
    words, owner = words[new], owner[new]
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, int)
    runs = np.diff(np.concatenate([starts, [len(words)]]))
    rank = np.arange(len(words)) - np.repeat(starts, runs)
    home = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    away = rank > GROUP
    for past in (False, True):
        pick = np.flatnonzero(away == past)
        pick = pick[np.lexsort((owner[pick], home[pick]))]
        h, o, w = home[pick], owner[pick], words[pick]
        cuts = np.flatnonzero(np.diff(h)) + 1
        for part in np.split(np.arange(len(pick)), cuts) if len(pick) else []:
            who, counts = np.unique(o[part], return_counts=True)
            low = w[part] & LOW
            yield (-1 - salt if past else int(h[part[0]]), int(h[part[0]]), classes[who].tobytes(), counts.astype(np.uint32).tobytes(),
                   (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint8).tobytes())


PACKED = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("classes", pa.binary()), ("counts", pa.binary()),
                    ("low", pa.binary()), ("high", pa.binary())])


def _sketches(bits: int, fine: bool) -> Callable:
    """Sketch words of all sets of a task, packed per bucket. A word held by more than GROUP sets here is frequent:
    what exceeds GROUP + 1 goes out under a bucket of its own (``bucket`` is not ``home``) and is only passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, owners, classes, seen, size = [], [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                ids = np.array(classes, np.int64)
                made, owned = np.concatenate(words), np.concatenate(owners)
                words.clear(), owners.clear(), classes.clear(), seen.clear()
                rows, held = [], 0
                for row in _packed(made, owned, ids, bits, int(abs(ids[0])) % 1024):
                    rows.append(row)
                    held += sum(len(c) for c in row[2:])
                    if held >= SENT:
                        yield sent(rows)
                        rows, held = [], 0
                if rows:
                    yield sent(rows)

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKED)], schema=PACKED)

        for batch in batches:
            for _, found in shingles.shingle_sets(batch.column("text")):
                if not len(found) or (cls := shingles.fingerprint(found)) in seen:
                    continue
                seen[cls] = len(classes)
                classes.append(cls)
                for made in [shingles.mix(found)] if fine else [sketch(found, band, end) for band, end, _ in keys_of(len(found))]:
                    words.append(made)
                    owners.append(np.full(len(words[-1]), seen[cls], np.int32))
                    size += len(words[-1])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
    return run


GROUPS = "members array<long>, word long, cls long"


def _meet(table: pa.Table) -> pa.Table:
    """Groups of sets that share a sketch word (``members``), and frequent words with their sets (``word``, ``cls``)."""
    members, hot_word, hot_cls = [], [], []
    words, classes, homes, passed = [], [], [], []
    for bucket, home, cls, counts, low, high in zip(*(table.column(c).to_pylist() for c in PACKED.names)):
        w = np.frombuffer(low, np.uint32).astype(np.int64) | (np.frombuffer(high, np.uint8).astype(np.int64) << 32)
        c = np.repeat(np.frombuffer(cls, np.int64), np.frombuffer(counts, np.uint32))
        if bucket != home:
            hot_word.append(w | (home << 40))
            hot_cls.append(c)
        else:
            words.append(w)
            classes.append(c)
    if words:
        home = table.column("home")[0].as_py()
        w, c = np.concatenate(words), np.concatenate(classes)
        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        same = np.concatenate([[False], w[1:] == w[:-1]])
        multi = same | np.concatenate([same[1:], [False]])
        w, c = w[multi], c[multi]
        order = np.lexsort((c, w))
        w, c = w[order], c[order]
        if len(w):
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])])
            w, c = w[new], c[new]
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            runs = np.diff(np.concatenate([starts, [len(w)]]))
            hot = np.repeat(runs > GROUP, runs)
            hot_word.append(w[hot] | (home << 40))
            hot_cls.append(c[hot])
            keep = np.flatnonzero((runs > 1) & (runs <= GROUP))
            mark = np.add.reduceat(shingles.mix(c.view(np.uint64)), starts)  # many words have the same members
            keep = keep[np.unique(mark[keep], return_index=True)[1]]
            members = [c[s:s + r] for s, r in zip(starts[keep], runs[keep])]
    hw = np.concatenate(hot_word) if hot_word else np.zeros(0, np.int64)
    hc = np.concatenate(hot_cls) if hot_cls else np.zeros(0, np.int64)
    nulls = pa.nulls(len(hw), pa.list_(pa.int64()))
    none = pa.nulls(len(members), pa.int64())
    return pa.table({"members": pa.concat_arrays([pa.array(members, pa.list_(pa.int64())), nulls]),
                     "word": pa.concat_arrays([none, pa.array(hw)]), "cls": pa.concat_arrays([none, pa.array(hc)])})


def _bucket_bits(total: int) -> int:
    """Buckets, as a power of two, for so many bytes of text."""
    return min(23, max(0, int(np.ceil(np.log2(max(1, total / 7 / BUCKET_WORDS))))))


def _shared(texts: DataFrame, bits: int, fine: bool) -> DataFrame:
    packed = texts.mapInArrow(tidied(_sketches(bits, fine)),
                              "bucket int, home int, classes binary, counts binary, low binary, high binary")
    return stage(packed.groupBy("bucket").applyInArrow(_meet, GROUPS), "shared")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "text"):
        rows = [(shingles.fingerprint(s), s.tobytes()) for _, s in shingles.shingle_sets(batch.column("text")) if len(s)]
        if rows:
            cls, found = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(found, pa.binary())], names=["cls", "found"])


def _passed(test: Callable, *names: str) -> Callable:
    """Pairs (a, b) for which ``test`` of the named columns' values holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            ok = [test(*values) for values in zip(*(batch.column(c).to_pylist() for c in names))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _may_link(na: int, nb: int, x: bytes, y: bytes) -> bool:
    return 7 * hamming(x, y) <= na + nb


def _link(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _beside(pairs: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
    """Pairs with the named columns of both classes (suffixed by side)."""
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names]), side)
    return pairs


def verified(pairs: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link: by size, then by bit sketch, then by their whole sets."""
    sized = (_beside(pairs, known.select("cls", "n"), "n")
             .filter((F.col("n_a") * 4 >= F.col("n_b") * 3) & (F.col("n_b") * 4 >= F.col("n_a") * 3)))
    left = stage(_beside(sized, known.select("cls", "bits"), "bits").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
                 .mapInArrow(_passed(_may_link, "n_a", "n_b", "bits_a", "bits_b"), "a long, b long"), "near-pairs")
    named = left.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = stage(known.join(named, "cls", "left_semi").select("key").distinct(), "keys")
    sets = stage(texts.join(keys, "key", "left_semi").select("text").mapInArrow(tidied(_sets), "cls long, found binary").dropDuplicates(["cls"]), "sets")
    return _beside(left, sets, "found").select("a", "b", "found_a", "found_b").mapInArrow(_passed(_link, "found_a", "found_b"), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cls, root) for every class in a link: minimum labels with pointer jumping, each round staged."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.col("cls")).alias("root")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("cls").alias("b"), F.col("root").alias("r")), "b")
                .groupBy(F.col("a").alias("cls")).agg(F.min("r").alias("r")))
        low = labels.join(near, "cls").select("cls", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("cls").alias("root"), F.col("root").alias("r"))
        after = stage(low.join(jump, "root", "left")
                      .select("cls", F.least("root", "r").alias("root"), "was"), "labels")
        labels = after.select("cls", "root")
        if after.filter(F.col("root") != F.col("was")).isEmpty():
            return labels


def _ends(groups: DataFrame) -> DataFrame:
    """Pairs of every member with the first and the last one."""
    pairs = [groups.select(end("members").alias("a"), F.explode("members").alias("b")) for end in (F.array_min, F.array_max)]
    return _ordered(pairs[0].unionByName(pairs[1]))


def _ordered(pairs: DataFrame) -> DataFrame:
    return (pairs.filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: doc_id, text_hash, n_shingles, cls (null: no shingles), component_id, kept (it is its component's first by id, then text hash;
    rows without an id come last)."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(whole(text_col))).alias("key"),
                        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_hash"), whole(text_col).alias("text"))
    bits = _bucket_bits(docs.select(F.sum(F.octet_length(whole(text_col)))).first()[0] or 0)
    profiles = stage(texts.mapInArrow(tidied(_profiles(bits)), PROFILE), "profiles")
    shared = _shared(texts.select("text"), bits, False)
    groups, hot = _split(shared)

    def keys(classes: DataFrame) -> DataFrame:
        return stage(profiles.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key")).select("key").distinct(), "keys")

    def had(slack: str) -> DataFrame:
        return profiles.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(slack).alias("slack"))

    def short(hot: DataFrame, slack: str) -> DataFrame:
        """Classes that may not have enough words left for every link to be found by them."""
        counts = hot.groupBy("cls").agg(F.count(F.lit(1)).alias("hot"))
        return had(slack).join(counts, "cls", "left").filter(F.coalesce("hot", F.lit(0)) > F.col("slack")).select("cls")

    few = stage(short(hot, "slack"), "short")
    crowded = None
    if not few.isEmpty():
        again = texts.join(keys(few), "key", "left_semi").select("text")
        more, hot = _split(_shared(again, bits, True))
        groups = groups.unionByName(more).distinct()
        rest = short(hot, "fine_slack").join(few, "cls", "left_semi")
        crowded = stage(_rarest(hot, rest.join(had("fine_slack"), "cls")), "crowded")
        reach = stage(_reach(hot, profiles.filter(F.col("cls").isNotNull()).select("cls", "n", "fine_slack").dropDuplicates(["cls"])), "reach")
    groups = stage(groups, "groups")
    pairs = _ends(groups)
    named = groups.select(F.explode("members").alias("cls"))
    if crowded is not None:
        # the member with the most frequent words is the most central one of its family
        weight = crowded.groupBy("cls").agg(F.count(F.lit(1)).alias("weight"))
        hubs = crowded.join(weight, "cls").groupBy("word").agg(F.max("cls").alias("last"), F.max_by("cls", F.xxhash64("cls")).alias("other"), F.max_by("cls", F.struct("weight", "cls")).alias("hub"))
        star = crowded.join(hubs, "word").select(F.explode(F.array("hub", "last", "other")).alias("a"), F.col("cls").alias("b"))
        pairs = pairs.unionByName(_ordered(star)).distinct()
        named = named.unionByName(crowded.select("cls"))
    known = stage(profiles.join(named.distinct(), "cls", "left_semi").select("cls", "key", "n", "bits").dropDuplicates(["cls"]), "known")
    pairs = stage(pairs, "pairs")
    links = stage(verified(pairs, known, texts), "links")
    labels = components(links)
    across = _across(groups.withColumn("g", F.xxhash64("members")).select("g", F.explode("members").alias("cls")), labels)
    if crowded is not None:
        across = across.unionByName(_between(crowded.join(reach, "cls"), labels)).distinct()
    second = stage(verified(across.join(pairs, ["a", "b"], "left_anti"), known, texts), "links")
    if not second.isEmpty():
        labels = components(links.unionByName(second))
    rooted = profiles.join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    least = stage(rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(own).alias("least")), "least")
    return rooted.join(least, "root", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls", F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        F.coalesce(own == F.col("least"), F.lit(True)).alias("kept"))


def _rarest(hot: DataFrame, rest: DataFrame) -> DataFrame:
    """Of the sets in ``rest`` (with their ``slack``) as many of their rarest frequent words as they lack others: linked
    sets share one of their n//4 + 1 rarest words, in one order for all."""
    mine = hot.join(rest, "cls")
    frequency = hot.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    order = W.partitionBy("cls").orderBy("df", "word")
    ranked = mine.join(frequency, "word").withColumns({
        "rank": F.row_number().over(order), "hot": F.count(F.lit(1)).over(W.partitionBy("cls"))})
    return ranked.filter(F.col("rank") <= F.col("hot") - F.col("slack")).select("word", "cls")


def _split(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (shared.filter(F.col("members").isNotNull()).select("members").distinct(),
            shared.filter(F.col("word").isNotNull()).select("word", "cls").distinct())


def _across(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a group's members that lie in different components; groups within one component make none."""
    named = rows.join(labels, "cls", "left").select("g", "cls", F.coalesce("root", "cls").alias("root"))
    open_ = named.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
    left = named.join(open_, "g", "left_semi")
    right = left.select("g", F.col("cls").alias("cls2"), F.col("root").alias("root2"))
    return _ordered(left.join(right, "g").filter("root < root2").select(F.col("cls").alias("a"), F.col("cls2").alias("b")))


def _reach(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cls, n, reach): ``reach`` is the size of the largest set that a class may link with by frequent words alone.

    A pair with a rarer word in common meets in a group. Any other pair shares at most the frequent words of either set,
    and a link needs 3/7 of both sizes. Frequent words are counted as they are sent; what a set's words lose by that
    (``n`` less the words that differ, which ``fine_slack`` tells) is added.
    """
    merged = F.col("n") - (F.col("fine_slack") + 1 + F.floor(F.col("n") / 4))
    counts = hot.groupBy("cls").agg(F.count(F.lit(1)).alias("hot"))
    return counts.join(sizes, "cls").select("cls", "n", (F.floor((F.col("hot") + merged) * 7 / 3) - F.col("n")).alias("reach"))


def _between(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs across every two components that share a frequent word and may link by frequent words alone (``reach``):
    words meet as component pairs, which then open up."""
    named = crowded.join(labels, "cls", "left").select("word", "cls", "n", "reach", F.coalesce("root", "cls").alias("root"))
    met = named.groupBy("word", "root").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    fits = (F.col("reach") >= F.col("n2")) & (F.col("reach2") >= F.col("n"))
    two = (met.join(_second(met), ["word"]).filter((F.col("root") < F.col("root2")) & fits).select("root", "root2").distinct())
    members = stage(named.select("root", "cls", "n", "reach").distinct(), "members")
    return _ordered(two.join(members, "root").join(_second(members), "root2").filter(fits).select(F.col("cls").alias("a"), F.col("cls2").alias("b")))


def _second(rows: DataFrame) -> DataFrame:
    return rows.select([F.col(c) if c == "word" else F.col(c).alias(f"{c}2") for c in rows.columns])


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, its first by id and text hash (rows without shingles all stay). Rows are told apart by id
    and text, so another text with a lost row's id stays; rows equal in both stay or go together."""
    names = fresh(docs, "__id", "__text")
    found = near_components(docs, id_col, text_col)
    lost = stage(found.filter(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_text")).distinct(), "lost")
    marked = docs.withColumns({names[0]: F.col(id_col).cast("long"), names[1]: F.xxhash64(whole(text_col))})
    same = F.col(names[0]).eqNullSafe(F.col("lost_id")) & (F.col(names[1]) == F.col("lost_text"))
    return marked.join(lost, same, "left_anti").drop(*names)
