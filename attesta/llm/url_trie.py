"""URL filters: a trie over reversed host labels and path segments, walked to the longest rule that fits.

Trie. A rule's host is cut at its dots and read from the right, so a rule lies on the way to all its subdomains;
from a host's node the path goes on by segments, each with its closing slash. What a rule's path has after its last slash
is a tail: it fits by text, as paths need not end at a segment. Host labels start with a dot and segments end with a
slash, so neither can be taken for the other. Walking a URL costs its labels and segments, whatever the number of rules.

Precedence. The rule with the most host labels wins, then the one with the longest path; allow and block entries
are alike in this. Of two entries for the same host and path, block wins.

Scale. No shuffle: the trie is broadcast after its bytes are counted (``TRIE_BYTES``). Beyond that, distinct
(host, path) pairs are joined with the rules on every (host suffix, path up to a slash), with hot stems
salted; the same rule wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path; only A-Z of a host are lower-cased; ports,
user names and empty labels are part of the host's text; a rule with a null or empty host fits every host, one with a
null or empty path every path; a rule with a null verdict is ignored; without rules, and where none fits,
the verdict is ``default`` and the rule null. Repeated rows each get their result; other columns pass through, and
columns named like the results (``RESULT``) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import ascii_lower, fresh, whole
from attesta.operators.skew import hot_keys, salted_join

RESULT = ["host", "path", "rule", "verdict"]
URL = r"://([^/?#]*)([^?#]*)"
#: Bytes of rule text, with an allowance for each entry, up to which the trie is broadcast.
TRIE_BYTES = 32 << 20
ENTRY_BYTES = 64
HOT_ROWS = 100_000
HERE, TAILS = 0, 1  # a node's own entry and its unfinished segments; children have string keys
SEGMENT = re.compile(r"[^/]*/")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path), block before allow; nulls as stated above."""
    named = rules.filter(F.col("verdict").isNotNull()).select(
        ascii_lower(whole("host")).alias("r_host"), whole("path").alias("r_path"), F.col("verdict").cast("string").alias("r_verdict"))
    return named.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))


def build(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Trie of (host, path, verdict) entries."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault("." + label, {})
        end = 0
        for piece in SEGMENT.finditer(path):
            node, end = node.setdefault(piece.group(), {}), piece.end()
        entry = (host + path, verdict)
        if end < len(path):
            node.setdefault(TAILS, {})[path[end:]] = entry
        else:
            node[HERE] = entry
    return root


def _along(node: dict, path: str) -> tuple[str, str] | None:
    """The entry with the longest path that ``path`` starts with."""
    best, end = None, 0
    while node is not None:
        best = node.get(HERE, best)
        tails = node.get(TAILS)
        if tails:
            rest = path[end:path.find("/", end) + 1 or len(path)]
            for size in sorted({len(t) for t in tails}, reverse=True):
                if rest[:size] in tails:
                    best = tails[rest[:size]]
                    break
        piece = SEGMENT.match(path, end)
        if not piece:
            break
        node, end = node.get(piece.group()), piece.end()
    return best


def longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The winning (rule, verdict) for a URL, or None."""
    nodes = [trie]
    for label in reversed(host.split(".")) if host else ():
        node = nodes[-1].get("." + label)
        if node is None:
            break
        nodes.append(node)
    for node in reversed(nodes):
        found = _along(node, path)
        if found:
            return found
    return None


def _by_trie(df: DataFrame, trie: dict) -> Column:
    held = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def walk(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        none = (None, None)
        found = [longest(held.value, h, p) or none for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)
    return walk(F.col("host"), F.col("path"))


def _by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) with the winning rule, by joining every stem of a URL with the rules."""
    stem = F.regexp_extract("r_path", r"(?s)^(.*/)?", 0)
    keyed = rules.select(F.col("r_host").alias("k_host"), stem.alias("k_stem"), F.substr("r_path", F.length(stem) + 1).alias("tail"),
                         "r_path", "r_verdict")
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    parts = F.split("path", "/")
    stems = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    urls = df.select("host", "path").distinct()
    wide = (urls.withColumn("k_host", F.explode(suffixes)).withColumn("k_stem", F.explode(stems))
            .join(keyed.select("k_host", "k_stem").distinct(), ["k_host", "k_stem"], "left_semi"))
    met = salted_join(wide, keyed, ["k_host", "k_stem"], hot_keys(wide, ["k_host", "k_stem"], HOT_ROWS), ["host", "path"])
    fits = met.filter(F.startswith(F.substr("path", F.length("k_stem") + 1), F.col("tail")))
    depth = F.when(F.col("k_host") == "", 0).otherwise(F.size(F.split("k_host", r"\.")))
    best = F.max_by(F.struct(F.concat("k_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")),
                    F.struct(depth.alias("depth"), F.length("r_path").alias("size")))
    return fits.groupBy("host", "path").agg(best.alias("best"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``pages`` with host, path, the winning rule (host and path) and the verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``).
    """
    (url, best) = fresh(pages, "__url", "__best")
    parts = pages.withColumn(url, whole(url_col)).drop(*RESULT)
    parts = parts.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop(url)
    cleaned = clean_rules(rules)
    size = F.sum(F.octet_length("r_host") + F.octet_length("r_path") + ENTRY_BYTES)
    if (cleaned.agg(size).first()[0] or 0) <= trie_bytes:
        found = parts.withColumn(best, _by_trie(parts, build(map(tuple, cleaned.collect()))))
    else:
        joined = _by_join(parts, cleaned).withColumnsRenamed({"host": "__h", "path": "__p", "best": best})
        found = parts.join(joined, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")
    return found.withColumns({"rule": F.col(best)["rule"], "verdict": F.coalesce(F.col(best)["verdict"], F.lit(default))}).drop(best)
