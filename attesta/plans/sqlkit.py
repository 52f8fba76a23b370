"""DuckDB fragments for the check queries: shared CTEs and text expressions.

The check tool runs one SQL string per query, so common derivations are CTEs
that a query names; ``with_ctes`` puts the needed ones in front.
"""

from __future__ import annotations

from attesta.functions.text import NEGATIONS

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(sql: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            add(need)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{sql}"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sents(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), "
            "lambda s: s <> '')")


def exploded(value: str, extra: str, source: str, name: str = "item", pos: str = "pos") -> str:
    """SELECT extra, 0-based position and element of a list expression, per row of source."""
    return (f"SELECT {extra}, generate_subscripts(_l, 1) - 1 AS {pos}, unnest(_l) AS {name} "
            f"FROM (SELECT *, {value} AS _l FROM {source})")


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def neg_odd(x: str) -> str:
    return f"(len(list_filter({toks(x)}, lambda t: t IN {in_list(NEGATIONS)})) % 2 = 1)"


def nums(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: regexp_full_match(t, '[0-9]+'))"


def relation(h: str, p: str, ov: str, n: str) -> str:
    """The lexical rule over precomputed columns h_neg/p_neg, h_nums/p_nums."""
    return f"""CASE WHEN {n} = 0 OR {ov} * 10 < {n} * 6 THEN 'neutral'
      WHEN {h}_neg <> {p}_neg OR (len({p}_nums) > 0 AND
           len(list_filter({h}_nums, lambda t: NOT list_contains({p}_nums, t))) > 0) THEN 'contradiction'
      WHEN {ov} * 10 >= {n} * 8 THEN 'entailment' ELSE 'neutral' END"""


# ---- the roles the tables play -------------------------------------------------

cte("claims", exploded(sents("text"), "item_id AS article_id, url", "(SELECT item_id, text, "
    "'https://bench.example.org/' || item_id AS url FROM benchmark)", "claim", "claim_id"))
cte("sources", "SELECT doc_id, 'https://' || source || '.example.org/' || doc_id AS url, text, source, lang "
    "FROM documents")
cte("source_claims", exploded(sents("text"), "doc_id, url", "sources", "source_claim", "source_claim_id"),
    "sources")
cte("postings", f"""SELECT doc_id, dl, term, count(*) AS tf FROM (
    SELECT doc_id, len(_t) AS dl, unnest(_t) AS term FROM (SELECT doc_id, {toks('text')} AS _t FROM sources))
    GROUP BY ALL""", "sources")
cte("corpus", f"SELECT count(*) AS n, avg(len({toks('text')})) AS avgdl FROM sources", "sources")


def bm25(queries: str, keys: str, text: str, postings: str = "postings", corpus: str = "corpus",
         doc: str = "doc_id", k: int = 10) -> str:
    """Brute force: every document, no pruning."""
    return f"""SELECT {keys}, search_rank, {doc}, score FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {doc}) AS search_rank FROM (
        SELECT {keys}, {doc}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM (SELECT DISTINCT {keys}, unnest({toks(text)}) AS term FROM {queries}) q
        JOIN (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM {postings}) p USING (term)
        CROSS JOIN {corpus} c GROUP BY {keys}, {doc})) WHERE search_rank <= {k}"""


cte("hits", "SELECT h.*, s.url FROM (" + bm25("claims", "article_id, claim_id", "claim")
    + ") h JOIN sources s USING (doc_id)", "claims", "postings", "corpus", "sources")
cte("pairs_all", f"""SELECT *, {relation('h', 'p', 'ov', 'n')} AS relation,
      CASE WHEN n = 0 THEN 1.0 ELSE round(1.0 - ov / n, 6) END AS dist FROM (
      SELECT h.article_id, h.claim_id, h.search_rank, h.doc_id, h.url, s.source_claim_id, s.source_claim,
        h_neg, p_neg, h_nums, p_nums, len(h_t) AS n, len(list_intersect(h_t, p_t)) AS ov
      FROM (SELECT hits.*, list_distinct({toks('claim')}) AS h_t, {neg_odd('claim')} AS h_neg, {nums('claim')} AS h_nums
            FROM hits JOIN claims USING (article_id, claim_id)) h
      JOIN (SELECT *, list_distinct({toks('source_claim')}) AS p_t, {neg_odd('source_claim')} AS p_neg,
            {nums('source_claim')} AS p_nums FROM source_claims) s USING (doc_id))""",
    "hits", "claims", "source_claims")
cte("pairs", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id, doc_id
      ORDER BY dist, source_claim_id) AS dist_rank FROM pairs_all) WHERE dist_rank <= 5""", "pairs_all")
cte("first_hit", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, claim_id
      ORDER BY search_rank, dist_rank) AS rn FROM pairs WHERE relation <> 'neutral') WHERE rn = 1""", "pairs")
cte("decided", """SELECT c.article_id, c.claim_id, c.claim,
      CASE relation WHEN 'entailment' THEN 'supported' WHEN 'contradiction' THEN 'contradicted'
        ELSE 'unverified' END AS verdict,
      f.doc_id, f.url AS source_url, f.source_claim_id, f.source_claim, f.search_rank, f.dist_rank, f.dist
      FROM claims c LEFT JOIN first_hit f USING (article_id, claim_id)""", "claims", "first_hit")
