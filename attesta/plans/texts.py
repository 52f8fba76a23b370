"""Queries over texts: chunks, sentences, claims, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import context as cx
from attesta.operators import segment as sg
from attesta.operators.staging import spread
from attesta.plans import tables as tb
from attesta.plans.registry import query
from attesta.plans.sqlkit import cte, exploded, in_list, sents, strip, toks, with_ctes
from attesta.sources import pages as pg

SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def documents(spark, sf):
    return spread(tb.table(spark, sf, "documents"), "doc_id")


@query("s01_article_text", """
    SELECT d.doc_id AS article_id, coalesce(nullif(b.text, ''), d.text) AS text, coalesce(b.text <> '', false) AS overridden
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def s01_article_text(spark, sf):
    given = tb.table(spark, sf, "benchmark").select(F.col("item_id").alias("article_id"), "text")
    loaded = tb.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return pg.article_text(loaded, given)


# ---- chunks: the check walks chunk by chunk over piece boundaries -----------------

def chunk_sql(size: int, overlap: int, source: str = "(SELECT doc_id, text FROM documents)") -> str:
    """Recursive check: every boundary's furthest end and next start first, then a walk along them."""
    def parts(x, sep):
        return f"list_filter(string_split(replace({x}, {sep}, chr(1) || {sep}), chr(1)), lambda p: p <> '')"

    def el(n, kind):
        return f"{{'len': {n}, 'kind': {kind}}}"

    fence = f"[{el('0', 1)}]"
    words = (f"flatten(list_transform({parts('q', chr(39) + ' ' + chr(39))}, lambda w: CASE WHEN length(w) < {size} "
             f"THEN [{el('length(w)', 0)}] ELSE list_concat({fence}, [{el('length(w)', 2)}], {fence}) END))")
    lines = (f"flatten(list_transform({parts('p', 'chr(10)')}, lambda q: CASE WHEN length(q) < {size} "
             f"THEN [{el('length(q)', 0)}] ELSE list_concat({fence}, {words}, {fence}) END))")
    paras = (f"flatten(list_transform({parts('text', 'chr(10) || chr(10)')}, lambda p: CASE WHEN length(p) < {size} "
             f"THEN [{el('length(p)', 0)}] ELSE list_concat({fence}, {lines}, {fence}) END))")
    stride = size - overlap
    return f"""WITH RECURSIVE elements AS (
      SELECT doc_id, generate_subscripts(_l, 1) AS i, unnest(_l, recursive := true) FROM (
        SELECT doc_id, {paras} AS _l FROM {source})),
    placed AS (SELECT doc_id, i, len, kind,
        sum(len) OVER w AS stop, sum(len) OVER w - len AS start,
        sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER w AS grp
      FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    groups AS MATERIALIZED (SELECT doc_id, grp, min(start) AS first, max(stop) AS last, max(kind) AS kind
      FROM placed WHERE kind <> 1 GROUP BY doc_id, grp),
    bounds AS MATERIALIZED (SELECT doc_id, grp, b, lead(b) OVER (PARTITION BY doc_id, grp ORDER BY b) AS nb,
        max(b) OVER (PARTITION BY doc_id, grp ORDER BY b RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) AS e
      FROM (SELECT doc_id, grp, stop AS b FROM placed WHERE kind = 0 UNION
            SELECT doc_id, grp, first FROM groups WHERE kind = 0)),
    ahead AS (SELECT x.doc_id, x.grp, x.b, x.e, greatest(x.e - {overlap}, y.nb - {size}) AS reach
      FROM bounds x JOIN bounds y ON y.doc_id = x.doc_id AND y.grp = x.grp AND y.b = x.e WHERE y.nb IS NOT NULL),
    jumps AS MATERIALIZED (SELECT a.doc_id, a.grp, a.b, t.b AS ns
      FROM ahead a ASOF JOIN bounds t ON t.doc_id = a.doc_id AND t.grp = a.grp AND t.b >= a.reach),
    walk AS (
      SELECT doc_id, grp, first AS s FROM groups WHERE kind = 0
      UNION ALL SELECT w.doc_id, w.grp, j.ns FROM walk w JOIN jumps j ON j.doc_id = w.doc_id AND j.grp = w.grp AND j.b = w.s),
    spans AS (
      SELECT w.doc_id, w.s, x.e FROM walk w JOIN bounds x ON x.doc_id = w.doc_id AND x.grp = w.grp AND x.b = w.s UNION ALL
      SELECT doc_id, first + j * {stride}, least(first + j * {stride} + {size}, last)
      FROM (SELECT *, unnest(range(0, greatest(ceil((last - first - {size}) / {stride}.0), 0)::BIGINT + 1)) AS j
            FROM groups WHERE kind = 2)),
    cut AS (SELECT doc_id, s, {strip('substr(text, (s + 1)::BIGINT, (e - s)::BIGINT)')} AS chunk
      FROM spans JOIN {source} d USING (doc_id))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_id, chunk FROM cut WHERE chunk <> ''"""


@query("t01_chunks", chunk_sql(1000, 200))
def t01_chunks(spark, sf):
    return sg.chunk_table(documents(spark, sf), ["doc_id"])


@query("t01_chunks_without_overlap", chunk_sql(500, 0))
def t01_chunks_without_overlap(spark, sf):
    return sg.chunk_table(documents(spark, sf), ["doc_id"], size=500, overlap=0)


def window_sql(width: int, overlap: int) -> str:
    stride = width - overlap
    return f"""SELECT doc_id, j + 1 AS chunk_id, array_to_string(w[j * {stride} + 1 : j * {stride} + {width}], ' ') AS chunk
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {overlap} - 1, 0) // {stride} + 1)) AS j
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS w FROM documents))
      WHERE len(w) > 0"""


@query("t02_word_windows", window_sql(200, 50))
def t02_word_windows(spark, sf):
    cut = F.posexplode(sg.word_windows(F.col("text"), 200, 50)).alias("pos", "chunk")
    return documents(spark, sf).select("doc_id", cut).select("doc_id", (F.col("pos") + 1).alias("chunk_id"), "chunk")


@query("n08_sliding_windows", window_sql(50, 25))
def n08_sliding_windows(spark, sf):
    cut = F.posexplode(sg.word_windows(F.col("text"), 50, 25)).alias("pos", "chunk")
    return documents(spark, sf).select("doc_id", cut).select("doc_id", (F.col("pos") + 1).alias("chunk_id"), "chunk")


cte("doc_sents", exploded(sents("text"), "doc_id", "documents", "sentence", "i"))
cte("doc_chunks", "SELECT * FROM (" + chunk_sql(1000, 200) + ")")


@query("t03_sentences", with_ctes("SELECT doc_id, i, sentence FROM doc_sents", "doc_sents"))
def t03_sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(tx.sentences("text")).alias("i", "sentence"))


@query("t04_claims_with_chunks", with_ctes(
    "SELECT doc_id, chunk_id, chunk, claim, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, pos) - 1 AS claim_id "
    "FROM (" + exploded(sents("chunk"), "doc_id, chunk_id, chunk", "doc_chunks", "claim") + ")", "doc_chunks"))
def t04_claims_with_chunks(spark, sf):
    return sg.claims_with_chunks(documents(spark, sf), ["doc_id"]).select(
        "doc_id", "chunk_id", "chunk", "claim", "claim_id")


@query("w04_positions", with_ctes(
    "SELECT doc_id, claim_id, chunk_no FROM (SELECT doc_id, chunk_id + 1 AS chunk_no, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, pos) - 1 AS claim_id "
    "FROM (" + exploded(sents("chunk"), "doc_id, chunk_id", "doc_chunks", "claim") + "))", "doc_chunks"))
def w04_positions(spark, sf):
    found = sg.claims_with_chunks(documents(spark, sf), ["doc_id"])
    return found.select("doc_id", "claim_id", (F.col("chunk_id") + 1).alias("chunk_no"))


@query("p06_texts_not_blank", f"SELECT doc_id, source, lang FROM documents WHERE {strip('text')} <> ''")
def p06_texts_not_blank(spark, sf):
    return tb.table(spark, sf, "documents").filter(~tx.is_blank("text")).select("doc_id", "source", "lang")


_CLAUSE = (f"list_filter(list_transform(string_split(regexp_replace({{0}}, '{sg.CLAUSE_CUT}', chr(1), 'g'), chr(1)), "
           f"lambda c: {strip('c')}), lambda c: c <> '')")


@query("m01_clause_claims", with_ctes(
    f"SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i, pos) - 1 AS claim_id, claim FROM ("
    + exploded(_CLAUSE.format("sentence"), "doc_id, i", "doc_sents", "claim")
    + f") WHERE len({toks('claim')}) >= 3", "doc_sents").replace("SELECT doc_id, i, row_number", "SELECT doc_id, row_number", 1))
def m01_clause_claims(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(sg.clause_claims(F.col("text"))).alias("claim_id", "claim"))


@query("n07_clause_pieces", with_ctes(exploded(_CLAUSE.format("sentence"), "doc_id, i", "doc_sents", "piece"), "doc_sents"))
def n07_clause_pieces(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(tx.sentences("text")).alias("i", "sentence"))
    return rows.select("doc_id", "i", F.posexplode(sg.pieces(F.col("sentence"), sg.CLAUSE_CUT)).alias("pos", "piece"))


@query("n07_discourse_pieces", exploded(
    f"list_filter(list_transform(string_split(regexp_replace(text, '{sg.DISCOURSE_CUT}', chr(1) || '\\1 ', 'g'), chr(1)), "
    f"lambda c: {strip('c')}), lambda c: c <> '')", "doc_id", "documents", "piece"))
def n07_discourse_pieces(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(sg.discourse_pieces(F.col("text"))).alias("pos", "piece"))


@query("n07_punctuation_pieces", exploded(
    f"list_filter(list_transform(string_split(regexp_replace(text, '{sg.PUNCTUATION_CUT}', chr(1), 'g'), chr(1)), "
    f"lambda c: {strip('c')}), lambda c: c <> '')", "doc_id", "documents", "piece"))
def n07_punctuation_pieces(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.posexplode(sg.pieces(F.col("text"), sg.PUNCTUATION_CUT)).alias("pos", "piece"))


@query("n09_topic_segments", with_ctes(f"""
    SELECT doc_id, i, sentence, coalesce(sum(CASE WHEN g < coalesce(pg, 1.0) AND g <= coalesce(ng, 1.0) AND g < m
        THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      AS segment FROM (
      SELECT *, lag(g) OVER w AS pg, lead(g) OVER w AS ng, round(avg(g) OVER (PARTITION BY doc_id), 6) AS m FROM (
        SELECT doc_id, i, sentence, CASE WHEN nx IS NULL THEN NULL WHEN len(l) * len(r) = 0 THEN 0.0
          ELSE round(len(list_intersect(l, r)) / sqrt((len(l) * len(r))::DOUBLE), 6) END AS g FROM (
          SELECT *, list_distinct(list_concat(coalesce(pv, []), t)) AS l,
            list_distinct(list_concat(nx, coalesce(nx2, []))) AS r FROM (
            SELECT *, lag(t) OVER w AS pv, lead(t) OVER w AS nx, lead(t, 2) OVER w AS nx2 FROM (
              SELECT *, list_distinct({toks('sentence')}) AS t FROM doc_sents)
            WINDOW w AS (PARTITION BY doc_id ORDER BY i))))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i))""", "doc_sents"))
def n09_topic_segments(spark, sf):
    return sg.topic_segments(documents(spark, sf), ["doc_id"])


_ENT = (f"list_distinct(list_transform(regexp_extract_all(regexp_replace(sentence, '^[^ ]+', ''), "
        f"'{sg.ENTITY_SPAN}', 1), lambda e: lower(e)))")


@query("n10_entity_groups", with_ctes(f"""
    SELECT doc_id, i, sentence, (sum(b) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS group_id FROM (
      SELECT *, CASE WHEN i = 0 OR list_has_any(e, lag(e) OVER (PARTITION BY doc_id ORDER BY i)) THEN 0 ELSE 1 END AS b
      FROM (SELECT *, {_ENT} AS e FROM doc_sents))""", "doc_sents"))
def n10_entity_groups(spark, sf):
    return sg.entity_groups(documents(spark, sf), ["doc_id"])


cte("joined_clauses", "SELECT doc_id, string_agg(piece, chr(10) ORDER BY i, pos) AS text FROM ("
    + exploded(_CLAUSE.format("sentence"), "doc_id, i", "doc_sents", "piece") + ") GROUP BY doc_id", "doc_sents")


@query("n11_hybrid_chunks", with_ctes(
    "SELECT * FROM (" + chunk_sql(300, 0, "(SELECT doc_id, text FROM joined_clauses)") + ")", "joined_clauses"))
def n11_hybrid_chunks(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(sg.hybrid_chunks(F.col("text"))).alias("chunk_id", "chunk"))


# ---- contexts ----------------------------------------------------------------------

_W01 = """SELECT doc_id, i AS claim_id, sentence AS claim,
      coalesce(string_agg(sentence, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')
        AS before,
      coalesce(lead(sentence) OVER (PARTITION BY doc_id ORDER BY i), '') AS after FROM doc_sents"""


@query("w01_claim_context", with_ctes(_W01, "doc_sents"))
def w01_claim_context(spark, sf):
    claims = documents(spark, sf).select("doc_id", F.posexplode(tx.sentences("text")).alias("claim_id", "claim"))
    return cx.claim_context(claims, ["doc_id"]).select("doc_id", "claim_id", "claim", "before", "after")


@query("m02_pronouns_resolved", with_ctes(f"""
    SELECT doc_id, claim_id, claim, CASE WHEN lower(word) IN {in_list(cx.PRONOUNS)} AND len(spans) > 0
      THEN spans[-1] || substr(claim, length(word) + 1) ELSE claim END AS rewritten FROM (
      SELECT *, regexp_extract(claim, '^([\\p{{L}}]+)', 1) AS word, regexp_extract_all(before, '{sg.ENTITY_SPAN}', 1) AS spans
      FROM ({_W01}))""", "doc_sents"))
def m02_pronouns_resolved(spark, sf):
    claims = documents(spark, sf).select("doc_id", F.posexplode(tx.sentences("text")).alias("claim_id", "claim"))
    near = cx.claim_context(claims, ["doc_id"])
    return near.select("doc_id", "claim_id", "claim", cx.resolve_pronoun(F.col("before"), F.col("claim")).alias("rewritten"))


@query("m02_rewritten_in_order")
def m02_rewritten_in_order(spark, sf):
    arrays = documents(spark, sf).select("doc_id", tx.sentences("text").alias("claims"))
    return cx.rewrite_in_order(arrays).select("doc_id", F.posexplode("rewritten").alias("claim_id", "claim"))


def replies_with_headline(spark, sf):
    """Assistant turns with the user turn just before them as headline."""
    turns = tb.table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("headline"))
    return turns.filter("role = 'assistant'").select("conv_id", "turn", "text").join(asked, ["conv_id", "turn"])


cte("replies", """SELECT a.conv_id, a.turn, a.text, u.text AS headline FROM conversations a JOIN conversations u
      ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'""")
cte("reply_sents", exploded(sents("text"), "conv_id, turn, headline", "replies", "sentence", "i"), "replies")
cte("excerpts", """SELECT conv_id, turn, headline, i, sentence,
      CASE WHEN i >= 5 THEN '[...]' || chr(10) ELSE '' END
      || string_agg(sentence, chr(10)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
      || CASE WHEN i > count(*) OVER (PARTITION BY conv_id, turn) - 5 THEN '' ELSE chr(10) || '[...]' END AS excerpt
      FROM reply_sents""", "reply_sents")


@query("w02_excerpts", with_ctes("SELECT * FROM excerpts", "excerpts"))
def w02_excerpts(spark, sf):
    return cx.excerpts(replies_with_headline(spark, sf), ["conv_id", "turn", "headline"], "text")


@query("w03_context_widths", with_ctes("""
    SELECT doc_id, i, sentence, string_agg(sentence, ' ') OVER
      (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS context FROM doc_sents""", "doc_sents"))
def w03_context_widths(spark, sf):
    return cx.sentence_window(documents(spark, sf), ["doc_id"], "text", before=3, after=2, sep=" ")


@query("n06_evidence_context", with_ctes("""
    SELECT doc_id, i, sentence, string_agg(sentence, ' ') OVER
      (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM doc_sents""", "doc_sents"))
def n06_evidence_context(spark, sf):
    return cx.sentence_window(documents(spark, sf), ["doc_id"], "text", before=1, after=1, sep=" ")
