"""Queries on claim quality: check-worthiness, clean-up, uniqueness, criteria, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import context as cx
from attesta.operators import quality as ql
from attesta.operators import relation as rel
from attesta.plans import tables as tb
from attesta.plans.registry import query
from attesta.plans.replies import reply_sentences
from attesta.plans.sqlkit import cte, in_list, sents, strip, toks, with_ctes
from attesta.plans.texts import documents


def has_any(words):
    return f"len(list_filter(t, lambda x: x IN {in_list(words)})) > 0"


LABEL = f"""CASE WHEN ends_with({strip('sentence')}, '?') OR len(t) = 0 OR t[1] IN {in_list(ql.IMPERATIVES)} THEN 'not a claim'
      WHEN {has_any(ql.OPINION_WORDS)} THEN 'opinion' WHEN {has_any(ql.FIRST_PERSON)} THEN 'personal statement'
      ELSE 'checkworthy' END"""
cte("labelled", f"SELECT doc_id, i, sentence, {LABEL} AS label FROM (SELECT *, {toks('sentence')} AS t FROM doc_sents)",
    "doc_sents")


def doc_claims(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(tx.sentences("text")).alias("i", "sentence"))


@query("p08_checkworthiness", with_ctes("SELECT doc_id, i, label FROM labelled", "labelled"))
def p08_checkworthiness(spark, sf):
    return doc_claims(spark, sf).select("doc_id", "i", ql.checkworthiness("sentence").alias("label"))


@query("p07_falsifiable_off", with_ctes("SELECT doc_id, i FROM labelled", "labelled"))
def p07_falsifiable_off(spark, sf):
    return ql.falsifiable(doc_claims(spark, sf), check=False, text="sentence").select("doc_id", "i")


@query("m03_falsifiable_on", with_ctes("SELECT doc_id, i FROM labelled WHERE label = 'checkworthy'", "labelled"))
def m03_falsifiable_on(spark, sf):
    return ql.falsifiable(doc_claims(spark, sf), check=True, text="sentence").select("doc_id", "i")


def prefixed_lists(spark, sf):
    """Claim lists per assistant turn, opened by prefixes that all or all but one share."""
    turns = tb.table(spark, sf, "conversations").filter("role = 'assistant'")
    kind = F.col("conv_id") % 4

    def opened(s, i):
        return (F.when(kind == 0, F.concat(F.lit("- The "), s)).when(kind == 1, F.concat(F.lit("The text "), s))
                .when((kind == 2) & (i > 0), F.concat(F.lit("- "), s)).otherwise(s))

    return turns.select("conv_id", "turn", F.transform(tx.sentences("text"), opened).alias("claims"))


cte("lists", """SELECT conv_id, turn, list_transform(_l, lambda s, i: CASE conv_id % 4 WHEN 0 THEN '- The ' || s
      WHEN 1 THEN 'The text ' || s WHEN 2 THEN CASE WHEN i > 1 THEN '- ' || s ELSE s END ELSE s END) AS claims
      FROM (SELECT *, {} AS _l FROM conversations WHERE role = 'assistant')""".format(sents("text")))
_STEPS = "".join(
    f", s{n + 1} AS (SELECT conv_id, turn, CASE WHEN len(list_filter(claims, lambda c: NOT starts_with(c, '{p}'))) = 0 "
    f"THEN list_transform(claims, lambda c: substr(c, {len(p) + 1})) ELSE claims END AS claims FROM s{n})"
    for n, p in enumerate(ql.PREFIXES))


@query("t08_cleaned_claims", with_ctes(
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(claims, lambda c: {strip('c')}), lambda c: c <> ''),
      chr(10)) AS claims FROM (
      WITH s0 AS (SELECT * FROM lists){_STEPS} SELECT conv_id, turn, CASE WHEN len(list_filter(claims,
      lambda c: NOT ends_with(c, '.'))) = 0 THEN list_transform(claims, lambda c: substr(c, 1, length(c) - 1)) ELSE claims END
      AS claims FROM s{len(ql.PREFIXES)})""", "lists"))
def t08_cleaned_claims(spark, sf):
    return prefixed_lists(spark, sf).select("conv_id", "turn", F.array_join(ql.clean_claims("claims"), "\n").alias("claims"))


@query("a06_all_end_with_dot", with_ctes(
    "SELECT d.doc_id, coalesce(bool_and(ends_with(sentence, '.')), true) AS all_dots FROM documents d "
    "LEFT JOIN doc_sents s USING (doc_id) GROUP BY d.doc_id", "doc_sents"))
def a06_all_end_with_dot(spark, sf):
    return ql.all_satisfy(doc_claims(spark, sf), tb.table(spark, sf, "documents"), "doc_id", "all_dots",
                          F.col("sentence").endswith("."))


@query("n12_rewrite_similarity", with_ctes(r"""
    SELECT conv_id, turn, i, coalesce(round(5 * p * r / nullif(4 * p + r, 0), 6), 0.0) AS chrf FROM (
      SELECT conv_id, turn, i, avg(ov / h) FILTER (WHERE h > 0 AND g > 0) AS p, avg(ov / g) FILTER (WHERE h > 0 AND g > 0) AS r
      FROM (SELECT conv_id, turn, i, n, sum(least(hc, gc)) AS ov, sum(hc) AS h, sum(gc) AS g FROM (
        SELECT conv_id, turn, i, n, gram, count(*) FILTER (WHERE side = 0) AS hc, count(*) FILTER (WHERE side = 1) AS gc FROM (
          SELECT conv_id, turn, i, side, n, substr(txt, k, n) AS gram FROM (
            SELECT *, unnest(range(1, greatest(length(txt) - n + 2, 1))) AS k FROM (
              SELECT conv_id, turn, i, side, txt, unnest([1, 2, 3, 4, 5, 6]) AS n FROM (
                SELECT conv_id, turn, i, 0 AS side, regexp_replace(prev, '[ \t\n\r\f\x0B]+', '', 'g') AS txt FROM near
                UNION ALL SELECT conv_id, turn, i, 1, regexp_replace(sentence, '[ \t\n\r\f\x0B]+', '', 'g') FROM near))))
        GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)""".replace("near", """(SELECT conv_id, turn, i, sentence,
          coalesce(lag(sentence) OVER (PARTITION BY conv_id, turn ORDER BY i), '') AS prev FROM flat)""").replace(
    "FROM flat", "FROM (SELECT conv_id, turn, i, replace(sentence, chr(10), ' ') AS sentence FROM excerpts)"), "excerpts"))
def n12_rewrite_similarity(spark, sf):
    """chrF of each sentence against the one before it in the same turn."""
    near = cx.claim_context(reply_sentences(spark, sf), ["conv_id", "turn"], "i", "sentence", before=1, after=1)
    return near.select("conv_id", "turn", "i", ql.chrf("before", "sentence").alias("chrf"))


@query("n14_unique_claims", with_ctes(
    f"""SELECT doc_id, i, sentence, n_copies FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n_copies,
      row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r
      FROM (SELECT *, array_to_string({toks('sentence')}, ' ') AS k FROM doc_sents)) WHERE r = 1""", "doc_sents"))
def n14_unique_claims(spark, sf):
    return ql.unique_claims(doc_claims(spark, sf), ["doc_id", "i"], "sentence")


# rarest tokens first: a similar set shares one of the first n - ceil(0.7 n) + 1
cte("claim_sets", f"""SELECT row_number() OVER (ORDER BY min((doc_id, i))) AS k, min((doc_id, i)) AS id, t, len(t) AS n FROM (
      SELECT doc_id, i, list_sort(list_distinct({toks('sentence')})) AS t FROM doc_sents) WHERE len(t) > 0 GROUP BY t""", "doc_sents")
cte("claim_prefixes", """SELECT k, n, token FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY df, token) AS r FROM (
      SELECT *, count(*) OVER (PARTITION BY token) AS df FROM (SELECT k, n, unnest(t) AS token FROM claim_sets)))
    WHERE r <= n - ceil(0.7 * n) + 1""", "claim_sets")
cte("claim_met", """SELECT DISTINCT x.k AS a, y.k AS b FROM claim_prefixes x JOIN claim_prefixes y USING (token)
    WHERE x.k < y.k AND 10 * x.n >= 7 * y.n AND 10 * y.n >= 7 * x.n""", "claim_prefixes")
cte("claim_links", """SELECT a, b FROM (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.t, y.t)) AS common FROM claim_met
      JOIN claim_sets x ON x.k = a JOIN claim_sets y ON y.k = b) WHERE round(common / (n - common), 6) >= 0.7""", "claim_met", "claim_sets")
cte("claim_edges", "SELECT a, b FROM claim_links UNION ALL SELECT b, a FROM claim_links", "claim_links")
cte("claim_reach", "SELECT a, a AS b FROM claim_edges UNION SELECT r.a, l.b FROM claim_reach r JOIN claim_edges l ON r.b = l.a", "claim_edges")
_NEAR = with_ctes(f"""SELECT u.id[1] AS doc_id, u.id[2] AS i, k.id[1] AS repeats_doc_id, k.id[2] AS repeats_i,
      round(len(list_intersect(u.t, k.t)) / (len(u.t) + k.n - len(list_intersect(u.t, k.t))), 6) AS jaccard
    FROM (SELECT min((doc_id, i)) AS id, list_sort(list_distinct(w)) AS t FROM (SELECT doc_id, i, {toks('sentence')} AS w FROM doc_sents) GROUP BY w) u
    JOIN claim_sets s USING (t) LEFT JOIN (SELECT a, min(b) AS root FROM claim_reach GROUP BY a) r ON r.a = s.k
    JOIN claim_sets k ON k.k = coalesce(root, s.k) WHERE u.id <> k.id""", "doc_sents", "claim_reach", recursive=True).replace(
    "claim_reach AS MATERIALIZED", "claim_reach AS")


@query("n14_near_repeats", _NEAR)
def n14_near_repeats(spark, sf):
    return ql.near_unique(doc_claims(spark, sf), ["doc_id", "i"], "sentence")


@query("n15_criteria", with_ctes(
    f"""SELECT doc_id, count(*) AS n_claims, round(avg(regexp_matches(sentence, '{ql.JOINED_FACTS}')::INT), 6) AS joined_share,
      round(avg(({has_any(ql.PRONOUN_WORDS)})::INT), 6) AS pronoun_share,
      round(avg(regexp_matches(sentence, '{ql.REPORTING_START}')::INT), 6) AS reporting_share
      FROM (SELECT *, {toks('sentence')} AS t FROM doc_sents) GROUP BY doc_id""", "doc_sents"))
def n15_criteria(spark, sf):
    return ql.criteria(doc_claims(spark, sf), "doc_id", "sentence")


@query("m04_quality_model")
def m04_quality_model(spark, sf):
    """Trained on four fifths of the labelled documents, measured on the rest."""
    labelled = documents(spark, sf).select("doc_id", "text").join(
        tb.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = ql.quality_model(labelled.filter(~held))
    return ql.holdout_metrics(model, labelled.filter(held))


cte("logits", """SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS l,
      CASE WHEN vec_id % 2 = 0 THEN ['CONTRADICTION', 'NEUTRAL', 'ENTAILMENT'] ELSE ['entailed', 'n/a', 'contradicts'] END
      AS labels FROM embeddings""")


@query("m06_logit_decision", with_ctes(
    """SELECT vec_id, CASE WHEN contains(lower(best), 'entail') THEN 'entailment'
      WHEN contains(lower(best), 'contradict') THEN 'contradiction' ELSE 'neutral' END AS relation,
      round(exp(list_max(l)) / (exp(l[1]) + exp(l[2]) + exp(l[3])), 6) AS probability
      FROM (SELECT *, labels[list_position(l, list_max(l))] AS best FROM logits)""", "logits"))
def m06_logit_decision(spark, sf):
    """First three dimensions of each vector as logits, two label orders."""
    logits = F.array(*[F.get("embedding", i).cast("double") for i in range(3)])
    named = F.when(F.col("vec_id") % 2 == 0, F.array(*map(F.lit, ("CONTRADICTION", "NEUTRAL", "ENTAILMENT")))).otherwise(
        F.array(*map(F.lit, ("entailed", "n/a", "contradicts"))))
    rows = tb.table(spark, sf, "embeddings").select("vec_id", logits.alias("l"), named.alias("labels"))
    return rows.select("vec_id", rel.decide(F.col("l"), F.col("labels")).alias("relation"),
                       F.round(F.array_max(rel.softmax(F.col("l"))), 6).alias("probability"))
