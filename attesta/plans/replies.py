"""Queries over model requests and saved replies.

No replies come with the data, so they are derived from the sentences of
assistant turns: one request per sentence and kind, a stale and a newer reply
each, every tenth of the newer ones off format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import context as cx
from attesta.operators import requests as rq
from attesta.operators import segment as sg
from attesta.operators.staging import spread
from attesta.plans import tables as tb
from attesta.plans.registry import query
from attesta.plans.sqlkit import cte, exploded, sents, with_ctes
from attesta.plans.texts import documents, replies_with_headline, window_sql

BAD = "1. first point 2. second point"
RULE = "\n---"


def reply_sentences(spark, sf) -> DataFrame:
    turns = spread(replies_with_headline(spark, sf), "conv_id", "turn")
    rows = cx.excerpts(turns, ["conv_id", "turn", "headline"], "text")
    flat = F.regexp_replace("sentence", "\n", " ")
    return rows.select("conv_id", "turn", "i", "headline", "excerpt", flat.alias("sentence"))


def request_rows(spark, sf) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("json", "fenced", "marked", "selection", "disambiguation")])
    return (
        reply_sentences(spark, sf).withColumn("kind", F.explode(kinds))
        .withColumn("request_id", F.concat_ws("-", "kind", "conv_id", "turn", "i"))
    )


def saved_replies(spark, sf) -> DataFrame:
    s, i = F.col("sentence"), F.col("i")
    also = F.concat(F.lit("Also: "), s)
    as_json = F.to_json(F.struct(F.array(s, also).alias("claims")))
    verdict = F.concat(F.lit("Sentence:\nx\n\nFinal submission:\n"),
                       F.when(i % 3 == 2, rq.NOT_VERIFIABLE).otherwise(rq.VERIFIABLE),
                       F.lit("\n\nSentence with only verifiable information:\n"))
    body = (
        F.when(F.col("kind") == "json", as_json)
        .when(F.col("kind") == "fenced", F.concat(F.lit("Here it is:\n```"), as_json))
        .when(F.col("kind") == "marked", F.concat(F.lit("<s>\n- "), s, F.lit("\n- "), also, F.lit("\n</s>\n<s>\n- end\n</s>")))
        .when(F.col("kind") == "selection", F.concat(verdict, F.when(i % 3 == 0, also).when(
            i % 3 == 1, "remains unchanged").otherwise("None"), F.lit(RULE)))
        .otherwise(F.concat(F.lit("Reasoning.\nDecontextualizedSentence: "),
                            F.when(i % 3 == 0, "Cannot be decontextualized").otherwise(also)))
    )
    newer = F.when(i % 10 == 9, F.lit(BAD)).otherwise(body)
    rows = request_rows(spark, sf)
    return rows.select("request_id", "kind", F.inline(F.array(
        F.struct(F.lit(0).alias("received_no"), F.lit("{}").alias("reply")),
        F.struct(F.lit(1).alias("received_no"), newer.alias("reply")))))


def parsed(spark, sf) -> DataFrame:
    return rq.parse(saved_replies(spark, sf), request_rows(spark, sf))


cte("asked", """SELECT kind || '-' || conv_id || '-' || turn || '-' || i AS request_id, * FROM (
      SELECT conv_id, turn, i, headline, excerpt, replace(sentence, chr(10), ' ') AS sentence,
        unnest(['json', 'fenced', 'marked', 'selection', 'disambiguation']) AS kind FROM excerpts)""", "excerpts")
cte("outcomes", """SELECT request_id, kind, sentence, i, CASE WHEN i % 10 = 9 THEN NULL
        WHEN kind IN ('json', 'fenced', 'marked') THEN 'claims'
        WHEN kind = 'selection' THEN ['rewritten', 'kept', 'No verifiable claims'][i % 3 + 1]
        WHEN i % 3 = 0 THEN 'Cannot be disambiguated' ELSE 'rewritten' END AS outcome FROM asked""", "asked")
cte("given_claims", exploded("""CASE WHEN outcome IS NULL THEN []
        WHEN kind = 'marked' THEN [sentence, 'Also: ' || sentence, 'end']
        WHEN kind IN ('json', 'fenced') THEN [sentence, 'Also: ' || sentence]
        WHEN outcome = 'kept' THEN [sentence] WHEN outcome = 'rewritten' THEN ['Also: ' || sentence] ELSE [] END""",
    "request_id, kind", "outcomes", "claim"), "outcomes")


def of_kind(kind):
    return with_ctes(f"SELECT request_id, pos, claim FROM given_claims WHERE kind = '{kind}'", "given_claims")


def claims_of(spark, sf, kind):
    rows = rq.reply_claims(rq.parse(saved_replies(spark, sf).filter(F.col("kind") == kind), request_rows(spark, sf)))
    return rows.select("request_id", "pos", "claim")


@query("r02_reply_claims", with_ctes("SELECT request_id, kind, pos, claim FROM given_claims", "given_claims"))
def r02_reply_claims(spark, sf):
    return rq.reply_claims(parsed(spark, sf))


@query("r02_reply_failures", with_ctes(
    "SELECT kind, count(*) AS n_replies, count(*) FILTER (WHERE outcome IS NULL) AS n_failed, "
    "round(avg((outcome IS NULL)::INT), 6) AS failure_share FROM outcomes GROUP BY kind", "outcomes"))
def r02_reply_failures(spark, sf):
    return rq.reply_failures(parsed(spark, sf))


@query("r02_quarantine", with_ctes(
    f"SELECT request_id, kind, '{BAD}' AS reply FROM outcomes WHERE outcome IS NULL", "outcomes"))
def r02_quarantine(spark, sf):
    return rq.quarantine(parsed(spark, sf))


@query("s11_json_claims", of_kind("json"))
def s11_json_claims(spark, sf):
    return claims_of(spark, sf, "json")


@query("t06_marked_replies", of_kind("marked"))
def t06_marked_replies(spark, sf):
    return claims_of(spark, sf, "marked")


@query("t07_fenced_replies", of_kind("fenced"))
def t07_fenced_replies(spark, sf):
    return claims_of(spark, sf, "fenced")


@query("t09_selection_replies", of_kind("selection"))
def t09_selection_replies(spark, sf):
    return claims_of(spark, sf, "selection")


@query("t10_disambiguation_replies", of_kind("disambiguation"))
def t10_disambiguation_replies(spark, sf):
    return claims_of(spark, sf, "disambiguation")


@query("n13_outcome_shares", with_ctes(
    "SELECT kind, outcome, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM ("
    "SELECT kind, coalesce(outcome, 'unreadable') AS outcome, count(*) AS n FROM outcomes GROUP BY ALL)", "outcomes"))
def n13_outcome_shares(spark, sf):
    return rq.outcome_shares(parsed(spark, sf))


# ---- requests ------------------------------------------------------------------------

@query("t05_marked_sentences", "SELECT doc_id, trim(array_to_string(list_transform(" + sents("text")
       + ", lambda s: '<s> ' || s || ' </s>'), chr(10)), chr(10)) AS marked FROM documents")
def t05_marked_sentences(spark, sf):
    return documents(spark, sf).select("doc_id", rq.marked_sentences(F.col("text")).alias("marked"))


_SELECT_PROMPT = ("'Does the marked sentence state something that can be checked?' || chr(10) || 'Topic: ' || headline || chr(10) "
                  "|| 'Around it: ' || excerpt || chr(10) || 'Marked: ' || sentence || chr(10)")
_SENTENCES_PROMPT = ("'Split each marked sentence into simple statements.' || chr(10) || chr(10) || '<s> ' || sentence "
                     "|| ' </s>'")


@query("t11_rendered_prompts", with_ctes(
    f"SELECT conv_id, turn, i, {_SELECT_PROMPT} AS prompt FROM asked WHERE kind = 'selection'", "asked"))
def t11_rendered_prompts(spark, sf):
    return reply_sentences(spark, sf).select("conv_id", "turn", "i", rq.render(
        rq.TEMPLATES["selection"], headline="headline", excerpt="excerpt", sentence="sentence").alias("prompt"))


def asked_prompts(spark, sf) -> DataFrame:
    rows = reply_sentences(spark, sf)
    marked = F.concat(F.lit("<s> "), "sentence", F.lit(" </s>"))
    made = {
        "selection": rq.render(rq.TEMPLATES["selection"], headline="headline", excerpt="excerpt", sentence="sentence"),
        "propositions": rq.render(rq.TEMPLATES["propositions"], marked=marked),
    }
    frames = [rows.select("conv_id", F.lit(kind).alias("kind"), p.alias("prompt")) for kind, p in made.items()]
    return reduce(DataFrame.unionByName, frames)


_ALL_PROMPTS = (f"SELECT conv_id, 'selection' AS kind, {_SELECT_PROMPT} AS prompt FROM asked WHERE kind = 'selection' "
                f"UNION ALL SELECT conv_id, 'propositions', {_SENTENCES_PROMPT} FROM asked WHERE kind = 'selection'")


@query("r01_open_requests", with_ctes(
    f"""SELECT request_id, kind, prompt FROM (SELECT DISTINCT md5(kind || '|' || prompt) AS request_id, kind, prompt
      FROM ({_ALL_PROMPTS})) WHERE request_id NOT IN (SELECT md5('propositions|' || prompt) FROM ({_ALL_PROMPTS})
      WHERE kind = 'propositions' AND length(prompt) % 2 = 0)""", "asked"))
def r01_open_requests(spark, sf):
    asked = asked_prompts(spark, sf)
    answered = asked.filter((F.col("kind") == "propositions") & (F.length("prompt") % 2 == 0)).select(
        F.md5(F.concat_ws("|", "kind", "prompt")).alias("request_id"))
    return rq.build_requests(asked, answered)


# ---- grades and provenance -----------------------------------------------------------

cte("windows", window_sql(200, 50))
cte("props", exploded(sents("chunk"), "doc_id, chunk_id", "windows", "proposition"), "windows")
cte("grades", """SELECT *, CASE WHEN accuracy IS NULL THEN false ELSE least(accuracy, clarity, completeness, conciseness) >= 7
      AND greatest(accuracy, clarity, completeness, conciseness) <= 10 END AS passed FROM (
      SELECT doc_id, chunk_id, pos, proposition, CASE WHEN length(proposition) % 23 = 0 THEN NULL ELSE
        10 - length(proposition) % 5 END AS accuracy, 11 - length(proposition) % 4 AS clarity,
        10 - pos % 3 AS completeness, 10 - chunk_id % 4 AS conciseness FROM props)""", "props")


def propositions(spark, sf) -> DataFrame:
    windows = documents(spark, sf).select("doc_id", F.posexplode(sg.word_windows(F.col("text"))).alias("_p", "chunk"))
    return windows.select("doc_id", (F.col("_p") + 1).alias("chunk_id"), "chunk")


def grade_replies(spark, sf) -> DataFrame:
    props = propositions(spark, sf).select("doc_id", "chunk_id", F.posexplode(tx.sentences("chunk")).alias("pos", "proposition"))
    n = F.length("proposition")
    scores = F.struct(F.when(n % 23 != 0, 10 - n % 5).alias("accuracy"), (11 - n % 4).alias("clarity"),
                      (10 - F.col("pos") % 3).alias("completeness"), (10 - F.col("chunk_id") % 4).alias("conciseness"))
    return props.withColumn("reply", F.to_json(scores))


@query("m08_grades", with_ctes("SELECT * FROM grades", "grades"))
def m08_grades(spark, sf):
    return rq.graded(grade_replies(spark, sf))


@query("p09_passing", with_ctes("SELECT doc_id, chunk_id, pos, proposition FROM grades WHERE passed", "grades"))
def p09_passing(spark, sf):
    return rq.graded(grade_replies(spark, sf)).filter("passed").select("doc_id", "chunk_id", "pos", "proposition")


@query("p09_failing", with_ctes(
    "SELECT doc_id, chunk_id, pos, accuracy, clarity, completeness, conciseness FROM grades WHERE NOT passed", "grades"))
def p09_failing(spark, sf):
    return rq.graded(grade_replies(spark, sf)).filter("NOT passed").select("doc_id", "chunk_id", "pos", *rq.GRADES)


@query("j08_graded_with_chunk", with_ctes(
    "SELECT p.doc_id, p.chunk_id, p.pos, 'Grade how well the statement renders its passage.' || chr(10) || 'Statement: ' || proposition "
    "|| chr(10) || 'Passage: ' || chunk || chr(10) AS prompt FROM props p JOIN windows w ON w.doc_id = p.doc_id AND w.chunk_id = p.chunk_id",
    "props", "windows"))
def j08_graded_with_chunk(spark, sf):
    props = grade_replies(spark, sf).drop("reply")
    joined = props.join(propositions(spark, sf), ["doc_id", "chunk_id"])
    return joined.select("doc_id", "chunk_id", "pos", rq.render(
        rq.TEMPLATES["grading"], proposition="proposition", original_text="chunk").alias("prompt"))
