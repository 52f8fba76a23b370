"""Model requests and replies as tables: build, dedupe, parse, account for failures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx

# Default request texts; pass your own to ``render``. {name} is filled from a column.
TEMPLATES = {
    "claims": "List every distinct, self-contained claim in the text below as JSON with one key, claims."
              "\n\nText:\n{text}\n",
    "propositions": "Split each marked sentence into simple statements.\n\n{marked}",
    "selection": "Does the marked sentence state something that can be checked?\nTopic: {headline}\nAround it: {excerpt}\nMarked: {sentence}\n",
    "decontextualise": "Rewrite the claim so that it can be read alone.\nClaim: {claim}\nWhat came before: {context}\n",
    "grading": "Grade how well the statement renders its passage.\nStatement: {proposition}\nPassage: {original_text}\n",
}

# The formats replies come in.
FENCE = "```"
OPEN, CLOSE = "<s>", "</s>"
MARKED_GROUP = r"(?s)<s>(.*?)</s>"
BULLET_CHARS = 2
VERDICT_HEADER = "Final submission:"
SENTENCE_HEADER = "Sentence with only verifiable information:"
UNCHANGED, NOTHING = "remains unchanged", "None"
CLEAR_HEADER = "DecontextualizedSentence:"
UNCLEAR = "Cannot be decontextualized"
NO_CLAIMS, AMBIGUOUS, KEPT, REWRITTEN = "No verifiable claims", "Cannot be disambiguated", "kept", "rewritten"
VERIFIABLE = "Contains a specific and verifiable proposition"
NOT_VERIFIABLE = "Does NOT contain a specific and verifiable proposition"
GRADES = ["accuracy", "clarity", "completeness", "conciseness"]


# ---- requests ------------------------------------------------------------------------

def render(template: str, **columns) -> Column:
    """The template with every {name} replaced in one pass, so values are never re-read."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in columns:
            parts.append(F.coalesce(tx.col(columns[piece]), F.lit("")))
        else:
            parts.append(F.lit("{" + piece + "}"))
    return F.concat(*parts)


def marked_sentences(text: Column) -> Column:
    """``<s> sentence </s>`` per line, outer newlines stripped."""
    lines = F.transform(tx.sentences(text), lambda s: F.concat(F.lit(f"{OPEN} "), s, F.lit(f" {CLOSE}")))
    return F.btrim(F.array_join(lines, "\n"), F.lit("\n"))


def build_requests(asked: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """``request_id, kind, prompt`` from rows with ``kind, prompt``.

    Identical prompts become one request, named by their hash; requests that
    have a reply are left out.
    """
    ids = F.md5(F.concat_ws("|", "kind", "prompt"))
    requests = (
        asked.select(ids.alias("request_id"), "kind", "prompt")
        .groupBy("request_id").agg(F.first("kind").alias("kind"), F.first("prompt").alias("prompt"))
    )
    if answered is not None:
        requests = requests.join(answered.select("request_id").distinct(), "request_id", "left_anti")
    return requests


# ---- replies -------------------------------------------------------------------------

def newest(replies: DataFrame) -> DataFrame:
    """The latest reply per request: an aggregate, so repeats cost nothing in the shuffle."""
    return (
        replies.groupBy("request_id", "kind")
        .agg(F.max_by("reply", "received_no").alias("reply"))
    )


def json_claims(reply) -> Column:
    """``{"claims": [...]}`` to an array; null when it does not parse or holds nulls."""
    found = F.from_json(reply, "claims array<string>")["claims"]
    return F.when(~F.exists(found, lambda c: c.isNull()), found)


def fenced_claims(reply) -> Column:
    """The JSON after the last fence."""
    return json_claims(F.element_at(F.split(tx.col(reply), FENCE), -1))


def marked_claims(reply) -> Column:
    """Groups between marks: newlines stripped, one claim per line, first two characters cut."""
    groups = F.regexp_extract_all(tx.col(reply), F.lit(MARKED_GROUP), F.lit(1))
    lines = F.transform(groups, lambda g: F.transform(
        F.split(F.btrim(g, F.lit("\n")), "\n"), lambda x: F.substr(x, F.lit(BULLET_CHARS + 1))))
    return F.when(F.size(groups) > 0, F.flatten(lines))


def after(reply, header: str) -> Column:
    """Text after a header, up to a closing rule or the end; null without the header."""
    body = F.substring_index(tx.col(reply), header, -1)
    return F.when(F.contains(tx.col(reply), F.lit(header)), tx.strip(F.regexp_replace(body, r"(?s)\n---.*$", "")))


def bare(said: Column) -> Column:
    """A short answer without bold marks and a final dot."""
    return F.regexp_replace(said, r"^[*\s]+|[*.\s]+$", "")


def selection(reply, sentence) -> tuple[Column, Column]:
    """(outcome, text): dropped, unchanged or rewritten; both null when unreadable."""
    said = after(reply, SENTENCE_HEADER)
    ok = said.isNotNull() & (said != "") & F.contains(tx.col(reply), F.lit(VERDICT_HEADER))
    outcome = F.when(ok, F.when(bare(said) == NOTHING, NO_CLAIMS).when(bare(said) == UNCHANGED, KEPT).otherwise(REWRITTEN))
    text = F.when(ok & (bare(said) != NOTHING), F.when(bare(said) == UNCHANGED, tx.col(sentence)).otherwise(said))
    return outcome, text


def disambiguation(reply) -> tuple[Column, Column]:
    """(outcome, text): resolved text, or labelled and dropped."""
    said = after(reply, CLEAR_HEADER)
    ok = said.isNotNull() & (said != "")
    outcome = F.when(ok, F.when(bare(said) == UNCLEAR, AMBIGUOUS).otherwise(REWRITTEN))
    return outcome, F.when(ok & (bare(said) != UNCLEAR), said)


def parse(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest replies with ``outcome`` and ``claims``; ``requests`` gives the sentence asked about.

    ``outcome`` is null for a reply that does not follow its format: no
    claims, counted as a failure, never an error.
    """
    rows = newest(replies).join(requests.select("request_id", "sentence"), "request_id")
    sel_outcome, sel_text = selection("reply", "sentence")
    dis_outcome, dis_text = disambiguation("reply")
    one = {"selection": (sel_outcome, sel_text), "disambiguation": (dis_outcome, dis_text)}
    many = {"json": json_claims("reply"), "fenced": fenced_claims("reply"), "marked": marked_claims("reply")}
    none = F.array().cast("array<string>")
    outcome, claims = F.lit(None).cast("string"), none
    for kind, (label, text) in one.items():
        outcome = F.when(F.col("kind") == kind, label).otherwise(outcome)
        claims = F.when(F.col("kind") == kind, F.when(text.isNotNull(), F.array(text)).otherwise(none)).otherwise(claims)
    for kind, found in many.items():
        label = F.when(found.isNotNull(), F.when(F.size(found) > 0, "claims").otherwise(NO_CLAIMS))
        outcome = F.when(F.col("kind") == kind, label).otherwise(outcome)
        claims = F.when(F.col("kind") == kind, F.coalesce(found, none)).otherwise(claims)
    return rows.select("request_id", "kind", "sentence", outcome.alias("outcome"), claims.alias("claims"), "reply")


def reply_claims(parsed: DataFrame) -> DataFrame:
    return parsed.select("request_id", "kind", F.posexplode("claims").alias("pos", "claim"))


def reply_failures(parsed: DataFrame) -> DataFrame:
    """Replies per kind and how many could not be read."""
    return parsed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_replies"), F.count_if(F.col("outcome").isNull()).alias("n_failed"),
        F.round(F.avg(F.col("outcome").isNull().cast("int")), 6).alias("failure_share"))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter("outcome IS NULL").select("request_id", "kind", "reply")


def outcome_shares(parsed: DataFrame) -> DataFrame:
    """Share of each outcome within its kind."""
    counts = parsed.groupBy("kind", F.coalesce("outcome", F.lit("unreadable")).alias("outcome")) \
        .agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    return counts.join(totals, "kind").select("kind", "outcome", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# ---- grades --------------------------------------------------------------------------

def graded(replies: DataFrame, threshold: int = 7) -> DataFrame:
    """Grade replies with ``passed``: four scores from 1 to 10, all at least ``threshold``."""
    schema = ", ".join(f"{g} int" for g in GRADES)
    rows = replies.withColumn("_g", F.from_json("reply", schema)).select("*", "_g.*").drop("_g", "reply")
    low, high = F.least(*GRADES), F.greatest(*GRADES)
    complete = F.lit(True)
    for g in GRADES:
        complete = complete & F.col(g).isNotNull()
    return rows.withColumn("passed", F.coalesce(complete & (low >= threshold) & (low >= 1) & (high <= 10), F.lit(False)))
