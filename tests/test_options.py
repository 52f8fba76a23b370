import numpy as np

from attesta import VerifyConfig
from attesta.flows import extract_claims, verify
from attesta.operators import requests as rq
from attesta.sources import claim_store as cs
from attesta.sources import pages as pg
from attesta.sources import ratings as rt
from pyspark.sql import functions as F

ARTICLES = "article_id long, url string, text string"
SOURCES = "doc_id long, url string, text string"
TEXT = "Mary Poe built the old harbour bridge. She died young."


def sources(spark):
    return spark.createDataFrame([(1, "https://s.org/1", "Mary Poe built the old harbour bridge. The town paid for it.")], SOURCES)


def contradicts(batches):
    for premises, _ in batches:
        yield np.tile([9.0, 0.0, 0.0], (len(premises), 1))


def test_an_article_without_url_keeps_its_hits(spark):
    found = {}
    for url in (None, "https://a.org", "https://s.org/1"):
        arts = spark.createDataFrame([(1, url, TEXT)], ARTICLES)
        run = verify(arts, sources(spark), VerifyConfig(max_df_share=None))
        found[url] = {r.claim_id: r.verdict for r in run.verdicts.collect()}[0]
    assert found == {None: "supported", "https://a.org": "supported", "https://s.org/1": "unverified"}


def test_a_scorer_counts_in_both_modes(spark):
    arts = spark.createDataFrame([(1, "https://a.org", TEXT)], ARTICLES)
    for near in (True, False):
        run = verify(arts, sources(spark), VerifyConfig(max_df_share=None, scorer=contradicts, embed_source_claims=near))
        assert {r.claim_id: r.verdict for r in run.verdicts.collect()}[0] == "contradicted"


def test_claims_are_rewritten_whatever_made_them(spark):
    arts = spark.createDataFrame([(1, "u", TEXT)], ARTICLES)
    plain, chunked = (
        [r.claim for r in extract_claims(arts, VerifyConfig(decontextualise=True, split_chunks=split)).orderBy("claim_id").collect()] for split in (False, True))
    assert plain == chunked and "She died" not in " ".join(plain)


def test_two_stores_of_the_same_batch_number_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a.org", "a.org/1", 0, "x")], "domain string, url string, claim_id int, claim string")
    cs.append(rows, path)
    cs.append(rows.withColumn("url", F.lit("a.org/2")), path)
    cs.append(rows.withColumn("url", F.lit("a.org/3")), path, 0, "stream")
    cs.append(rows.withColumn("url", F.lit("a.org/3")), path, 0, "stream")
    assert sorted(r.url for r in cs.load(spark, path).collect()) == ["a.org/1", "a.org/2", "a.org/3"]


def test_ratings_without_row_numbers_get_numbers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("url,bias_rating\na,left\nb,right\n")
    found = rt.read_ratings(spark, str(tmp_path / "r.csv"))
    assert dict(found.dtypes)["row_no"] == "bigint"
    assert [r.url for r in found.orderBy("row_no").collect()] == ["a", "b"]


def test_short_answers_with_a_dot_or_bold_marks(spark):
    reply = f"{rq.VERDICT_HEADER}\nx\n\n{rq.SENTENCE_HEADER}\n"
    rows = spark.createDataFrame([(reply + "**None.**", "s"), (reply + "remains unchanged.", "s")], "reply string, sentence string")
    outcome, text = rq.selection("reply", "sentence")
    assert [tuple(r) for r in rows.select(outcome, text).collect()] == [(rq.NO_CLAIMS, None), (rq.KEPT, "s")]
    rows = spark.createDataFrame([(f"{rq.CLEAR_HEADER} {rq.UNCLEAR}.",)], "reply string")
    assert [tuple(r) for r in rows.select(*rq.disambiguation("reply")).collect()] == [(rq.AMBIGUOUS, None)]


def test_copies_on_few_pages_of_a_large_host_stay(spark):
    pages = [(i, f"https://h.org/{i}", f"<html><body><article>{'<p>A copied passage.</p>' if i < 3 else ''}<p>Menu</p><p>Text {i}</p></article></body></html>")
             for i in range(100)]
    got = {r.page_id: r.text for r in pg.main_content(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "A copied passage.\nText 0" and got[50] == "Text 50"
