import pytest

from attesta.config import VerifyConfig
from attesta.flows import verify
from attesta.operators import evidence, relation, verdict
from tests.conftest import values

CLAIM = ["article_id", "claim_id"]
CLAIMS = [(1, 0, "u1", "The tower is 330 meters tall in Paris"), (1, 1, "u1", "Cats sleep all day long"),
          (2, 0, "u2", "Nothing matches here zzz")]
SOURCES = [(10, "s10", "The tower is tall. The tower is 320 meters tall in Paris. The tower is 330 meters tall in Paris! End."),
           (11, "s11", "Cats do not sleep all day long. Cats sleep all day long. Dogs bark."), (12, "s12", "")]
HITS = [(1, 0, 1, 10, "s10"), (1, 0, 2, 11, "s11"), (1, 1, 1, 11, "s11"), (1, 1, 2, 12, "s12"), (2, 0, 1, 11, "s11")]


@pytest.fixture
def tables(spark):
    return (spark.createDataFrame(HITS, "article_id long, claim_id int, search_rank int, doc_id long, url string"),
            spark.createDataFrame(CLAIMS, "article_id long, claim_id int, url string, claim string"),
            spark.createDataFrame(SOURCES, "doc_id long, url string, text string"))


@pytest.mark.parametrize("tile_rows, hot", [(256, 100), (1, 100), (2, 1)])
def test_nearest_does_not_depend_on_tiles_or_salt(tables, tile_rows, hot):
    got = evidence.nearest(*tables, k=2, tile_rows=tile_rows, hot_key_rows=hot)
    assert values(got.filter("doc_id = 10"), *CLAIM, "source_claim_id", "dist", "dist_rank", "relation") == [
        (1, 0, 1, 0.125, 2, "contradiction"), (1, 0, 2, 0.0, 1, "entailment")]
    assert values(got.filter("claim_id = 1"), "source_claim_id", "relation") == [(0, "contradiction"), (1, "entailment")]
    assert got.filter("article_id = 2").filter("relation <> 'neutral'").count() == 0


def test_order_of_the_two_variants_differs(tables):
    by_distance = evidence.first_decisive(
        evidence.nearest(*tables), ["search_rank", "dist_rank"], ["search_rank", "dist_rank", "source_claim_id", "relation"])
    assert values(by_distance, *CLAIM, "source_claim_id", "relation") == [(1, 0, 2, "entailment"), (1, 1, 0, "contradiction")]
    tiles = evidence.exhaustive(*tables, tile_rows=2)
    in_order = evidence.first_decisive(tiles.filter("at IS NOT NULL").withColumnRenamed("at", "source_claim_id"),
                                       ["search_rank", "source_claim_id"], ["search_rank", "source_claim_id", "relation"])
    assert values(in_order, *CLAIM, "source_claim_id", "relation") == [(1, 0, 1, "contradiction"), (1, 1, 0, "contradiction")]
    assert values(verdict.inspected(tiles), *CLAIM, "pairs_inspected") == [(1, 0, 2), (1, 1, 1), (2, 0, 3)]


def test_nearest_neutral_is_skipped_for_a_later_decisive_pair(spark):
    rows = [(1, 0, 1, 1, 7, "neutral"), (1, 0, 1, 2, 3, "contradiction"), (1, 0, 2, 1, 1, "entailment"), (1, 1, 1, 1, 1, "neutral")]
    pairs = spark.createDataFrame(rows, "article_id long, claim_id int, search_rank int, dist_rank int, "
                                        "source_claim_id int, relation string")
    got = evidence.first_decisive(pairs, ["search_rank", "dist_rank"], ["search_rank", "dist_rank", "relation"])
    assert values(got, *CLAIM, "relation") == [(1, 0, "contradiction")]


def test_relation_rule(spark):
    pair = [("The council has planted many trees along the river over the last few summers.",
             "The council does not care about the river trees.", "neutral"),
            ("It rained today in Rome", "It rained today in Rome", "entailment"),
            ("It never rained today in Rome", "It rained today in Rome", "contradiction"),
            ("It rained 3 days in Rome", "It rained 4 days in Rome", "contradiction"), ("a", "", "neutral")]
    df = spark.createDataFrame(pair, "p string, h string, want string")
    got = df.select(relation.profile("h").alias("h"), relation.profile("p").alias("p"), "want")
    got = got.select(relation.lexical_relation(got.h, got.p).alias("r"), "want").collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]


def test_logit_decision_first_maximum_wins(spark):
    rows = [([0.1, 0.2, 0.9], ["contradiction", "neutral", "entailment"], "entailment"),
            ([0.9, 0.2, 0.1], ["ENTAILMENT", "NEUTRAL", "CONTRADICTION"], "entailment"),
            ([0.5, 0.5, 0.1], ["contradiction", "neutral", "entailment"], "contradiction"),
            ([0.1, 0.9, 0.1], ["a", "other", "b"], "neutral")]
    df = spark.createDataFrame(rows, "logits array<double>, labels array<string>, want string")
    got = df.select(relation.decide(df.logits, df.labels).alias("r"), "want").collect()
    assert [r["r"] for r in got] == [r["want"] for r in got]


def test_plugged_scorer_replaces_the_rule(spark, tables):
    def scorer(batches):
        for premises, hypotheses in batches:
            yield [[2.0, 1.0, 0.0] if "Dogs" in p else [0.0, 0.0, 1.0] for p in premises]

    articles = spark.createDataFrame([(1, "u1", "Cats sleep all day long.")], "article_id long, url string, text string")
    run = verify(articles, tables[2], VerifyConfig(scorer=scorer, max_df_share=None))
    assert values(run.verdicts, "verdict", "source_claim") == [("contradicted", "Dogs bark.")]


def test_smoke_article_without_sources(spark):
    articles = spark.createDataFrame([(1, "u", "The bakery opened in 1931. Rye bread keeps well. It is cheap. Olga sold it.")],
                                     "article_id long, url string, text string")
    sources = spark.createDataFrame([(5, "s", "zzz yyy xxx")], "doc_id long, url string, text string")
    run = verify(articles, sources)
    assert values(run.verdicts, "verdict") == [("unverified",)] * 4
    report = run.report().first()
    assert (report["n_unverified"], report["has_sources"], report["no_unverified"]) == (4, False, False)
    assert values(run.findings(), "section") == [("1 claim",)] * 4


def test_own_page_is_never_a_source_and_counts_add_up(spark):
    text = "Alpha beta gamma delta. Epsilon zeta eta theta."
    articles = spark.createDataFrame([(1, "https://x/1", text), (2, "https://x/2", text)],
                                     "article_id long, url string, text string")
    sources = spark.createDataFrame([(1, "https://x/1", text), (3, "https://x/3", "Other words only.")],
                                    "doc_id long, url string, text string")
    for config in (VerifyConfig(max_df_share=None), VerifyConfig(max_df_share=None, embed_source_claims=False)):
        run = verify(articles, sources, config)
        assert values(run.verdicts, "article_id", "verdict") == [
            (1, "unverified"), (1, "unverified"), (2, "supported"), (2, "supported")]
        for r in run.report().collect():
            assert r["n_claims"] == r["n_supported"] + r["n_contradicted"] + r["n_unverified"]
        assert set(values(run.findings().filter("section = '2 source'"), "article_id", "content")) == {
            (1, "https://x/1"), (2, "https://x/1")}
