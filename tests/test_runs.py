import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.config import VerifyConfig
from attesta.operators import search, staging
from attesta.plans import tables as tb
from attesta.flows import source_claims, verify
from attesta.sources import claim_store as cs
from attesta.streaming import incremental as inc
from tests.conftest import values

SF = "/root/testdata/sf0.001"


def test_entry_gives_one_verdict_per_claim(spark):
    rows = entry.entry(spark).collect()
    assert len({(r["article_id"], r["claim_id"]) for r in rows}) == len(rows) > 0
    assert {r["verdict"] for r in rows} <= {"supported", "contradicted", "unverified"}
    assert any(r["verdict"] == "supported" for r in rows)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def test_partition_count_does_not_change_verdicts(spark):
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(values(entry.queries()["a04_article_report"](spark, SF), "article_id", "n_supported", "n_contradicted"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_store_append_is_idempotent_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "store")
    assert cs.load(spark, path).count() == 0
    rows = spark.createDataFrame([("a.org", "https://a.org/1", 0, "x"), ("b.org", "https://b.org/1", 0, "y")],
                                 "domain string, url string, claim_id int, claim string")
    cs.append(rows, path, batch=0, run="r")
    cs.append(rows, path, batch=0, run="r")
    cs.append(rows.filter("domain = 'a.org'").withColumn("url", F.lit("https://a.org/2")), path, batch=1, run="r")
    assert cs.load(spark, path).count() == 3
    only = spark.createDataFrame([("a.org",)], "domain string")
    assert values(cs.load_domains(spark, path, only), "url") == [("https://a.org/1",), ("https://a.org/2",)]
    asked = spark.createDataFrame([("https://a.org/1",), ("https://c.org/",)], "url string")
    assert values(cs.missing(asked, cs.load(spark, path)), "url") == [("https://c.org/",)]


def test_first_page_stands_for_its_domain(spark):
    hits = spark.createDataFrame([("d", 2, "u2"), ("d", 1, "u9"), ("d", 1, "u3"), ("e", 4, "v")], "domain string, search_rank int, url string")
    assert values(cs.by_domain(hits), "url", "origin_url") == [("u2", "u3"), ("u3", "u3"), ("u9", "u3"), ("v", "v")]


def test_streamed_verdicts_equal_batch(spark, tmp_path):
    arts, docs = tb.articles(spark, SF), tb.sources(spark, SF)
    arts.repartition(3, "article_id").write.parquet(str(tmp_path / "in"))
    index = search.build_index(docs)
    for _ in range(2):                                   # a restart processes nothing twice
        inc.verify_stream(spark, str(tmp_path / "in"), arts.schema, docs, index, str(tmp_path / "out"),
                          str(tmp_path / "offsets"), files_per_batch=2).awaitTermination()
    cols = ["article_id", "claim_id", "verdict", "source_url"]
    batch = verify(arts, docs, index=index).verdicts
    key = lambda rows: sorted(map(str, rows))             # noqa: E731
    assert key(values2(spark.read.parquet(str(tmp_path / "out")), cols)) == key(values2(batch, cols))


def values2(df, cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        staging.scratch_root(Session())


def test_store_opens_only_files_that_may_hold_a_url(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "domain string, url string, claim_id int, claim string"
    for batch in range(6):
        rows = [(f"d{batch}.org", f"https://d{batch}.org/{i}", 0, f"c{batch}-{i}") for i in range(20)] + [("e.org", f"https://e.org/{batch}", None, None)]
        cs.append(spark.createDataFrame(rows, schema).coalesce(1), path, batch, "r")
    asked = spark.createDataFrame([("https://d3.org/7",), ("https://e.org/2",), ("https://nowhere.org/",)], "url string")
    every = cs.files_for(spark, path, cs.of_urls(spark, path, cs.load(spark, path)))
    opened = cs.files_for(spark, path, asked)
    assert len(opened) <= 3 < len(every)
    assert values(cs.of_urls(spark, path, asked).select("url", "claim"), "url", "claim") == [("https://d3.org/7", "c3-7"), ("https://e.org/2", None)]
    before, snapshot = values(cs.load(spark, path).select("url", "claim"), "url", "claim"), cs.last_commit(spark, path)
    replaced = spark.createDataFrame([("d0.org", "https://d0.org/new", 0, "again")], schema)
    cs.append(replaced, path, 0, "r")                       # batch 0 once more, with another row
    files = cs.compact(spark, path)
    after = values(cs.load(spark, path).select("url", "claim"), "url", "claim")
    assert files >= 7 and after == sorted([r for r in before if not r[0].startswith("https://d0.")] + [("https://d0.org/new", "again")])
    cs.append(replaced, path, 0, "r")                       # a retry after the compaction adds nothing twice
    assert values(cs.load(spark, path).select("url", "claim"), "url", "claim") == after
    assert values(cs.load(spark, path, snapshot).select("url", "claim"), "url", "claim") == before
    assert values(cs.load(spark, str(tmp_path / "none")), "url") == []


def test_a_second_run_reads_its_sources_from_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "https://a.org/1", "Ann built the bridge in Oslo. It stands."), (2, "https://b.org/2", " "), (3, "https://c.org/3", "Ann never built it.")],
                                 "doc_id long, url string, text string")
    config = VerifyConfig()
    first = source_claims(docs, config, path)
    commits = cs.last_commit(spark, path)
    again = source_claims(docs, config, path)
    assert cs.last_commit(spark, path) == commits == 1      # the page without claims is not asked for again either
    assert values(first, *first.columns) == values(again, *again.columns) == values(source_claims(docs, config), *first.columns)
    more = docs.unionByName(spark.createDataFrame([(4, "https://d.org/4", "New.")], docs.schema))
    assert source_claims(more, config, path).count() == first.count() + 1 and cs.last_commit(spark, path) == 2


def test_given_hits_and_encoder_drive_a_run(spark):
    arts = spark.createDataFrame([(1, "https://x.org", "Ann built the bridge in Oslo.")], "article_id long, url string, text string")
    docs = spark.createDataFrame([(1, "https://a.org/1", "The bridge stands. Ann never built the bridge in Oslo."), (3, "https://c.org/3", "Ann built the bridge in Oslo.")],
                                 "doc_id long, url string, text string")
    hits = spark.createDataFrame([(1, 0, 1, "https://gone.org"), (1, 0, 2, "https://a.org/1"), (1, 0, 11, "https://c.org/3")],
                                 "article_id long, claim_id int, search_rank int, url string")

    def letters(batches):
        for texts in batches:
            yield np.array([[float(t.count(c)) for c in "abdngtuv"] for t in texts])
    for config in (VerifyConfig(), VerifyConfig(encoder="hashed"), VerifyConfig(encoder=letters), VerifyConfig(wave_ranks=()), VerifyConfig(wave_ranks=(1, 2, 5), wave_least_hits=0)):
        run = verify(arts, docs, config, hits=hits)
        assert values(run.verdicts, "verdict", "source_url", "search_rank") == [("contradicted", "https://a.org/1", 2)]
        assert run.report().first()["n_sources"] == 2
