import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from attesta.functions import html as hx
from attesta.functions import urls as ux
from attesta.operators import sites as st
from attesta.sources import pages as pg
from attesta.sources import ratings as rt
from attesta.sources import replies as rp
from attesta.sources import sites as sl
from tests.conftest import values

PATTERNS = ["https://*.example.com", "'http://*.a.org'", "https://b.com/news", "c.net", '"https://d.io/x/y"']


def patterns(spark):
    return spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


def test_site_patterns_become_anchored_regexes(spark):
    got = dict(values(sl.reliable_sites(patterns(spark)), "pattern", "regex"))
    for pattern, address in zip(PATTERNS, ["example.com", "a.org", "b.com/news", "c.net", "d.io/x/y"]):
        assert got[pattern] == f"^https?://([^./]+\\.)*{re.escape(address)}(/.*)?$"


def test_reliable_join_equals_regex(spark):
    urls = ["https://example.com", "http://www.example.com/x", "https://notexample.com", "https://example.com.evil.org",
            "https://Example.com/", "https://example.com:80/x", "https://example.com?q=1", "https://b.com/news",
            "https://b.com/newspaper", "https://x.b.com/news/1?a#b", "https://b.com/", "ftp://c.net", "https://c.net/",
            "https://..c.net/", "https://.c.net/", "https://a..c.net/x", "http://d.io/x/y/z", "https://d.io/x", "c.net", ""]
    sites = sl.reliable_sites(patterns(spark))
    regexes = [re.compile(r["regex"]) for r in sites.collect()]
    want = sorted(u for u in urls if any(r.match(u) for r in regexes))
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [u for (u,) in values(st.reliable_urls(df, sites), "url")] == want


def test_registrable_domains(spark):
    urls = ["https://a.b.co.uk/x", "http://localhost:80/", "https://WWW.Example.COM", "https://x.y.kobe.jp/",
            "https://city.kobe.jp/", "https://co.uk/", "https://a.unknown/"]
    rules = spark.createDataFrame([(s,) for s in ("uk", "co.uk", "com", "jp", "*.kobe.jp", "!city.kobe.jp")], "suffix string")
    got = dict(values(st.registrable_domains(spark.createDataFrame([(u,) for u in urls], "url string"), rules), "url", "domain"))
    assert got == {
        "https://a.b.co.uk/x": "b.co.uk", "http://localhost:80/": "localhost.", "https://WWW.Example.COM": "example.com",
        "https://x.y.kobe.jp/": "x.y.kobe.jp", "https://city.kobe.jp/": "city.kobe.jp", "https://co.uk/": ".co.uk",
        "https://a.unknown/": "unknown."}


@pytest.mark.parametrize("raw, want", [
    ("HTTP://Example.COM", "http://example.com/"), ("https://a.b/C?x#y", "https://a.b/C?x#y"),
    ("http://a.b:80/x", "http://a.b/x"), ("https://a.b:443", "https://a.b/"), ("https://a.b?q", "https://a.b/?q"),
    ("ftp://a.b/", None), ("not a url", None), ("https:///x", None)])
def test_normal_url(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "u string").select(ux.normal_url("u").alias("n")).first()["n"]
    assert got == want


RATINGS = [(0, None, "left", "low"), (1, "https://www.CNN.com/", "left-center", "mixed"), (2, "https://edition.cnn.com", "x", "y"),
           (3, "https://cnnxcom.org", "right", "high"), (4, "https://bbc.co.uk", None, "high")]


def test_source_bias_first_row_wins_and_regex_mode(spark):
    ratings = spark.createDataFrame(RATINGS, "row_no long, url string, bias_rating string, factual_reporting_rating string")
    domains = spark.createDataFrame([(d,) for d in ("cnn.com", "nnx.om", "bbc.co.uk", "none.org")], "domain string")
    cols = ("domain", "bias_rating", "matched")
    assert values(st.source_bias(domains, ratings), *cols) == [
        ("bbc.co.uk", None, True), ("cnn.com", "left-center", True), ("nnx.om", None, False), ("none.org", None, False)]
    wild = dict((r[0], r[1]) for r in values(st.source_bias(domains, ratings, "regex"), *cols))
    assert wild["cnn.com"] == "left-center" and wild["nnx.om"] == "right"
    only = spark.createDataFrame([("nxc.m",)], "domain string")
    assert values(st.source_bias(only, ratings, "literal"), "matched") == [(False,)]


def test_containing_matches_nested_loop(spark):
    texts = ["abcdefghijkl", "xxabcxx", "ab", "", "zzzz", "a.c", "abc"]
    needles = ["abc", "b", "defghijkl", "zz", "q", "a.c"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    assert values(st.containing(t, n), "text", "needle") == sorted((a, b) for a in texts for b in needles if b in a)
    assert values(st.containing(t, n, wildcard=True), "text", "needle") == sorted(
        (a, b) for a in texts for b in needles if re.search(b, a))


def test_ratings_csv_without_a_column(spark, tmp_path):
    (tmp_path / "r.csv").write_text("url,bias_rating\nhttps://a.org,left\nhttps://b.org,\n", encoding="utf-8")
    rows = rt.read_ratings(spark, str(tmp_path / "r.csv")).orderBy("row_no").collect()
    assert [(r["url"], r["bias_rating"], r["factual_reporting_rating"]) for r in rows] == [
        ("https://a.org", "left", "N/A"), ("https://b.org", None, "N/A")]


TABLE = """<table><tr><td>a</td><td>Generally reliable in its field</td><td>1</td><td>2</td><td>3</td>
<td><span><a href="/x" title="Other">o</a><a title="HTTPS links" href="1234567890123456789012345https://*.a.org">l</a></span></td></tr>
<tr><td>b</td><td>Deprecated</td><td>1</td><td>2</td><td>3</td><td><a title="HTTPS links" href="1234567890123456789012345b">l</a></td></tr>
<tr><td>c</td><td>Generally reliable</td><td>1</td><td>2</td><td><a title="HTTPS links" href="1234567890123456789012345c">l</a></td></tr>
<tr><td>d</td><td>Generally reliable</td><td>1</td><td>2</td><td>3</td><td>none</td></tr></table>"""


def test_harvest_and_sink(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", TABLE)], "page_id long, url string, html string")
    found = sl.harvest(pages)
    assert values(found, "pattern") == [("https://*.a.org",)]
    sl.save_sites(found, str(tmp_path / "sites"))
    assert values(sl.load_sites(spark, str(tmp_path / "sites")), "pattern") == [("https://*.a.org",)]
    with pytest.raises(AnalysisException):
        sl.load_sites(spark, str(tmp_path / "nothing"))


def test_search_reply_shapes(spark):
    rows = [(1, "serpapi", '{"organic_results": [{"link": "a"}, {"title": "x"}, {"link": ""}, {"link": "b"}]}'),
            (2, "serper", '{"organic": [{"link": "c"}]}'), (3, "duckduckgo", '[{"href": "d"}, {"href": "e"}]'),
            (4, "tavily", '{"results": [{"url": "f"}]}'), (5, "serper", '{"other": 1}'), (6, "tavily", "not json"),
            (7, "unknown", "[]")]
    df = spark.createDataFrame(rows, "claim_id int, provider string, reply string")
    assert values(rp.search_hits(df), "claim_id", "search_rank", "url") == [
        (1, 1, "a"), (1, 4, "b"), (2, 1, "c"), (3, 1, "d"), (3, 2, "e"), (4, 1, "f")]


def html(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>';</script></head><body>{body}</body></html>"


def test_page_text_and_blocks(spark):
    page = html("<!-- x --><nav>menu</nav><article><h1>Head</h1><p>One &amp; <b>two</b><br>three<p>four</p>"
                "<table><tr><td>cell</td></tr></table></article><footer>&copy; f</footer>")
    row = spark.createDataFrame([(page,)], "html string").select(
        hx.page_text("html").alias("t"), hx.content_blocks("html").alias("b")).first()
    assert row["t"] == "T menu Head One & two three four cell © f"
    assert row["b"] == ["Head", "One & two", "three", "four"]


def test_repeated_blocks_are_boilerplate(spark):
    pages = [(i, f"https://h.org/{i}", html(f"<article><p>Subscribe now</p><p>Text {i}</p></article>")) for i in range(3)]
    pages += [(9, "https://other.org/9", html("<article><p>Subscribe now</p><p>Text 9</p></article>")),
              (10, "https://h.org/10", html("<article></article>"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    content = pg.main_content(df, min_pages=3)
    got = dict(values(content, "page_id", "text"))
    assert got == {0: "Text 0", 1: "Text 1", 2: "Text 2", 9: "Subscribe now\nText 9", 10: ""}
    assert dict(values(pg.titled(content), "page_id", "text"))[0] == "T\n\nText 0"
    assert dict(values(pg.titled(content), "page_id", "text"))[10] is None
    status = dict(values(pg.load_status(df, content), "page_id", "reason"))
    assert status[10] == "no text extracted" and status[0] is None


def test_override_wins_when_not_empty(spark):
    arts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "article_id long, text string")
    over = spark.createDataFrame([(1, "x"), (2, "")], "article_id long, text string")
    assert values(pg.article_text(arts, over), "article_id", "text", "overridden") == [
        (1, "x", True), (2, "b", False), (3, "c", False)]
    assert pg.article_text(arts, over).filter(F.col("overridden")).count() == 1


def test_character_references(spark):
    texts = ["a &amp; b", "&amp;lt; &lt;b&gt;", "caf&eacute; &#233; &#xE9; &#X20AC; &#128512;", "&unknown; & &; &#; &#x; AT&T", "&nbsp;x&#160;y&copy", "&#0; &#xD800; &#9999999;",
             "no reference", "", None, "&&amp;&&", "&Omega;&quot;&apos;&hellip;"]
    want = ["a & b", "&lt; <b>", "café é é € 😀", "&unknown; & &; &#; &#x; AT&T", " x y&copy", "� � �", "no reference", "", None, "&&&&", "Ω\"'…"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r.d for r in df.select("id", hx.decode(df.t).alias("d")).orderBy("id").collect()] == want


def test_ratings_are_numbered_by_file_and_place(spark, tmp_path):
    for part, rows in (("b.csv", 4000), ("a.csv", 3000)):
        (tmp_path / part).write_text("url,bias_rating\n" + "".join(f"{part}-{i:05d},left\n" for i in range(rows)))
    want = [f"a.csv-{i:05d}" for i in range(3000)] + [f"b.csv-{i:05d}" for i in range(4000)]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "10k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = rt.read_ratings(spark, str(tmp_path)).orderBy("row_no").collect()
            assert [(r.row_no, r.url) for r in got] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
