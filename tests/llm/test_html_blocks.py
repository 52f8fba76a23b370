import html
import re

import pytest

from attesta.llm import html_blocks

SMALL = "/root/testdata/sf0.01"


HELD_OUT = "crc32(cast(page_id AS string)) % 3 = 1"


@pytest.fixture(scope="module")
def labeller(spark):
    return html_blocks.fit(spark.read.parquet(f"{SMALL}/pages.parquet").filter(f"NOT {HELD_OUT}"))


def test_blocks_of_broken_markup():
    page = "<p>a <b>b<br>c<p>d &amp; e&nbsp;f<script>var t='</p>';</script><div class='x y-z'>g</i><ul><li>h<li>i</ul><a href='>'>j</a> &am"
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["a b c", "d & e f", "g", "h", "i", "j &am"]
    assert "z" in got[2].path
    for odd in ("<", "<p", "</", "<!-- x", "<script>", "a < b", "<a href=\"x>y", "\x00", "<" * 5000, "<b>" * 3000):
        html_blocks.blocks(odd)


def test_articles_of_given_pages(spark, labeller):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").filter(HELD_OUT)
    right = 0
    rows = html_blocks.extract(pages, labeller).join(pages.select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search("<article>(.*?)(?:</article>|\\Z)", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        right += r.text == "\n".join(w for w in want if w)
    assert right >= 0.98 * len(rows)


def test_elements_without_an_end_swallow_nothing():
    cases = {"<p>One two.</p><svg class=i/><p>Three four.</p>": ["One two.", "Three four."], "<p>a</p><svg><path/><text>t</text></svg><p>b</p>": ["a", "b"],
             "<noscript><p>x</p>": ["x"], "<object data=x><p>y</p><template><p>z": ["y", "z"], "<noscript>n</noscript><p>m": ["m"], "<svg>" * 2000 + "<p>w</p>": ["w"]}
    assert {page: [b.text for b in html_blocks.blocks(page)] for page in cases} == cases


def test_blocks_of_held_out_pages_without_telling_names(spark, labeller):
    """Class words, and then all but the innermost tag, are taken away: only words, measures and neighbours are left."""
    def bare(path):
        return ("html", "body", "div", *[t for t in path[-1:] if t in ("p", "li", "a", "h1", "h2", "h3")])
    views = {"as it is": lambda p: p, "no names": lambda p: tuple(w for w in p if w not in html_blocks.OTHER | html_blocks.MAIN), "bare": bare}
    for view, path in views.items():
        counts = {(a, b): 0 for a in (0, 1) for b in (0, 1)}
        for row in spark.read.parquet(f"{SMALL}/pages.parquet").filter(HELD_OUT).collect():
            seq = html_blocks.blocks(row.html)
            x, lengths = html_blocks.padded([html_blocks.features([b._replace(path=path(b.path)) for b in seq])])
            for p, y in zip(labeller.probabilities(x, lengths)[0], html_blocks.said_by_markup(seq)):
                counts[int(p > 0.5), y] += 1
        precision, recall = counts[1, 1] / (counts[1, 1] + counts[1, 0]), counts[1, 1] / (counts[1, 1] + counts[0, 1])
        print(view, round(precision, 3), round(recall, 3))
        assert min(precision, recall) > (0.98 if view == "as it is" else 0.8), (view, precision, recall)


def test_other_layouts(labeller):
    page = """<html><body><header><p>Site name</p></header><div class="cookie-banner"><p>We use cookies.</p></div><nav><a href=x>Home</a></nav>
    <main><div class="post-content"><h1>Title of it</h1><p>First words of the article, with a comma.</p><p>Second paragraph here. It has sentences.</p></div></main>
    <aside><p>Read this too</p></aside><section class="comments"><h3>Comments</h3><p>I do not agree with it.</p></section>
    <form><label>Your mail</label></form><footer><p>All rights</p></footer></body></html>"""
    assert html_blocks.page_texts([page, ""], labeller) == [
        "Title of it\nFirst words of the article, with a comma.\nSecond paragraph here. It has sentences.", ""]


def test_odd_rows(spark, labeller):
    rows = [(1, "u", None, 1), (None, None, "", 2), (2, "u", "<article><p>A text.</p></article>", 3), (2, "u", "<article><p>A text.</p></article>", 3), (3, "u", "<p>" + "word " * 200_000, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_blocks.extract(pages, labeller).collect()
    assert len(got) == 5 and all(r.text is not None for r in got)
    assert html_blocks.extract(pages.limit(0), html_blocks.fit(pages.limit(0))).count() == 0
