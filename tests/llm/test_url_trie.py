import random

import pytest

from attesta.llm import url_trie
from attesta.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = rest[:min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(0 if h == "" else h.count(".") + 1, len(p), v, h + p) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


ODD = [None, "", "no scheme", "http://", "https://example.com", "https://example.com/en", "https://EXAMPLE.com/en/x?y#z", "a://b://c.com/", "http://notexample.com/en/",
       "http://x.example.com/en/", "http://www.example.com/en/1", "http://.com/", "http://com./", "http://a.net/es/?q", "http://É.NET/fr/", "http://u@h.com:80/\nx", "http://a.net?/es/"]


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return [(r.host, r.path, r.rule, r.verdict) for r in url_trie.judge(pages, table, **options).orderBy("page_id").collect()]


@pytest.mark.parametrize("trie_bytes", [url_trie.TRIE_BYTES, 0])
def test_random_rules_as_brute_force(spark, trie_bytes):
    rng = random.Random(5)
    labels, segments = ["a", "b", "com", "net", ""], ["en", "e", "x1", ""]
    def host():
        return ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    def path():
        return "".join("/" + s for s in rng.choices(segments, k=rng.randint(0, 3)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)} | {(h, p): v for h, p, v in URL_RULES}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = ODD + [f"http://{host()}{path()}{rng.choice(['', 'n', '/', '?q', '#f/'])}" for _ in range(400)]
    assert judged(spark, urls, rules, trie_bytes=trie_bytes) == [brute(u, rules) for u in urls]


def test_null_rules_and_ties(spark):
    rules = [(None, None, "block"), ("a.com", None, "allow"), ("a.com", "", "block"), ("B.com", "/x", "allow"), ("b.com", "/x/", None)]
    assert [r[2:] for r in judged(spark, ["http://z/", "http://a.com/q", "http://c.b.com/x/y"], rules)] == [
        ("", "block"), ("a.com", "block"), ("b.com/x", "allow")]
    assert judged(spark, ["http://z/"], [], default="block") == [("z", "/", None, "block")]


def test_clashing_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", "h", "r", "b"), (1, "http://a.com/", "h", "r", "b")], "id int, url string, host string, rule string, __best string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_trie.judge(pages, rules)
    assert [(r.id, r["__best"], r.host, r.rule, r.verdict) for r in got.collect()] == [(1, "b", "a.com", "com/", "allow")] * 2
    assert url_trie.judge(pages.limit(0), rules).count() == 0
