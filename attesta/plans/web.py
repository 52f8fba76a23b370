"""Queries over raw pages: text, titles, URLs, reliable sites, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import html as hx
from attesta.functions import urls as ux
from attesta.operators import sites as st
from attesta.operators.staging import spread, stage_path
from attesta.plans import tables as tb
from attesta.plans.registry import query
from attesta.plans.sqlkit import WS, cte, strip, with_ctes
from attesta.sources import pages as pg
from attesta.sources import ratings as rt
from attesta.sources import replies as rp
from attesta.sources import sites as sl

# the references that the given pages hold
ENTITIES = [("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]

BIAS = ["left", "left-center", "center", "right-center", "right"]      # fixed rating scale
FACTUAL = ["low", "mixed", "high"]                                     # fixed rating scale


def pages(spark, sf):
    return spread(tb.table(spark, sf, "pages"), "page_id")


def page_hosts(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", "url", ux.host("url").alias("host"))


def suffix_rules(spark, sf):
    hosts = page_hosts(spark, sf)
    return (hosts.select(F.substring_index("host", ".", -1).alias("suffix"))
            .union(hosts.select(F.substring_index("host", ".", -2))).distinct())


def page_site_patterns(spark, sf):
    """Hosts served only over https as whole sites, of the others the English section."""
    return page_hosts(spark, sf).groupBy("host").agg(
        F.bool_and(F.col("url").startswith("https://")).alias("safe")).select(
        F.when(F.col("safe"), F.concat(F.lit("https://*."), "host"))
        .otherwise(F.concat(F.lit("https://"), "host", F.lit("/en"))).alias("pattern"))


def page_ratings(spark, sf):
    """One rating row per host, in order of its first page."""
    def pick(words, at):
        return F.get(F.array(*[F.lit(w) for w in words]), at)
    return page_hosts(spark, sf).groupBy("host").agg(F.min("page_id").alias("row_no")).select(
        "row_no", F.concat(F.lit("https://WWW."), "host").alias("url"),
        pick(BIAS, F.length("host") % 5).alias("bias_rating"),
        pick(FACTUAL, (F.col("row_no") % 3).cast("int")).alias("factual_reporting_rating"))


def _cut(x, patterns):
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


def _decode(x):
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char if char != chr(39) else chr(39) * 2}')"
    return x


def _pieces(x):
    return (f"list_filter(list_transform(string_split({x}, chr(1)), lambda s: {strip(_decode('s'))}), "
            "lambda s: s <> '')")


cte("page_hosts", "SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS host FROM pages")
cte("suffix_rules", "SELECT DISTINCT unnest([split_part(host, '.', -1), split_part(host, '.', -2) || '.' || "
    "split_part(host, '.', -1)]) AS suffix FROM page_hosts", "page_hosts")
cte("page_domains", """SELECT url, domain FROM (SELECT url, suffix,
      split_part(substr(host, 1, length(host) - length(suffix) - 1), '.', -1) || '.' || suffix AS domain,
      row_number() OVER (PARTITION BY url ORDER BY length(suffix) DESC) AS r
      FROM (SELECT DISTINCT url, lower(host) AS host FROM page_hosts) h
      JOIN suffix_rules s ON ends_with(host, '.' || suffix)) WHERE r = 1""", "page_hosts", "suffix_rules")
cte("page_patterns", """SELECT CASE WHEN bool_and(starts_with(url, 'https://')) THEN 'https://*.' || host
      ELSE 'https://' || host || '/en' END AS pattern, regexp_replace(pattern, '^https://([*][.])?', '') AS address
      FROM page_hosts GROUP BY host""", "page_hosts")
cte("page_regexes", """SELECT pattern, address, '^https?://([^./]+\\.)*' ||
      replace(replace(address, '.', '\\.'), '-', '\\-') || '(/.*)?$' AS regex FROM page_patterns""", "page_patterns")
cte("page_ratings", f"""SELECT min(page_id) AS row_no, 'https://WWW.' || host AS url,
      {BIAS}[length(host) % 5 + 1] AS bias_rating, {FACTUAL}[min(page_id) % 3 + 1] AS factual_reporting_rating
      FROM page_hosts GROUP BY host""", "page_hosts")
_BLOCK_HTML = _cut("html", hx.CUT_ALWAYS + hx.CUT_FURNITURE)
cte("page_blocks", f"""SELECT page_id, url, host, list_filter(list_transform({_pieces(
      f"regexp_replace(regexp_replace(main, '{hx.BLOCK_TAG}', chr(1), 'g'), '{hx.TAG}', '', 'g')")},
      lambda s: regexp_replace(s, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), lambda s: s <> '') AS blocks FROM (
      SELECT page_id, url, host, coalesce(nullif(regexp_extract(clean, '(?is)<article[^>]*>(.*?)</article>', 1), ''),
        nullif(regexp_extract(clean, '(?is)<body[^>]*>(.*)$', 1), ''), clean) AS main
      FROM (SELECT page_id, p.url, host, {_BLOCK_HTML} AS clean FROM pages p JOIN page_hosts USING (page_id)))""",
    "page_hosts")
cte("page_main", """SELECT b.page_id, b.url, coalesce(string_agg(e.block, chr(10) ORDER BY e.pos)
        FILTER (WHERE r.block IS NULL), '') AS text
      FROM page_blocks b
      LEFT JOIN (SELECT page_id, host, generate_subscripts(blocks, 1) AS pos, unnest(blocks) AS block FROM page_blocks) e
        USING (page_id)
      LEFT JOIN (SELECT host, block FROM (SELECT DISTINCT page_id, host, unnest(blocks) AS block FROM page_blocks)
        JOIN (SELECT host, count(*) AS pages FROM page_blocks GROUP BY host) USING (host)
        GROUP BY host, block, pages HAVING count(*) >= 3 AND count(*) >= 0.2 * pages) r ON r.host = e.host AND r.block = e.block
      GROUP BY b.page_id, b.url""", "page_blocks")
_T = ("trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), " + WS + ")").format(
    _decode("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', '', 'g')"))
_H = _T.replace("<title", "<h1").replace("</title", "</h1")
cte("page_titled", f"""SELECT page_id, m.url, coalesce(nullif({_T}, ''), {_H}) AS title, {strip('text')} AS body
      FROM page_main m JOIN pages p USING (page_id)""", "page_main")


@query("s02_page_text", f"""SELECT page_id, url, array_to_string({_pieces(
    f"regexp_replace({_cut('html', hx.CUT_ALWAYS)}, '{hx.TAG}', chr(1), 'g')")}, ' ') AS text FROM pages""")
def s02_page_text(spark, sf):
    return pages(spark, sf).select("page_id", "url", hx.page_text("html").alias("text"))


@query("s03_main_content", with_ctes("SELECT page_id, url, text FROM page_main", "page_main"))
def s03_main_content(spark, sf):
    return pg.main_content(pages(spark, sf)).select("page_id", "url", "text")


@query("s04_titled_article", with_ctes(
    "SELECT page_id, url, CASE WHEN body = '' THEN NULL WHEN title <> '' THEN title || chr(10) || chr(10) || body "
    "ELSE body END AS text FROM page_titled", "page_titled"))
def s04_titled_article(spark, sf):
    return pg.titled(pg.main_content(pages(spark, sf)))


@query("s05_load_status", with_ctes(
    f"""SELECT page_id, url, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason, text_chars FROM (
      SELECT p.page_id, p.url, CASE WHEN NOT regexp_matches(p.url, '^https?://[^/?#]') THEN 'bad url'
        WHEN {strip('html')} = '' THEN 'nothing downloaded' WHEN {strip('text')} = '' THEN 'no text extracted'
        END AS reason, length(text) AS text_chars
      FROM (SELECT page_id, url, html FROM pages) p JOIN page_main m USING (page_id))""", "page_main"))
def s05_load_status(spark, sf):
    raw = pages(spark, sf)
    return pg.load_status(raw, pg.main_content(raw))


@query("s06_ratings_scan", with_ctes("SELECT row_no, url, bias_rating, factual_reporting_rating FROM page_ratings",
                                     "page_ratings"))
def s06_ratings_scan(spark, sf):
    path = stage_path(spark, "ratings")
    page_ratings(spark, sf).write.option("header", True).csv(path)
    return rt.read_ratings(spark, path)


@query("s06_ratings_in_file_order", with_ctes(
    "SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, url, bias_rating, factual_reporting_rating FROM page_ratings", "page_ratings"))
def s06_ratings_in_file_order(spark, sf):
    """Several files without a number column: rows are numbered as the files have them."""
    path = stage_path(spark, "ratings")
    page_ratings(spark, sf).repartitionByRange(4, "row_no").sortWithinPartitions("row_no").drop("row_no").write.option("header", True).csv(path)
    return rt.read_ratings(spark, path)


@query("s07_reliable_sites", with_ctes(
    "SELECT pattern, split_part(address, '/', 1) AS host, substr(address, length(split_part(address, '/', 1)) + 1) "
    "AS path, regex FROM page_regexes", "page_regexes"))
def s07_reliable_sites(spark, sf):
    folder = stage_path(spark, "sites")
    sl.save_sites(page_site_patterns(spark, sf), folder)
    return sl.reliable_sites(sl.load_sites(spark, folder))


def rating_table_pages(spark, sf):
    """Rating tables as a site list page would show them, one per page, from host and title."""
    target = F.concat(F.lit("/special/search?target=xx"), F.lit("https://*."), "host")
    six = F.concat(F.lit("<tr><td>"), "host", F.lit("</td><td>"),
                   F.when(F.col("url").startswith("https://"), "Generally reliable").otherwise("Deprecated"),
                   F.lit('</td><td>1</td><td>2</td><td>3</td><td><span><a title="Other" href="/x">o</a>'
                         '<a title="HTTPS links" href="'), target, F.lit('">l</a></span></td></tr>'))
    five = F.concat(F.lit("<tr><td>"), "host", F.lit("</td><td>Generally reliable</td><td>1</td><td>2</td>"
                                                     '<td><a title="HTTPS links" href="'), target, F.lit('">l</a></td></tr>'))
    html = F.concat(F.lit("<table><tr><th>Name</th></tr>"), six, five, F.lit("</table>"))
    return page_hosts(spark, sf).select("page_id", "url", html.alias("html"))


@query("s08_harvested_sites", with_ctes(
    "SELECT page_id, 1 AS row_pos, 1 AS link_pos, 'https://*.' || host AS pattern FROM page_hosts "
    "WHERE starts_with(url, 'https://')", "page_hosts"))
def s08_harvested_sites(spark, sf):
    return sl.harvest(rating_table_pages(spark, sf))


@query("s09_saved_site_list", with_ctes("SELECT 'https://*.' || host AS value FROM page_hosts "
                                        "WHERE starts_with(url, 'https://')", "page_hosts"))
def s09_saved_site_list(spark, sf):
    folder = stage_path(spark, "harvest")
    sl.save_sites(sl.harvest(rating_table_pages(spark, sf)), folder)
    return spark.read.text(f"{folder}/text")


def search_responses(spark, sf):
    """Saved search replies in the four service shapes; every tenth lacks its result list."""
    shapes = list(rp.SHAPES.items())
    kind = F.col("page_id") % 4
    provider, reply = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, (key, link)) in enumerate(shapes):
        rows = F.concat(*[part for u in (F.col("url"), F.lit(""), F.concat(F.lit("https://"), "host"))
                          for part in (F.lit(f'{{"{link}": "'), u, F.lit('", "title": "t"},'))])
        body = F.concat(F.lit("["), F.regexp_replace(rows, ",$", ""), F.lit("]"))
        if key:
            body = F.concat(F.lit(f'{{"{key}": '), body, F.lit("}"))
        provider = F.when(kind == i, name).otherwise(provider)
        reply = F.when(kind == i, body).otherwise(reply)
    broken = F.when(F.col("page_id") % 10 == 9, F.lit('{"message": "none"}')).otherwise(reply)
    return page_hosts(spark, sf).select(F.col("page_id").alias("claim_id"), provider.alias("provider"),
                                        broken.alias("reply"))


@query("s10_search_replies", with_ctes(
    "SELECT page_id AS claim_id, 1 AS search_rank, url FROM page_hosts WHERE page_id % 10 <> 9 UNION ALL "
    "SELECT page_id, 3, 'https://' || host FROM page_hosts WHERE page_id % 10 <> 9", "page_hosts"))
def s10_search_replies(spark, sf):
    return rp.search_hits(search_responses(spark, sf))


@query("p01_registrable_domain", with_ctes("SELECT url, domain FROM page_domains", "page_domains"))
def p01_registrable_domain(spark, sf):
    return st.registrable_domains(tb.table(spark, sf, "pages"), suffix_rules(spark, sf))


@query("p02_site_regex", with_ctes("SELECT pattern, regex FROM page_regexes", "page_regexes"))
def p02_site_regex(spark, sf):
    return page_site_patterns(spark, sf).select("pattern", ux.site_regex(ux.site_address("pattern")).alias("regex"))


@query("p03_reliable_urls", with_ctes(
    "SELECT DISTINCT url FROM pages WHERE EXISTS (SELECT 1 FROM page_regexes WHERE regexp_matches(url, regex))",
    "page_regexes"))
def p03_reliable_urls(spark, sf):
    return st.reliable_urls(tb.table(spark, sf, "pages"), sl.reliable_sites(page_site_patterns(spark, sf)))


@query("p04_substring_sites", with_ctes(
    "SELECT DISTINCT url FROM pages WHERE EXISTS (SELECT 1 FROM page_patterns WHERE contains(url, address))",
    "page_patterns"))
def p04_substring_sites(spark, sf):
    urls = tb.table(spark, sf, "pages").select(F.col("url").alias("text"))
    needles = page_site_patterns(spark, sf).select(ux.site_address("pattern").alias("needle"))
    return st.containing(urls, needles).select(F.col("text").alias("url")).distinct()


@query("p11_normal_url", with_ctes("""SELECT page_id, variant, raw_url, CASE WHEN variant = 'other scheme' THEN NULL
      WHEN variant = 'bare host' THEN regexp_extract(url, '^[a-z]+', 0) || '://' || host || '/'
      ELSE url END AS url FROM (SELECT page_id, host, url, unnest([
        {'variant': 'as is', 'raw_url': url},
        {'variant': 'upper', 'raw_url': upper(regexp_extract(url, '^([a-z]+://[^/]+)(.*)$', 1))
          || regexp_extract(url, '^([a-z]+://[^/]+)(.*)$', 2)},
        {'variant': 'bare host', 'raw_url': regexp_extract(url, '^[a-z]+', 0) || '://' || host},
        {'variant': 'other scheme', 'raw_url': 'ftp://' || host || '/'}], recursive := true) FROM page_hosts)""",
    "page_hosts"))
def p11_normal_url(spark, sf):
    head = F.regexp_extract("url", r"^([a-z]+://[^/]+)(.*)$", 1)
    tail = F.regexp_extract("url", r"^([a-z]+://[^/]+)(.*)$", 2)
    scheme = F.regexp_extract("url", r"^([a-z]+)", 1)
    variants = F.array(*[F.struct(F.lit(name).alias("variant"), v.alias("raw_url")) for name, v in (
        ("as is", F.col("url")), ("upper", F.concat(F.upper(head), tail)),
        ("bare host", F.concat(scheme, F.lit("://"), "host")),
        ("other scheme", F.concat(F.lit("ftp://"), "host", F.lit("/"))))])
    return (page_hosts(spark, sf).select("page_id", F.inline(variants))
            .select("page_id", "variant", "raw_url", ux.normal_url("raw_url").alias("url")))


def page_domains(spark, sf):
    return st.registrable_domains(tb.table(spark, sf, "pages"), suffix_rules(spark, sf))


_BIAS_SQL = """SELECT p.page_id, p.url, d.domain, r.bias_rating, r.factual_reporting_rating,
      r.row_no IS NOT NULL AS matched FROM pages p JOIN page_domains d USING (url)
      LEFT JOIN (SELECT domain, min(row_no) AS row_no FROM (SELECT DISTINCT domain FROM page_domains) x
        JOIN page_ratings t ON {cond} GROUP BY domain) f USING (domain)
      LEFT JOIN page_ratings r USING (row_no)"""


@query("j01_source_bias", with_ctes(_BIAS_SQL.format(cond="contains(lower(t.url), domain)"),
                                    "page_domains", "page_ratings"))
def j01_source_bias(spark, sf):
    domains = page_domains(spark, sf)
    bias = st.source_bias(domains, page_ratings(spark, sf))
    return (tb.table(spark, sf, "pages").select("page_id", "url").join(domains, "url").join(bias, "domain")
            .select("page_id", "url", "domain", "bias_rating", "factual_reporting_rating", "matched"))


@query("j01_source_bias_regex", with_ctes(_BIAS_SQL.format(cond="regexp_matches(lower(t.url), domain)"),
                                          "page_domains", "page_ratings"))
def j01_source_bias_regex(spark, sf):
    domains = page_domains(spark, sf)
    bias = st.source_bias(domains, page_ratings(spark, sf), mode="regex")
    return (tb.table(spark, sf, "pages").select("page_id", "url").join(domains, "url").join(bias, "domain")
            .select("page_id", "url", "domain", "bias_rating", "factual_reporting_rating", "matched"))
