"""Text of raw web pages, as column expressions over the HTML string."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import MARK, col, let, strip

# What is cut out whole, where blocks begin.
CUT_ALWAYS = [r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>",
              r"(?is)<!doctype[^>]*>"]
CUT_FURNITURE = [r"(?is)<nav[^>]*>.*?</nav>", r"(?is)<header[^>]*>.*?</header>",
                 r"(?is)<footer[^>]*>.*?</footer>", r"(?is)<aside[^>]*>.*?</aside>",
                 r'(?is)<div class="ad"[^>]*>.*?</div>', r"(?is)<table[^>]*>.*?</table>", r"(?is)<img[^>]*>"]
TAG = r"(?s)<[^>]*>"
BLOCK_TAG = (r"(?is)</?(?:p|h[1-6]|br|div|li|ul|ol|section|blockquote|article|body|main|pre|tr|td|th|dl|dt|dd"
             r"|figure|figcaption|hr)(?:\s[^>]*)?/?>")
#: A reference after its ampersand: decimal, hexadecimal, or a name.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {**name2codepoint, "apos": 39, "nbsp": 32}      # the standard names; a non-breaking space reads as a space


def cut(html: Column, patterns: list[str]) -> Column:
    for p in patterns:
        html = F.regexp_replace(html, p, " ")
    return html


def decode(text: Column) -> Column:
    """Character references decoded, each once: named, decimal and hexadecimal. What is none stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, REFERENCE, 1)
        hexed = name.rlike("^#[xX]")
        code = (F.when(hexed, F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8))
                .otherwise(F.try_element_at(names, name).cast("string")).cast("int"))
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(code == 0xA0, 32).otherwise(code)), 8, "0")), "UTF-32")
        shown = F.when(known, char).when(name.startswith("#"), F.lit("\ufffd"))
        return F.when(shown.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(shown, F.substr(p, F.length(name) + 2)))

    return let(F.split(text, "&"), lambda parts: F.when(F.size(parts) == 1, F.get(parts, 0)).otherwise(F.concat(
        F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))))


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, MARK), lambda s: strip(decode(s))), lambda s: s != "")


def page_text(html) -> Column:
    """All text nodes, stripped, blanks dropped, joined with one space."""
    return F.array_join(_pieces(F.regexp_replace(cut(col(html), CUT_ALWAYS), TAG, MARK)), " ")


def content_blocks(html) -> Column:
    """Text blocks of ``<article>`` (else ``<body>``, else everything) without page furniture."""
    clean = cut(col(html), CUT_ALWAYS + CUT_FURNITURE)
    article = F.regexp_extract(clean, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.regexp_extract(clean, r"(?is)<body[^>]*>(.*)$", 1)
    main = F.when(article != "", article).when(body != "", body).otherwise(clean)
    marked = F.regexp_replace(F.regexp_replace(main, BLOCK_TAG, MARK), TAG, "")
    flat = F.transform(_pieces(marked), lambda s: F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " "))
    return F.filter(flat, lambda s: s != "")


def page_title(html) -> Column:
    """``<title>``, else the first heading."""
    def text_of(tag):
        inner = F.regexp_extract(col(html), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return strip(F.regexp_replace(decode(F.regexp_replace(inner, TAG, "")), r"[ \t\n\r\f\x0B]+", " "))

    return F.when(text_of("title") != "", text_of("title")).otherwise(text_of("h1"))
