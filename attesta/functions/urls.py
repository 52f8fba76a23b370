"""URL columns: host, normal form, site patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import col, strip

# URL shape, default ports, characters a regex gives meaning to.
URL_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$"
HOST_SHAPE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
REGEX_SPECIAL = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"


def host(url) -> Column:
    return F.regexp_extract(col(url), HOST_SHAPE, 1)


def normal_url(url) -> Column:
    """Scheme and host in lower case, default port dropped, ``/`` for an empty path.

    Null for anything that is not an http(s) URL with a host.
    """
    raw = strip(url)
    scheme = F.lower(F.regexp_extract(raw, URL_SHAPE, 1))
    authority = F.lower(F.regexp_extract(raw, URL_SHAPE, 2))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(
        F.regexp_replace(authority, ":443$", ""))
    rest = F.regexp_extract(raw, URL_SHAPE, 3)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    good = scheme.isin("http", "https") & (authority != "") & ~raw.rlike(r"\s")
    return F.when(good, F.concat(scheme, F.lit("://"), authority, path))


def site_address(pattern) -> Column:
    """Host and path of a site pattern: quotes, scheme and leading ``*.`` removed.

    Without a ``*.`` prefix every ``http://`` and ``https://`` is removed.
    """
    p = F.btrim(col(pattern), F.lit("'\""))
    return (
        F.when(p.startswith("https://*."), F.substr(p, F.lit(11)))
        .when(p.startswith("http://*."), F.substr(p, F.lit(10)))
        .otherwise(F.replace(F.replace(p, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")))
    )


def site_regex(address) -> Column:
    """Anchored regex of a site: http or https, any subdomains, the address, any path."""
    escaped = F.regexp_replace(col(address), REGEX_SPECIAL, r"\\$1")
    return F.concat(F.lit(r"^https?://([^./]+\.)*"), escaped, F.lit("(/.*)?$"))
