"""URL and text expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^/?#\\:@\x00-\x20<>^|%]+)(?::[0-9]*)?(?=[/?#\\]|[\x00-\x20]*$)"


def clean_text(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\t-\r \x{85}\p{Z}]+", " "))


def host(url: Column) -> Column:
    """The lower-case host without user and port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")))


def root_url(domain: Column) -> Column:
    """``https://domain/``, the domain's host in lower case; what doesn't parse stays as it is."""
    raw = F.concat(F.lit("https://"), domain)
    own = host(raw)
    plain = F.lower(domain) == own
    return F.when(plain, F.concat(F.lit("https://"), own, F.lit("/"))).otherwise(raw)


def is_root_url(url: Column) -> Column:
    """Whether the URL has a host, no path but ``/``, no query and no fragment."""
    return F.coalesce(host(url).isNotNull() & url.rlike(r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]+[/\\]?[\x00-\x20]*$"), F.lit(False))


def input_domain(text: Column) -> Column:
    """The host of what a user enters as a domain or URL; null if it is neither."""
    t = F.trim(text)
    return host(F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("https://"), t)))


def checked_input_domain(text: Column) -> Column:
    """``input_domain``, but an error for what is neither a domain nor a URL."""
    return F.coalesce(input_domain(text), F.raise_error(F.concat(F.lit("Invalid domain or URL: "), text)).cast("string"))


def resolve(href: Column, base: Column) -> Column:
    """An href against a domain: full http(s) URLs stay, all else hangs on the domain's root."""
    full = href.startswith("http://") | href.startswith("https://")
    rooted = F.concat(F.lit("https://"), base, href)
    return F.when(full, href).when(href.startswith("/"), rooted).otherwise(F.concat(F.lit("https://"), base, F.lit("/"), href))


def same_domain(url: Column, base: Column) -> Column:
    """Whether the URL's host is the domain or one of its subdomains."""
    own = host(url)
    return F.coalesce((own == base) | F.endswith(own, F.concat(F.lit("."), base)), F.lit(False))
