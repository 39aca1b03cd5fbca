"""URL functions as columns: parts as in RFC 3986, case and port of the host kept."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URLs with one of these anywhere are not followed (fixed values).
SKIP_PATTERNS = (
    "/cdn-cgi/", "/wp-", ".pdf", ".jpg", ".jpeg", ".png", ".svg", ".webp",
    "/careers/", "/jobs/", "/login", "/logout", "javascript:", "mailto:", "#",
    "/zh-cn", "/pt-br", "/es-", "/de-", "/fr-",
)
#: Schemes whose last path segment may carry ;parameters (fixed values).
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """(scheme, netloc, path) of a URL, without parameters, query and fragment."""
    plain = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")
    scheme = F.lower(F.regexp_extract(plain, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*:", ""), "(?s)[?#].*$", "")
    netloc = F.regexp_extract(rest, "^//([^/]*)", 1)
    path = F.regexp_replace(rest, "^//[^/]*", "")
    path = F.when(scheme.isin(*PARAM_SCHEMES), F.regexp_replace(path, "(?s);[^/]*$", "")).otherwise(path)
    return scheme, netloc, path


def normalize(url: Column) -> Column:
    """scheme://netloc/path without closing slashes; an empty path is '/'."""
    scheme, netloc, path = _parts(url)
    bare = F.regexp_replace(path, "/+$", "")
    return F.concat(scheme, F.lit("://"), netloc, F.when(bare == "", F.lit("/")).otherwise(bare))


def netloc(url: Column) -> Column:
    return _parts(url)[1]


def skipped(url: Column, patterns: Sequence[str] = SKIP_PATTERNS) -> Column:
    """True where a pattern stands anywhere in the URL, case-sensitive."""
    return F.rlike(url, F.lit("|".join(map(re.escape, patterns)))) if patterns else F.lit(False)


def same_domain(url: Column, domains: Sequence[str]) -> Column:
    """True where the host is one of domains, or there is none."""
    return _parts(url)[1].isin("", *domains)


def slug(url: Column) -> Column:
    """A file name for a URL: the path's pieces joined by '-', lower-case; 'home' for an empty path, 'page' for one without usable characters."""
    path = F.regexp_replace(_parts(url)[2], "^/+|/+$", "")
    joined = F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "-")
    name = F.lower(F.regexp_replace(F.regexp_replace(joined, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""))
    return F.when(path == "", F.lit("home")).when(name == "", F.lit("page")).otherwise(name)
