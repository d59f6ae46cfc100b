"""URL -> host Column functions.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and run as a narrow projection on any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.functions.chars import nfkc_delimiter_class, python_space_points

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The authority part of a URL as Python's urlsplit finds it: an optional
# scheme (a letter, then letters, digits, '+', '-', '.') up to the first ':',
# then '//' and everything up to the first '/', '?' or '#'.  Without '//' the
# netloc is the empty string.
_NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def _split_netloc(url: Column) -> Column:
    # urlsplit removes tab/CR/LF everywhere and leading C0 controls/spaces.
    u = F.regexp_replace(url, r"[\t\r\n]", "")
    u = F.regexp_replace(u, r"^[\x00-\x20]+", "")
    net = F.regexp_extract(u, _NETLOC_RE, 1)
    # Unbalanced IPv6 brackets make urlsplit raise -> the helper returns None.
    bad = net.contains("[") != net.contains("]")
    both = net.contains("[") & net.contains("]")
    return (
        F.when(url.isNull(), F.lit(None))
        .when(bad, F.lit(None))
        .when(both & ~_bracketed_ok(net), F.lit(None))
        # characters that turn into delimiters under NFKC make it raise, too
        .when(net.rlike(nfkc_delimiter_class()), F.lit(None))
        .otherwise(net)
    )


def bracketed_netloc_re() -> tuple[str, str]:
    """Patterns for urlsplit's check of a netloc holding brackets, applied to
    the part after the last '@': either ``[literal]`` with an optional
    ``:port`` (literal = IPv6 address with optional zone id, or IPvFuture
    ``v<hex>.<text>``), or -- without '[' there -- an IPvFuture host
    before the first ':'."""
    from hostscope.functions.host import IPV6_STRICT_PATTERN

    assert IPV6_STRICT_PATTERN.startswith("^") and IPV6_STRICT_PATTERN.endswith(r"\z")
    v6 = IPV6_STRICT_PATTERN[1:-2].replace("(?:%[^%]+)?", r"(?:%[^%\]]+)?")
    future = r"v[a-fA-F0-9]+\.[^\]]+"
    return rf"^\[(?:{v6}|{future})\](?::.*)?\z", r"^v[a-fA-F0-9]+\.[^:]+(?::.*)?\z"


def _bracketed_ok(net: Column) -> Column:
    hp = F.substring_index(net, "@", -1)
    in_brackets, bare = bracketed_netloc_re()
    return F.coalesce(hp.rlike(in_brackets) | (~hp.contains("[") & hp.rlike(bare)), F.lit(False))


def netloc_app(url: ColumnOrName) -> Column:
    """Lower-cased netloc with every ``www.`` removed; port/userinfo kept."""
    return F.replace(F.lower(_split_netloc(_col(url))), F.lit(lists.WWW), F.lit(""))


def netloc_notebook(url: ColumnOrName) -> Column:
    """Lower-cased netloc with only a leading ``www.`` removed."""
    return F.regexp_replace(F.lower(_split_netloc(_col(url))), "^" + lists.WWW.replace(".", r"\."), "")


def py_strip(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends
    (a set-based ``btrim``, no regex)."""
    return F.btrim(_col(c), F.lit("".join(chr(p) for p in python_space_points())))


def js_trim(c: ColumnOrName) -> Column:
    """JavaScript ``String.prototype.trim``."""
    from hostscope.functions.chars import JS_SPACE_POINTS

    return F.btrim(_col(c), F.lit("".join(chr(p) for p in JS_SPACE_POINTS)))


def clean_host(domain: ColumnOrName) -> Column:
    """Strip, lower, drop ``http(s)://``, cut at first '/', then first ':'."""
    d = F.lower(py_strip(domain))
    d = F.regexp_replace(d, lists.HTTP_PREFIX_RE, "")
    d = F.substring_index(d, "/", 1)
    return F.substring_index(d, ":", 1)
