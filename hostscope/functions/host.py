"""Host scalar features and predicates as Column expressions.

Inputs are cleaned hosts (see ``clean_host``) unless stated.  Everything is a
built-in expression: no Python UDF, nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.functions.chars import js_space_class, py_digit_class, py_space_class
from hostscope.functions.urls import ColumnOrName, _col, js_trim, py_strip


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("int")


def length(d: ColumnOrName) -> Column:
    """H1: number of code points."""
    return F.length(_col(d)).cast("int")


def subdomain_count(d: ColumnOrName) -> Column:
    """H2: max(#dot-labels - 2, 0); plain dots, not the suffix list."""
    return F.greatest(F.size(F.split(_col(d), r"\.", -1)) - 2, F.lit(0)).cast("int")


def hyphen_count(d: ColumnOrName) -> Column:
    """H3."""
    return _count(_col(d), "-")


def digit_count(d: ColumnOrName) -> Column:
    """H4: characters for which Python ``isdigit`` is true."""
    return _count(_col(d), py_digit_class())


def special_char_count(d: ColumnOrName) -> Column:
    """H5: characters that are neither alphanumeric nor '.'."""
    return _count(_col(d), r"[^\p{L}\p{N}.]")


def entropy(d: ColumnOrName) -> Column:
    """H6: Shannon entropy (bits) of the character distribution; '' -> 0.0.

    Each distinct character's count is ``len(d) - len(replace(d, ch, ''))``;
    the empty string is guarded first so ANSI mode never divides by zero.
    """
    c = _col(d)
    n = F.length(c).cast("double")
    chars = F.array_distinct(F.split(c, ""))

    def term(acc, ch):
        p = (F.length(c) - F.length(F.replace(c, ch, F.lit("")))).cast("double") / n
        return acc - p * F.log2(p)

    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(F.length(c) == 0, F.lit(0.0))
        .otherwise(F.aggregate(chars, F.lit(0.0), term))
    )


def has_keyword(d: ColumnOrName, word: str) -> Column:
    """H7: substring test -> 0/1."""
    return _col(d).contains(word).cast("int")


def keyword_flags(d: ColumnOrName) -> list[Column]:
    return [has_keyword(d, w).alias(f"has_{w}") for w in lists.FEATURE_KEYWORDS]


def has_punycode(d: ColumnOrName) -> Column:
    """H12."""
    return _col(d).contains(lists.PUNYCODE_PREFIX).cast("int")


def unicode_count(d: ColumnOrName) -> Column:
    return _count(_col(d), r"[^\x00-\x7F]")


def contains_unicode(d: ColumnOrName) -> Column:
    """H13 (a)."""
    return (unicode_count(d) > 0).cast("int")


def unicode_ratio(d: ColumnOrName) -> Column:
    """H13 (b): non-ASCII share of the length, denominator at least 1."""
    return unicode_count(d).cast("double") / F.greatest(F.length(_col(d)), F.lit(1)).cast(
        "double"
    )


# IPv4: four dot-separated runs of 1-3 ASCII digits, each at most 255.
_IPV4_SHAPE = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def is_ipv4(d: ColumnOrName) -> Column:
    c = _col(d)
    octets_ok = F.forall(F.split(c, r"\."), lambda x: x.try_cast("int") <= 255)
    return F.coalesce(F.when(c.rlike(_IPV4_SHAPE), octets_ok), F.lit(False))


def _ipv6_pattern(embedded: bool) -> str:
    """RFC 3986 ``IPv6address`` grammar, with or without a dotted IPv4 tail; optional
    zone id, trailing spaces."""
    h = "[0-9A-Fa-f]{1,4}"
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    ls32 = f"(?:{h}:{h}|{v4})" if embedded else f"{h}:{h}"
    alts = [f"(?:{h}:){{6}}{ls32}", f"::(?:{h}:){{5}}{ls32}"]
    # [ *k( h16 ":" ) h16 ] "::" tail, for k = 0..6
    tails = [f"(?:{h}:){{4}}{ls32}", f"(?:{h}:){{3}}{ls32}", f"(?:{h}:){{2}}{ls32}",
             f"{h}:{ls32}", ls32, h, ""]
    for k, tail in enumerate(tails):
        head = h if k == 0 else f"(?:(?:{h}:){{0,{k}}}{h})"
        alts.append(f"(?:{head})?::{tail}")
    return r"^(?:" + "|".join(alts) + r")(?:%.+)?\s*$"


IPV6_PATTERN = _ipv6_pattern(embedded=False)
# Address literal only: optional zone id, nothing around it.  Patterns that
# must end at the very end of the text use \z: Java's $ also matches before
# a final line terminator (\n, \r, U+0085, U+2028, U+2029).
IPV6_STRICT_PATTERN = _ipv6_pattern(embedded=True).replace(r"(?:%.+)?\s*$", r"(?:%[^%]+)?\z")


def is_ip(d: ColumnOrName) -> Column:
    """IPv4 with octets 0-255, else the IPv6 grammar without dotted tails."""
    c = _col(d)
    return is_ipv4(c) | F.coalesce(c.rlike(IPV6_PATTERN), F.lit(False))


def is_ip_strict(d: ColumnOrName) -> Column:
    """H17 (notebook): strict address parse -> 0/1.

    IPv4 must be dotted decimal without leading zeros; IPv6 follows the
    grammar with an optional zone id and no surrounding spaces.
    """
    c = _col(d)
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"^{octet}(?:\.{octet}){{3}}\z"
    return F.coalesce(c.rlike(v4) | c.rlike(IPV6_STRICT_PATTERN), F.lit(False)).cast("int")


def has_mixed_script(d: ColumnOrName) -> Column:
    """Latin and Cyrillic letters together, or any non-ASCII character
    unless the host starts with ``xn--``."""
    c = _col(d)
    cyrillic = f"[\\x{{{lists.CYRILLIC_FIRST:X}}}-\\x{{{lists.CYRILLIC_LAST:X}}}]"
    mixed = c.rlike("[a-zA-Z]") & c.rlike(cyrillic)
    non_ascii = c.rlike(r"[^\x00-\x7F]") & ~c.startswith(lists.PUNYCODE_PREFIX)
    return F.coalesce(mixed | non_ascii, F.lit(False))


# ---------------------------------------------------------------- validation


def valid_server(raw: ColumnOrName) -> Column:
    """V1: server-side input check (true/false, never null)."""
    r = _col(raw)
    s = F.lower(py_strip(r))
    has_space = s.rlike(py_space_class())
    d = F.regexp_replace(s, lists.HTTP_PREFIX_RE, "")
    d = F.substring_index(F.substring_index(d, "/", 1), ":", 1)
    tld = F.substring_index(d, ".", -1)
    before = F.regexp_replace(d, r"\.[^.]*$", "")
    shaped = (
        d.contains(".")
        & (F.length(tld) >= lists.MIN_TLD_LENGTH)
        & tld.rlike(r"^[\p{L}\p{N}]+\z")
        & (F.length(F.replace(before, F.lit("."), F.lit(""))) > 0)
    )
    ok = (
        F.when(r.isNull() | (F.length(r) == 0), False)
        .when(has_space, False)
        .when(F.length(d) == 0, False)
        .when(is_ip(d), True)
        .otherwise(shaped)
    )
    return F.coalesce(ok, F.lit(False))


def valid_client(raw: ColumnOrName) -> Column:
    """V2: browser-side input check (true/false, never null)."""
    r = _col(raw)
    ws = js_space_class()
    s = js_trim(r)
    d = F.regexp_replace(s, "(?i)" + lists.HTTP_PREFIX_RE, "")
    d = F.substring_index(F.substring_index(d, "/", 1), ":", 1)
    octet = lists.CLIENT_IPV4_OCTET_RE
    v4 = rf"^({octet}\.){{3}}{octet}\z"
    tld = F.substring_index(d, ".", -1)
    # JavaScript string length counts UTF-16 units.
    tld_len = F.length(tld) + F.regexp_count(tld, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    last_dot = F.length(d) - F.length(tld)  # 1-based position of the last '.'
    shaped = (
        d.contains(".")
        & (last_dot > 1)
        & (last_dot < F.length(d))
        & (tld_len >= lists.MIN_TLD_LENGTH)
        & tld.rlike(r"^\p{L}+\z")
    )
    ok = (
        F.when(r.isNull() | (F.length(r) == 0), False)
        .when(s.rlike(ws), False)
        .when(F.length(d) == 0, False)
        .when(d.rlike(v4), True)
        .otherwise(shaped)
    )
    return F.coalesce(ok, F.lit(False))


def reject_reason(raw: ColumnOrName) -> Column:
    """Why a submitted line is rejected (null when accepted)."""
    r = _col(raw)
    return (
        F.when(r.isNull() | (F.length(py_strip(r)) == 0), F.lit("empty"))
        .when(~valid_server(r), F.lit("invalid"))
        .otherwise(F.lit(None).cast("string"))
    )
