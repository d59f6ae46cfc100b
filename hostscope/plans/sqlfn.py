"""DuckDB renderings of the column functions, for the oracle SQL.

Each function takes SQL expression text and returns SQL expression text
meaning the same thing as the Spark Column function of the same name.
"""

from __future__ import annotations

from hostscope.functions import lists
from hostscope.functions.chars import (
    JS_SPACE_POINTS,
    js_space_class,
    nfkc_delimiter_class,
    py_digit_class,
    py_space_class,
    python_space_points,
)
from hostscope.functions.host import IPV6_PATTERN, IPV6_STRICT_PATTERN
from hostscope.sources.suffix_list import suffix_rule_rows


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(x: str, values: list[str]) -> str:
    return f"coalesce(({x}) IN ({', '.join(q(v) for v in values)}), false)"


def _chars(points) -> str:
    return "(" + " || ".join(f"chr({p})" for p in points) + ")"


def py_strip(x: str) -> str:
    return f"trim({x}, {_chars(python_space_points())})"


def _netloc(x: str) -> str:
    u = rf"regexp_replace(regexp_replace({x}, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+', '')"
    net = rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
    return (
        f"CASE WHEN ({x}) IS NULL THEN NULL "
        f"WHEN contains({net}, '[') <> contains({net}, ']') THEN NULL "
        f"WHEN contains({net}, '[') AND contains({net}, ']') AND NOT {_bracketed_ok(net)} THEN NULL "
        f"WHEN regexp_matches({net}, '{nfkc_delimiter_class()}') THEN NULL "
        f"ELSE {net} END"
    )


def _bracketed_ok(net: str) -> str:
    from hostscope.functions.urls import bracketed_netloc_re

    hp = f"string_split({net}, '@')[-1]"
    in_brackets, bare = bracketed_netloc_re()
    return (f"coalesce(regexp_matches({hp}, '{in_brackets}') "
            f"OR (NOT contains({hp}, '[') AND regexp_matches({hp}, '{bare}')), false)")


def netloc_app(x: str) -> str:
    return f"replace(lower({_netloc(x)}), 'www.', '')"


def netloc_notebook(x: str) -> str:
    return rf"regexp_replace(lower({_netloc(x)}), '^www\.', '')"


def clean_host(x: str) -> str:
    d = f"regexp_replace(lower({py_strip(x)}), '^https?://', '')"
    return f"split_part(split_part({d}, '/', 1), ':', 1)"


def count_re(x: str, cls: str) -> str:
    return f"CAST(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')) AS INTEGER)"


def length(x: str) -> str:
    return f"CAST(length({x}) AS INTEGER)"


def subdomain_count(x: str) -> str:
    return f"CAST(greatest(len(string_split({x}, '.')) - 2, 0) AS INTEGER)"


def hyphen_count(x: str) -> str:
    return f"CAST(length({x}) - length(replace({x}, '-', '')) AS INTEGER)"


def digit_count(x: str) -> str:
    return count_re(x, py_digit_class())


def special_char_count(x: str) -> str:
    return count_re(x, r"[^\p{L}\p{N}.]")


def entropy(x: str) -> str:
    p = f"((length({x}) - length(replace({x}, c, '')))::DOUBLE / length({x}))"
    return (
        f"CASE WHEN ({x}) IS NULL THEN NULL WHEN length({x}) = 0 THEN 0.0 ELSE "
        f"list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -({p} * log2({p})))) END"
    )


def has_keyword(x: str, w: str) -> str:
    return f"CAST(contains({x}, {q(w)}) AS INTEGER)"


def has_punycode(x: str) -> str:
    return f"CAST(contains({x}, 'xn--') AS INTEGER)"


def unicode_count(x: str) -> str:
    return count_re(x, r"[^\x00-\x7F]")


def contains_unicode(x: str) -> str:
    return f"CAST({unicode_count(x)} > 0 AS INTEGER)"


def unicode_ratio(x: str) -> str:
    return f"({unicode_count(x)}::DOUBLE / greatest(length({x}), 1)::DOUBLE)"


_IPV4_SHAPE = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def is_ipv4(x: str) -> str:
    octs = " AND ".join(f"TRY_CAST(split_part({x}, '.', {i}) AS INTEGER) <= 255" for i in range(1, 5))
    return f"coalesce(regexp_matches({x}, '{_IPV4_SHAPE}') AND {octs}, false)"


def is_ip(x: str) -> str:
    return f"({is_ipv4(x)} OR coalesce(regexp_matches({x}, '{IPV6_PATTERN}'), false))"


def is_ip_strict(x: str) -> str:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"^{octet}(?:\.{octet}){{3}}\z"
    return (f"CAST(coalesce(regexp_matches({x}, '{v4}') OR regexp_matches({x}, '{IPV6_STRICT_PATTERN}'), false) "
            "AS INTEGER)")


def has_mixed_script(x: str) -> str:
    return (
        rf"coalesce((regexp_matches({x}, '[a-zA-Z]') AND regexp_matches({x}, '[\x{{400}}-\x{{4FF}}]')) "
        rf"OR (regexp_matches({x}, '[^\x00-\x7F]') AND NOT starts_with({x}, 'xn--')), false)"
    )


def _one_byte(root: str) -> str:
    """The engine measures bytes: characters that no brand holds become one each."""
    return f"regexp_replace(lower({root}), '[^\\x00-\\x7F]', '~', 'g')"


def min_brand_distance(root: str, brands: list[str] | None = None) -> str:
    brands = lists.KNOWN_BRANDS if brands is None else brands
    if not brands:
        return str(lists.EMPTY_BRAND_DISTANCE)
    return "CAST(least(" + ", ".join(f"levenshtein({_one_byte(root)}, {q(b)})" for b in brands) + ") AS INTEGER)"


def nearest_brand(root: str, brands: list[str] | None = None) -> str:
    brands = lists.KNOWN_BRANDS if brands is None else brands
    pairs = ", ".join(
        f"{{'d': levenshtein({_one_byte(root)}, {q(b)}), 'i': {i}}}" for i, b in enumerate(brands)
    )
    arr = "[" + ", ".join(q(b) for b in brands) + "]"
    return f"{arr}[least({pairs}).i + 1]"


def brand_match_exact(root: str, brands: list[str] | None = None) -> str:
    brands = lists.KNOWN_BRANDS if brands is None else brands
    return f"CAST({in_list(root, brands)} AS INTEGER)"


def brand_match_substring(x: str, brands: list[str] | None = None) -> str:
    brands = lists.NOTEBOOK_BRANDS if brands is None else brands
    return f"CAST(coalesce(regexp_matches({x}, {q('|'.join(brands))}), false) AS INTEGER)"


def known_brand_root(root: str, suffix: str, roots: list[str] | None = None) -> str:
    roots = lists.KNOWN_ROOTS if roots is None else roots
    return f"CAST({in_list(f'{root} || {q(chr(46))} || {suffix}', roots)} AS INTEGER)"


def flag(x: str, values: list[str]) -> str:
    return f"CAST({in_list(x, values)} AS INTEGER)"


def valid_server(x: str) -> str:
    s = f"lower({py_strip(x)})"
    d = f"split_part(split_part(regexp_replace({s}, '^https?://', ''), '/', 1), ':', 1)"
    tld = f"string_split({d}, '.')[-1]"
    before = rf"regexp_replace({d}, '\.[^.]*$', '')"
    shaped = (
        f"(contains({d}, '.') AND length({tld}) >= 2 AND regexp_matches({tld}, '^[\\p{{L}}\\p{{N}}]+\\z') "
        f"AND length(replace({before}, '.', '')) > 0)"
    )
    return (
        f"coalesce(CASE WHEN ({x}) IS NULL OR length({x}) = 0 THEN false "
        f"WHEN regexp_matches({s}, '{py_space_class()}') THEN false "
        f"WHEN length({d}) = 0 THEN false WHEN {is_ip(d)} THEN true ELSE {shaped} END, false)"
    )


def valid_client(x: str) -> str:
    ws = js_space_class()
    s = js_trim(x)
    d = f"split_part(split_part(regexp_replace({s}, '(?i)^https?://', ''), '/', 1), ':', 1)"
    octet = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    v4 = rf"^({octet}\.){{3}}{octet}\z"
    tld = f"string_split({d}, '.')[-1]"
    tld_len = rf"(length({tld}) + length({tld}) - length(regexp_replace({tld}, '[\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
    last_dot = f"(length({d}) - length({tld}))"
    shaped = (
        f"(contains({d}, '.') AND {last_dot} > 1 AND {last_dot} < length({d}) AND {tld_len} >= 2 "
        f"AND regexp_matches({tld}, '^\\p{{L}}+\\z'))"
    )
    return (
        f"coalesce(CASE WHEN ({x}) IS NULL OR length({x}) = 0 THEN false "
        f"WHEN regexp_matches({s}, '{ws}') THEN false "
        f"WHEN length({d}) = 0 THEN false WHEN regexp_matches({d}, '{v4}') THEN true ELSE {shaped} END, false)"
    )


def js_trim(x: str) -> str:
    return f"trim({x}, {_chars(JS_SPACE_POINTS)})"


# ------------------------------------------------------------ suffix split


RULES = "{{suffix rules}}"  # stands for the rule rows until ``fill_rules``


def rules_cte() -> tuple[str, str]:
    return "psl_rules", f"SELECT * FROM (VALUES {RULES}) AS t(key, is_exact, is_wild_parent, is_exception)"


def fill_rules(sql: dict[str, str]) -> dict[str, str]:
    """The oracle texts with the suffix rules written out."""
    rows = suffix_rule_rows()
    vals = ",".join(
        f"({q(k)},{str(e).lower()},{str(w).lower()},{str(x).lower()})" for k, e, w, x in rows
    )
    return {name: text.replace(RULES, vals) for name, text in sql.items()}


def lenient_host(x: str) -> str:
    h = x
    for sep in ("/", "?", "#"):
        h = f"split_part({h}, '{sep}', 1)"
    h = f"string_split({h}, '@')[-1]"
    h = f"split_part({h}, ':', 1)"
    h = py_strip(h)
    h = f"regexp_replace({h}, '[.。．｡]+$', '')"
    return f"translate({h}, '。．｡', '...')"


def split_ctes(src: str, host: str, out: str, k_max: int = 4,
               names: tuple[str, str, str] = ("subdomain", "root", "suffix")) -> list[tuple[str, str]]:
    """CTEs adding subdomain/root/suffix for ``host`` of relation ``src``;
    the final relation is ``out`` (needs the ``psl_rules`` CTE)."""
    sub, root, suffix = names
    a = f"{out}_a"
    b = f"{out}_b"
    c = f"{out}_c"
    s_cols = ", ".join(
        f"CASE WHEN __n >= {k} THEN array_to_string(list_slice(__ll, __n - {k - 1}, __n), '.') END AS __s{k}"
        for k in range(1, k_max + 1)
    )
    joins = " ".join(
        f"LEFT JOIN psl_rules r{k} ON r{k}.key = t.__s{k}" for k in range(1, k_max + 1)
    )
    cands = ["0"]
    for k in range(1, k_max + 1):
        cands.append(f"CASE WHEN coalesce(r{k}.is_exact, false) THEN {k} END")
        cands.append(f"CASE WHEN coalesce(r{k}.is_exception, false) THEN {k - 1} END")
        if k >= 2:
            cands.append(
                f"CASE WHEN coalesce(r{k - 1}.is_wild_parent, false) AND NOT coalesce(r{k}.is_exception, false) "
                f"AND t.__n >= {k} THEN {k} END"
            )
    ip = f"(__sl = 0 AND __n = 4 AND regexp_matches(__h, '^[0-9]') AND {is_ipv4('__h')})"
    helper = ["__h", "__l", "__ll", "__n", "__sl"] + [f"__s{k}" for k in range(1, k_max + 1)]
    return [
        (a, f"SELECT *, {lenient_host(host)} AS __h FROM {src}"),
        (b, f"SELECT *, string_split(__h, '.') AS __l, string_split(lower(__h), '.') AS __ll, "
            f"len(string_split(__h, '.')) AS __n FROM {a}"),
        (c, f"SELECT t.*, greatest({', '.join(cands)}) AS __sl FROM (SELECT *, {s_cols} FROM {b}) t {joins}"),
        (out,
         f"SELECT * EXCLUDE ({', '.join(helper)}), "
         f"CASE WHEN __h IS NULL THEN NULL WHEN {ip} THEN '' WHEN __n - __sl - 1 > 0 THEN "
         f"array_to_string(list_slice(__l, 1, __n - __sl - 1), '.') ELSE '' END AS {sub}, "
         f"CASE WHEN __h IS NULL THEN NULL WHEN {ip} THEN __h WHEN __n > __sl THEN __l[__n - __sl] ELSE '' END AS {root}, "
         f"CASE WHEN __h IS NULL THEN NULL WHEN {ip} THEN '' WHEN __sl > 0 THEN "
         f"array_to_string(list_slice(__l, __n - __sl + 1, __n), '.') ELSE '' END AS {suffix} "
         f"FROM {c}"),
    ]
