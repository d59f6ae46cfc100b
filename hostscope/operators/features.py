"""Feature bundles over a host column.

``with_host_features`` is the model input: one projection over the input
rows plus the broadcast suffix-rule joins -- no shuffle.  All of it is built-in
expressions but the brand distance, which numpy computes for a batch of hosts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostscope.functions import host as H
from hostscope.functions import lists
from hostscope.functions.urls import ColumnOrName, _col, clean_host
from hostscope.operators.suffix import split_registered

# Feature columns in the order the extractor emits them (23 numbers + tld).
FEATURE_COLUMNS = [
    "length", "subdomain_count", "hyphen_count", "digit_count",
    "special_char_count", "entropy",
    *[f"has_{w}" for w in lists.FEATURE_KEYWORDS],
    "brand_match", "known_brand_root", "min_brand_distance",
    "has_punycode", "contains_unicode", "unicode_ratio",
    "tld", "is_country_code_tld", "is_common_tld", "is_suspicious_tld",
]
NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c != "tld"]
INDICATOR_COLUMNS = ["is_ip", "has_mixed_script", "tld_is_risky"]


def brand_distances(root: ColumnOrName, brands: list[str] | None = None) -> list[Column]:
    brands = lists.KNOWN_BRANDS if brands is None else brands
    r = F.lower(_col(root))
    return [F.levenshtein(r, F.lit(b)) for b in brands]


def _least_distance(brands: list[str]):
    """A UDF: the smallest edit distance of a text to any of ``brands`` (1 to 64 code points
    each).  Myers' bit-parallel columns: a bit per code point of a brand, a batch's texts
    and all brands side by side, so one step takes one code point of every text."""
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if max(map(len, brands)) <= 8 * np.dtype(k).itemsize)
    alphabet = sorted(set("".join(brands)))
    points = np.array([*map(ord, alphabet)], np.uint32)
    equal = np.zeros((len(alphabet) + 1, len(brands)), kind)  # the last row: in no brand
    for j, brand in enumerate(brands):
        for i, char in enumerate(brand):
            equal[alphabet.index(char), j] |= kind(1 << i)
    sizes = np.array([*map(len, brands)], np.int32)
    top, one = (sizes - 1).astype(kind), kind(1)

    def least(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of texts in falling order of length."""
        score = np.tile(sizes, (len(starts), 1))
        up, down = np.full(score.shape, ~kind(0)), np.zeros(score.shape, kind)
        live = len(starts)
        for i in range(int(lengths[0])):
            while lengths[live - 1] <= i:
                live -= 1
            eq, pv, mv, by = equal[codes[starts[:live] + i]], up[:live], down[:live], score[:live]
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            by += ((ph >> top) & one).astype(np.int32)
            by -= ((mh >> top) & one).astype(np.int32)
            ph, mh = (ph << one) | one, mh << one
            xv = eq | mv
            up[:live], down[:live] = mh | ~(xv | ph), ph & xv
        return score.min(axis=1)

    @F.arrow_udf("int")
    def distance(text: pa.Array) -> pa.Array:
        texts = [t or "" for t in text.to_pylist()]
        joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(np.searchsorted(points, joined), len(points) - 1)
        codes[points[codes] != joined] = len(points)
        lengths = np.array([*map(len, texts)], np.int64)
        starts = np.cumsum(lengths) - lengths
        out, order = np.zeros(len(texts), np.int32), np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), 1_024):  # so that a step's numbers stay in the processor's cache
            at = order[a : a + 1_024]
            out[at] = least(codes, starts[at], lengths[at])
        return pa.array(out, mask=text.is_null().to_numpy(zero_copy_only=False))

    return distance


def min_brand_distance(root: ColumnOrName, brands: list[str] | None = None) -> Column:
    """Smallest edit distance from ``root`` to any brand (99 if none)."""
    brands = lists.KNOWN_BRANDS if brands is None else brands
    if not brands:
        return F.lit(lists.EMPTY_BRAND_DISTANCE)
    short = [b for b in brands if 1 <= len(b) <= 64]
    dists = brand_distances(root, [b for b in brands if b not in short])
    if short:
        dists.append(_least_distance(short)(F.lower(_col(root))))
    return (dists[0] if len(dists) == 1 else F.least(*dists)).cast("int")


def nearest_brand(root: ColumnOrName, brands: list[str] | None = None) -> Column:
    """J5 variant: struct of ``distance`` and ``brand``, the first brand (list order)
    at the smallest distance, from one measurement of each brand."""
    brands = lists.KNOWN_BRANDS if brands is None else brands
    if not brands:
        return F.struct(F.lit(lists.EMPTY_BRAND_DISTANCE).alias("distance"), F.lit(None).cast("string").alias("brand"))
    ranked = [d * F.lit(len(brands)) + F.lit(i) for i, d in enumerate(brand_distances(root, brands))]
    best = F.least(*ranked) if len(ranked) > 1 else ranked[0]
    names = F.array(*[F.lit(b) for b in brands])
    parts = F.transform(F.array(best), lambda x: F.struct(
        F.floor(x / len(brands)).cast("int").alias("distance"),
        F.element_at(names, (x % len(brands) + 1).cast("int")).alias("brand")))
    return F.element_at(parts, 1)


def brand_match_exact(root: ColumnOrName, brands: list[str] | None = None) -> Column:
    """H8: the registered-domain label equals a brand."""
    brands = lists.KNOWN_BRANDS if brands is None else brands
    return F.coalesce(_col(root).isin(brands), F.lit(False)).cast("int")


def brand_match_substring(d: ColumnOrName, brands: list[str] | None = None) -> Column:
    """H9 (notebook): some brand occurs anywhere in the host."""
    brands = lists.NOTEBOOK_BRANDS if brands is None else brands
    if not brands:
        return F.lit(0)
    alternation = "|".join(f"\\Q{b}\\E" for b in brands)
    return F.coalesce(_col(d).rlike(alternation), F.lit(False)).cast("int")


def known_brand_root(root: ColumnOrName, suffix: ColumnOrName, roots: list[str] | None = None) -> Column:
    """``root.suffix`` is an official domain."""
    roots = lists.KNOWN_ROOTS if roots is None else roots
    return F.coalesce(F.concat(_col(root), F.lit("."), _col(suffix)).isin(roots), F.lit(False)).cast(
        "int"
    )


def in_set(c: ColumnOrName, values: list[str]) -> Column:
    """Whole-value membership -> 0/1."""
    return F.coalesce(_col(c).isin(values), F.lit(False)).cast("int")


def _feature_exprs(d: Column, root: Column, suffix: Column) -> list[Column]:
    return [
        H.length(d).alias("length"),
        H.subdomain_count(d).alias("subdomain_count"),
        H.hyphen_count(d).alias("hyphen_count"),
        H.digit_count(d).alias("digit_count"),
        H.special_char_count(d).alias("special_char_count"),
        H.entropy(d).alias("entropy"),
        *H.keyword_flags(d),
        brand_match_exact(root).alias("brand_match"),
        known_brand_root(root, suffix).alias("known_brand_root"),
        min_brand_distance(root).alias("min_brand_distance"),
        H.has_punycode(d).alias("has_punycode"),
        H.contains_unicode(d).alias("contains_unicode"),
        H.unicode_ratio(d).alias("unicode_ratio"),
        suffix.alias("tld"),
        in_set(suffix, lists.COUNTRY_CODE_TLDS).alias("is_country_code_tld"),
        in_set(suffix, lists.COMMON_TLDS).alias("is_common_tld"),
        in_set(suffix, lists.HIGH_RISK_TLDS).alias("is_suspicious_tld"),
    ]


def with_host_parts(
    df: DataFrame, domain: ColumnOrName = "domain", rules: DataFrame | None = None,
    host: str = "host", root: str = "root", suffix: str = "suffix", subdomain: str = "subdomain",
) -> DataFrame:
    """U3 + U4: add the cleaned host and its subdomain / root / suffix."""
    out = df.withColumn(host, clean_host(domain))
    return split_registered(out, host, rules, subdomain=subdomain, root=root, suffix=suffix)


def with_host_features(
    df: DataFrame,
    domain: ColumnOrName = "domain",
    rules: DataFrame | None = None,
    keep_parts: bool = False,
) -> DataFrame:
    """Append the 23 numeric features and ``tld`` for ``domain``."""
    base = list(df.columns)
    parts = with_host_parts(df, domain, rules, "__host", "__root", "__suffix", "__sub")
    d, root, suffix = F.col("__host"), F.col("__root"), F.col("__suffix")
    extra = [d.alias("host"), root.alias("root"), suffix.alias("suffix")] if keep_parts else []
    return parts.select(*[F.col(c) for c in base], *extra, *_feature_exprs(d, root, suffix))


def with_host_features_distinct(df: DataFrame, domain: str = "domain",
                                rules: DataFrame | None = None) -> DataFrame:
    """H22 computed once per distinct ``domain`` and joined back (for
    tables whose hosts repeat heavily).  The per-domain counts are
    checkpointed; domains above 0.1 % of the rows join through a bounded
    broadcast, the rest through a shuffle join.  Rows whose domain is null
    get null features."""
    from hostscope.operators.joins import hot_keys, key_counts, split_join
    from hostscope.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    counts = key_counts(df.where(F.col(domain).isNotNull()), [domain]).checkpoint(eager=True)
    feats = with_host_features(counts.select(domain), domain, rules)
    return split_join(df, feats, [domain], hot_keys(counts, [domain]))


def with_indicators(df: DataFrame, domain: ColumnOrName = "domain", rules: DataFrame | None = None) -> DataFrame:
    """``is_ip``, ``has_mixed_script``, ``tld_is_risky`` (booleans)."""
    base = list(df.columns)
    parts = with_host_parts(df, domain, rules, "__host", "__root", "__suffix", "__sub")
    d, suffix = F.col("__host"), F.col("__suffix")
    return parts.select(
        *[F.col(c) for c in base],
        H.is_ip(d).alias("is_ip"),
        H.has_mixed_script(d).alias("has_mixed_script"),
        F.coalesce(suffix.isin(lists.HIGH_RISK_TLDS), F.lit(False)).alias("tld_is_risky"),
    )


def with_notebook_features(
    df: DataFrame,
    domain: ColumnOrName = "domain",
    rules: DataFrame | None = None,
    brands: list[str] | None = None,
    roots: list[str] | None = None,
    keep_suffix: str | None = None,
) -> DataFrame:
    """Notebook feature set (H9, H17, H20, H21) on the domain as given."""
    brands = lists.NOTEBOOK_BRANDS if brands is None else brands
    roots = lists.NOTEBOOK_ROOTS if roots is None else roots
    base = list(df.columns)
    out = df.withColumn("__host", _col(domain))
    out = split_registered(out, "__host", rules, subdomain="__sub", root="__root", suffix="__suffix")
    d, root, suffix = F.col("__host"), F.col("__root"), F.col("__suffix")
    depth = H.subdomain_count(d)
    return out.select(
        *[F.col(c) for c in base],
        H.length(d).alias("length"),
        depth.alias("subdomain_count"),
        depth.alias("domain_depth"),
        H.hyphen_count(d).alias("hyphen_count"),
        H.digit_count(d).alias("digit_count"),
        H.special_char_count(d).alias("special_char_count"),
        H.entropy(d).alias("entropy"),
        H.is_ip_strict(d).alias("is_ip_address"),
        *H.keyword_flags(d),
        brand_match_substring(d, brands).alias("brand_match"),
        known_brand_root(root, suffix, roots).alias("known_brand_root"),
        min_brand_distance(root, brands).alias("min_brand_distance"),
        H.has_punycode(d).alias("has_punycode"),
        H.contains_unicode(d).alias("contains_unicode"),
        H.unicode_ratio(d).alias("unicode_ratio"),
        in_set(suffix, lists.NOTEBOOK_COMMON_TLDS).alias("is_common_tld"),
        in_set(suffix, lists.NOTEBOOK_SUSPICIOUS_TLDS).alias("is_suspicious_tld"),
        *([suffix.alias(keep_suffix)] if keep_suffix else []),
    )


def with_notebook_features_2(df: DataFrame, domain: ColumnOrName = "domain", rules: DataFrame | None = None) -> DataFrame:
    """The notebook's second feature set (H9, H15, H20, H21): 17 brands, the app's TLD
    lists with country codes, no address flag."""
    base = list(df.columns)
    out = with_notebook_features(df.withColumn("__given", _col(domain)), "__given", rules, lists.NOTEBOOK_BRANDS_2,
                                 keep_suffix="__tld")
    suffix = F.col("__tld")
    names = [c for c in out.columns if c not in (*base, "__given", "__tld", "is_ip_address", "is_common_tld", "is_suspicious_tld")]
    return out.select(
        *[F.col(c) for c in base], *names,
        in_set(suffix, lists.COUNTRY_CODE_TLDS).alias("is_country_code_tld"),
        in_set(suffix, lists.COMMON_TLDS).alias("is_common_tld"),
        in_set(suffix, lists.HIGH_RISK_TLDS).alias("is_suspicious_tld"),
    )
