"""Registered queries: each a Spark plan over the driver tables plus, where
SQL can say it, the DuckDB oracle text with the same column names.

Doubles that come out of a sum whose order differs between engines
(entropy, AUC, averaged metrics) are reported rounded to 9 decimals on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostscope.functions import host as H
from hostscope.functions import lists
from hostscope.functions.urls import clean_host, netloc_app, netloc_notebook
from hostscope.operators import dataset as D
from hostscope.operators import features as FT
from hostscope.operators import metrics as M
from hostscope.operators import scanlog as S
from hostscope.plans import derived as DV
from hostscope.plans import sqlfn as Q
from hostscope.sources.feeds import batch_lines

R9 = 9
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _r(c):
    return F.round(c, R9)


def _rs(x: str) -> str:
    return f"round(({x})::DOUBLE, {R9})"


# ------------------------------------------------------------ shared pieces

# Timestamps in reports: fixed text with microseconds on both engines.
_TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")



def _hosts(spark, sf):
    """Every URL with its cleaned host and registered-domain parts."""
    return FT.with_host_parts(DV.spark_urls(spark, sf), "url")


def _cleaned(spark, sf):
    """Every URL with its cleaned host; the suffix is not needed."""
    return DV.spark_urls(spark, sf).withColumn("host", clean_host("url"))


def _host_sql() -> list[tuple[str, str]]:
    rules = Q.rules_cte()
    return [
        rules,
        ("hosts_a", f"SELECT src, uid, url, {Q.clean_host('url')} AS host FROM urls"),
        *Q.split_ctes("hosts_a", "host", "hp"),
    ]


def _with(names: list[str], extra: list[tuple[str, str]] | None = None) -> str:
    return DV.with_ctes(names, extra)


HP = _with(["urls"], _host_sql())


# ------------------------------------------------------------ U1-U4


@register("url_netloc_app", _with(["urls"]) + f"SELECT src, uid, {Q.netloc_app('url')} AS netloc FROM urls")
def url_netloc_app(spark, sf):
    return DV.spark_urls(spark, sf).select("src", "uid", netloc_app("url").alias("netloc"))


@register("url_netloc_notebook",
          _with(["urls"]) + f"SELECT src, uid, {Q.netloc_notebook('url')} AS netloc FROM urls")
def url_netloc_notebook(spark, sf):
    return DV.spark_urls(spark, sf).select("src", "uid", netloc_notebook("url").alias("netloc"))


@register("host_clean", _with(["urls"]) + f"SELECT src, uid, {Q.clean_host('url')} AS host FROM urls")
def host_clean(spark, sf):
    return DV.spark_urls(spark, sf).select("src", "uid", clean_host("url").alias("host"))


@register("registered_domain", HP + "SELECT src, uid, host, subdomain, root, suffix FROM hp")
def registered_domain(spark, sf):
    return _hosts(spark, sf).select("src", "uid", "host", "subdomain", "root", "suffix")


# ------------------------------------------------------------ H1-H23


@register(
    "host_structure",
    HP + f"SELECT src, uid, {Q.length('host')} AS length, {Q.subdomain_count('host')} AS subdomain_count, "
    f"{Q.hyphen_count('host')} AS hyphen_count, {Q.digit_count('host')} AS digit_count, "
    f"{Q.special_char_count('host')} AS special_char_count FROM hp",
)
def host_structure(spark, sf):
    h = F.col("host")
    return _cleaned(spark, sf).select(
        "src", "uid", H.length(h).alias("length"), H.subdomain_count(h).alias("subdomain_count"),
        H.hyphen_count(h).alias("hyphen_count"), H.digit_count(h).alias("digit_count"),
        H.special_char_count(h).alias("special_char_count"),
    )


@register("host_entropy", HP + f"SELECT src, uid, host, {_rs(Q.entropy('host'))} AS entropy FROM hp")
def host_entropy(spark, sf):
    return _cleaned(spark, sf).select("src", "uid", "host", _r(H.entropy("host")).alias("entropy"))


@register(
    "host_keywords",
    HP + "SELECT src, uid, "
    + ", ".join(f"{Q.has_keyword('host', w)} AS has_{w}" for w in lists.FEATURE_KEYWORDS)
    + " FROM hp",
)
def host_keywords(spark, sf):
    return _cleaned(spark, sf).select("src", "uid", *H.keyword_flags("host"))


@register("brand_match_exact",
          HP + f"SELECT src, uid, root, {Q.brand_match_exact('root')} AS brand_match FROM hp")
def brand_match_exact(spark, sf):
    return _hosts(spark, sf).select("src", "uid", "root", FT.brand_match_exact("root").alias("brand_match"))


@register(
    "brand_match_substring",
    _with(["domains"]) + f"SELECT id, domain, {Q.brand_match_substring('domain')} AS brand_match FROM domains",
)
def brand_match_substring(spark, sf):
    return DV.spark_domains(spark, sf).select(
        "id", "domain", FT.brand_match_substring("domain").alias("brand_match")
    )


@register("brand_distance",
          HP + f"SELECT src, uid, root, {Q.min_brand_distance('root')} AS min_brand_distance FROM hp")
def brand_distance(spark, sf):
    return _hosts(spark, sf).select("src", "uid", "root", FT.min_brand_distance("root").alias("min_brand_distance"))


@register(
    "nearest_brand",
    HP + f"SELECT src, uid, root, {Q.nearest_brand('root')} AS nearest_brand, "
    f"{Q.min_brand_distance('root')} AS distance FROM hp",
)
def nearest_brand(spark, sf):
    out = _hosts(spark, sf).select("src", "uid", "root", FT.nearest_brand("root").alias("best"))
    return out.select("src", "uid", "root", F.col("best.brand").alias("nearest_brand"), F.col("best.distance").alias("distance"))


@register("trusted_root",
          HP + f"SELECT src, uid, root, suffix, {Q.known_brand_root('root', 'suffix')} AS known_brand_root FROM hp")
def trusted_root(spark, sf):
    return _hosts(spark, sf).select(
        "src", "uid", "root", "suffix", FT.known_brand_root("root", "suffix").alias("known_brand_root")
    )


@register(
    "unicode_flags",
    HP + f"SELECT src, uid, {Q.has_punycode('host')} AS has_punycode, {Q.contains_unicode('host')} AS contains_unicode, "
    f"{Q.unicode_ratio('host')} AS unicode_ratio FROM hp",
)
def unicode_flags(spark, sf):
    h = F.col("host")
    return _cleaned(spark, sf).select(
        "src", "uid", H.has_punycode(h).alias("has_punycode"), H.contains_unicode(h).alias("contains_unicode"),
        H.unicode_ratio(h).alias("unicode_ratio"),
    )


@register(
    "tld_class",
    HP + f"SELECT src, uid, suffix AS tld, {Q.flag('suffix', lists.COUNTRY_CODE_TLDS)} AS is_country_code_tld, "
    f"{Q.flag('suffix', lists.COMMON_TLDS)} AS is_common_tld, "
    f"{Q.flag('suffix', lists.HIGH_RISK_TLDS)} AS is_suspicious_tld FROM hp",
)
def tld_class(spark, sf):
    s = F.col("suffix")
    return _hosts(spark, sf).select(
        "src", "uid", s.alias("tld"),
        FT.in_set(s, lists.COUNTRY_CODE_TLDS).alias("is_country_code_tld"),
        FT.in_set(s, lists.COMMON_TLDS).alias("is_common_tld"),
        FT.in_set(s, lists.HIGH_RISK_TLDS).alias("is_suspicious_tld"),
    )


@register(
    "ip_and_script_flags",
    HP + f"SELECT src, uid, {Q.is_ip('host')} AS is_ip, {Q.has_mixed_script('host')} AS has_mixed_script, "
    f"{Q.in_list('suffix', lists.HIGH_RISK_TLDS)} AS tld_is_risky FROM hp",
)
def ip_and_script_flags(spark, sf):
    return FT.with_indicators(DV.spark_urls(spark, sf), "url").select(
        "src", "uid", "is_ip", "has_mixed_script", "tld_is_risky"
    )


def _feature_sql(h: str = "host", root: str = "root", suffix: str = "suffix") -> str:
    parts = [
        f"{Q.length(h)} AS length", f"{Q.subdomain_count(h)} AS subdomain_count",
        f"{Q.hyphen_count(h)} AS hyphen_count", f"{Q.digit_count(h)} AS digit_count",
        f"{Q.special_char_count(h)} AS special_char_count", f"{_rs(Q.entropy(h))} AS entropy",
        *[f"{Q.has_keyword(h, w)} AS has_{w}" for w in lists.FEATURE_KEYWORDS],
        f"{Q.brand_match_exact(root)} AS brand_match",
        f"{Q.known_brand_root(root, suffix)} AS known_brand_root",
        f"{Q.min_brand_distance(root)} AS min_brand_distance",
        f"{Q.has_punycode(h)} AS has_punycode", f"{Q.contains_unicode(h)} AS contains_unicode",
        f"{Q.unicode_ratio(h)} AS unicode_ratio", f"{suffix} AS tld",
        f"{Q.flag(suffix, lists.COUNTRY_CODE_TLDS)} AS is_country_code_tld",
        f"{Q.flag(suffix, lists.COMMON_TLDS)} AS is_common_tld",
        f"{Q.flag(suffix, lists.HIGH_RISK_TLDS)} AS is_suspicious_tld",
    ]
    return ", ".join(parts)


def _round_entropy(df: DataFrame) -> DataFrame:
    return df.withColumn("entropy", _r(F.col("entropy")))


@register("host_features", HP + f"SELECT src, uid, {_feature_sql()} FROM hp")
def host_features(spark, sf):
    out = FT.with_host_features(DV.spark_urls(spark, sf), "url")
    return _round_entropy(out.drop("url"))


_NB_CTES = [Q.rules_cte(), *Q.split_ctes("domains", "domain", "nb", names=("nb_sub", "nb_root", "nb_suffix"))]
_NB_SELECT = (
    "SELECT id, "
    + ", ".join([
        f"{Q.length('domain')} AS length", f"{Q.subdomain_count('domain')} AS subdomain_count",
        f"{Q.subdomain_count('domain')} AS domain_depth", f"{Q.hyphen_count('domain')} AS hyphen_count",
        f"{Q.digit_count('domain')} AS digit_count", f"{Q.special_char_count('domain')} AS special_char_count",
        f"{_rs(Q.entropy('domain'))} AS entropy", f"{Q.is_ip_strict('domain')} AS is_ip_address",
        *[f"{Q.has_keyword('domain', w)} AS has_{w}" for w in lists.FEATURE_KEYWORDS],
        f"{Q.brand_match_substring('domain')} AS brand_match",
        f"{Q.known_brand_root('nb_root', 'nb_suffix', lists.NOTEBOOK_ROOTS)} AS known_brand_root",
        f"{Q.min_brand_distance('nb_root', lists.NOTEBOOK_BRANDS)} AS min_brand_distance",
        f"{Q.has_punycode('domain')} AS has_punycode", f"{Q.contains_unicode('domain')} AS contains_unicode",
        f"{Q.unicode_ratio('domain')} AS unicode_ratio",
        f"{Q.flag('nb_suffix', lists.NOTEBOOK_COMMON_TLDS)} AS is_common_tld",
        f"{Q.flag('nb_suffix', lists.NOTEBOOK_SUSPICIOUS_TLDS)} AS is_suspicious_tld",
    ])
    + " FROM nb"
)
_NB_SQL = _with(["domains"], _NB_CTES) + _NB_SELECT


_NB2_SQL = _with(["domains"], _NB_CTES) + (
    "SELECT id, "
    + ", ".join([
        f"{Q.length('domain')} AS length", f"{Q.subdomain_count('domain')} AS subdomain_count",
        f"{Q.subdomain_count('domain')} AS domain_depth", f"{Q.hyphen_count('domain')} AS hyphen_count",
        f"{Q.digit_count('domain')} AS digit_count", f"{Q.special_char_count('domain')} AS special_char_count",
        f"{_rs(Q.entropy('domain'))} AS entropy",
        *[f"{Q.has_keyword('domain', w)} AS has_{w}" for w in lists.FEATURE_KEYWORDS],
        f"{Q.brand_match_substring('domain', lists.NOTEBOOK_BRANDS_2)} AS brand_match",
        f"{Q.known_brand_root('nb_root', 'nb_suffix', lists.NOTEBOOK_ROOTS)} AS known_brand_root",
        f"{Q.min_brand_distance('nb_root', lists.NOTEBOOK_BRANDS_2)} AS min_brand_distance",
        f"{Q.has_punycode('domain')} AS has_punycode", f"{Q.contains_unicode('domain')} AS contains_unicode",
        f"{Q.unicode_ratio('domain')} AS unicode_ratio",
        f"{Q.flag('nb_suffix', lists.COUNTRY_CODE_TLDS)} AS is_country_code_tld",
        f"{Q.flag('nb_suffix', lists.COMMON_TLDS)} AS is_common_tld",
        f"{Q.flag('nb_suffix', lists.HIGH_RISK_TLDS)} AS is_suspicious_tld",
    ])
    + " FROM nb"
)


@register("notebook_features_v2", _NB2_SQL)
def notebook_features_v2(spark, sf):
    """The notebook's second feature set, which its final model is trained on."""
    out = FT.with_notebook_features_2(DV.spark_domains(spark, sf), "domain")
    return _round_entropy(out.drop("domain"))


@register("notebook_features", _NB_SQL)
def notebook_features(spark, sf):
    out = FT.with_notebook_features(DV.spark_domains(spark, sf), "domain")
    return _round_entropy(out.drop("domain"))


# ------------------------------------------------------------ V1, V2, P11, S16


@register("valid_server", _with(["urls"]) + f"SELECT src, uid, {Q.valid_server('url')} AS valid FROM urls")
def valid_server(spark, sf):
    return DV.spark_urls(spark, sf).select("src", "uid", H.valid_server("url").alias("valid"))


@register("valid_client", _with(["urls"]) + f"SELECT src, uid, {Q.valid_client('url')} AS valid FROM urls")
def valid_client(spark, sf):
    return DV.spark_urls(spark, sf).select("src", "uid", H.valid_client("url").alias("valid"))


@register(
    "rejects",
    _with(["urls"])
    + f"SELECT src, uid, url, CASE WHEN url IS NULL OR length({Q.py_strip('url')}) = 0 THEN 'empty' ELSE 'invalid' END "
    f"AS reason FROM urls WHERE NOT {Q.valid_server('url')}",
)
def rejects(spark, sf):
    r = H.reject_reason("url")
    return DV.spark_urls(spark, sf).select("src", "uid", "url", r.alias("reason")).where(F.col("reason").isNotNull())


@register(
    "batch_lines",
    "SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, "
    f"{Q.js_trim('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE length(line) > 0",
)
def batch_lines_q(spark, sf):
    return batch_lines(DV.table(spark, sf, "documents"), "doc_id", "text")


# ------------------------------------------------------------ D1, D2, A1-A7


def _feeds(spark, sf):
    ranked = DV.spark_ranked_head(spark, sf, lists.RANKED_HEAD_APP).select(
        "domain", F.lit(lists.LEGITIMATE).alias("label"), F.lit(3).alias("source_prio"),
        F.col("rank").cast("long").alias("pos"),
    )
    rows = D.union_all([DV.spark_feed_text(spark, sf), DV.spark_feed_csv(spark, sf), ranked])
    # Strip the domain (app rule: strip only); P5 happens in the dedupe
    from hostscope.functions.urls import py_strip

    return rows.withColumn("domain", py_strip("domain"))


_FEEDS_SQL = [
    ("feeds",
     f"SELECT {Q.py_strip('domain')} AS domain, label, source_prio, pos FROM ("
     f"SELECT {Q.netloc_app('url')} AS domain, 'phishing' AS label, 1 AS source_prio, pos::BIGINT AS pos FROM feed_text_raw "
     f"UNION ALL SELECT {Q.netloc_app('url')} AS domain, 'phishing', 2, pos::BIGINT FROM feed_csv_raw "
     f"UNION ALL SELECT domain, 'legitimate', 3, rank::BIGINT FROM {DV.sql_ranked_head(lists.RANKED_HEAD_APP)}) "
     "WHERE domain IS NOT NULL"),
    ("combined",
     "SELECT domain, label, source_prio, pos FROM (SELECT *, row_number() OVER "
     "(PARTITION BY domain ORDER BY source_prio, pos) AS rn FROM feeds) WHERE rn = 1"),
]


@register("dedupe_first", _with(["feed_text_raw", "feed_csv_raw", "ranked"], _FEEDS_SQL) + "SELECT * FROM combined")
def dedupe_first(spark, sf):
    return D.keep_first(_feeds(spark, sf), "domain", ("source_prio", "pos"), drop_null_key=True).select(
        "domain", "label", F.col("source_prio").cast("int"), "pos"
    )


@register(
    "dedupe_last",
    _with(["corrections"])
    + f"SELECT domain, label, {_TS_SQL} AS ts, id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) rn "
    "FROM corrections) WHERE rn = 1",
)
def dedupe_last(spark, sf):
    out = D.keep_last(DV.spark_corrections(spark, sf), "domain", ("ts", "id"))
    return out.select("domain", "label", _ts_text(F.col("ts")).alias("ts"), "id")


def _curated(spark):
    rows = [(d, lists.LEGITIMATE) for d in lists.CURATED_LEGITIMATE] + [
        (d, lists.PHISHING) for d in lists.CURATED_PHISHING
    ]
    return spark.createDataFrame(rows, "domain string, label string")


def _curated_sql() -> str:
    rows = [(d, lists.LEGITIMATE) for d in lists.CURATED_LEGITIMATE] + [
        (d, lists.PHISHING) for d in lists.CURATED_PHISHING
    ]
    return "SELECT * FROM (VALUES " + ", ".join(f"({Q.q(d)}, {Q.q(lbl)})" for d, lbl in rows) + ") t(domain, label)"


_DATASET_SQL = _FEEDS_SQL + [
    ("curated", _curated_sql()),
    ("corr_last",
     "SELECT domain, label FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) rn "
     "FROM corrections) WHERE rn = 1"),
    ("dataset",
     "SELECT domain, label, CAST(0 AS INTEGER) AS copy FROM combined "
     f"UNION ALL SELECT domain, label, CAST(unnest(range(1, {lists.CURATED_COPIES + 1})) AS INTEGER) FROM curated "
     f"UNION ALL SELECT domain, label, CAST(unnest(range(1, {lists.CURATED_COPIES + 1})) AS INTEGER) FROM corr_last"),
]


def _dataset(spark, sf):
    base = dedupe_first(spark, sf).select("domain", "label", F.lit(0).cast("int").alias("copy"))
    curated = D.replicate(_curated(spark)).withColumn("copy", F.col("copy").cast("int"))
    with_curated = D.union_all([base, curated])
    corr = DV.spark_corrections(spark, sf)
    out = D.inject_corrections(with_curated, corr)
    return out.withColumn("copy", F.col("copy").cast("int"))


@register(
    "union_replicate",
    _with(["feed_text_raw", "feed_csv_raw", "ranked", "corrections"], _DATASET_SQL) + "SELECT * FROM dataset",
)
def union_replicate(spark, sf):
    return _dataset(spark, sf).select("domain", "label", "copy")


_BAL_KEY_SQL = "md5(CAST(id AS VARCHAR) || ':42')"


@register(
    "balance_downsample",
    _with(["labelled"], [
        ("cnt", "SELECT label, count(*) AS n FROM labelled GROUP BY label"),
        ("small", "SELECT min(n) AS m FROM cnt"),
        ("rk", f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_BAL_KEY_SQL}) AS rn FROM labelled"),
    ])
    + "SELECT id, domain, label FROM rk WHERE rn <= (SELECT m FROM small)",
)
def balance_downsample(spark, sf):
    lab = DV.spark_labelled(spark, sf)
    return D.balance_downsample(lab, F.col("id")).select("id", "domain", "label")


def _drawn_sql(n: str, total: str, draw: str) -> str:
    """Rows drawn from a class of ``n`` when ``draw`` of ``total`` are drawn: the whole
    part of its share, and one more for the largest remainders."""
    share = f"(({draw}) * {n})"
    return (f"{share} // {total} + CASE WHEN row_number() OVER (ORDER BY {share} % {total} DESC, label) "
            f"<= ({draw}) - sum({share} // {total}) OVER () THEN 1 ELSE 0 END")


@register(
    "stratified_split",
    _with(["labelled"], [
        ("cnt", "SELECT label, count(*) AS m, sum(count(*)) OVER () AS total FROM labelled GROUP BY label"),
        ("held", f"SELECT label, m, {_drawn_sql('m', 'total', 'ceil(0.3::DOUBLE * total)::BIGINT')} AS t FROM cnt"),
        ("held_total", "SELECT label, m, t, sum(t) OVER () AS total FROM held"),
        ("tested", f"SELECT label, m, t, {_drawn_sql('t', 'total', 'ceil(0.5::DOUBLE * total)::BIGINT')} AS e FROM held_total"),
        ("cuts", "SELECT label, m - t AS c1, m - e AS c2 FROM tested"),
        ("rk", f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_BAL_KEY_SQL}) AS rn FROM labelled"),
    ])
    + "SELECT id, rk.label, CASE WHEN rn <= c1 THEN 'train' WHEN rn <= c2 THEN 'valid' ELSE 'test' END AS split "
    "FROM rk JOIN cuts ON rk.label = cuts.label",
)
def stratified_split(spark, sf):
    lab = DV.spark_labelled(spark, sf)
    return D.stratified_split(lab, F.col("id")).select("id", "label", "split")


_DOM_HP = [Q.rules_cte(), ("dom_a", f"SELECT id, domain, {Q.clean_host('domain')} AS host FROM domains"),
           *Q.split_ctes("dom_a", "host", "dhp")]


@register(
    "sample_weights",
    _with(["domains"], _DOM_HP)
    + "SELECT id, brand_match, is_suspicious_tld, 1.0 + CASE WHEN brand_match = 1 THEN 99.0 ELSE 0.0 END "
    "+ CASE WHEN is_suspicious_tld = 1 THEN 99.0 ELSE 0.0 END AS weight FROM ("
    f"SELECT id, {Q.brand_match_exact('root')} AS brand_match, "
    f"{Q.flag('suffix', lists.HIGH_RISK_TLDS)} AS is_suspicious_tld FROM dhp)",
)
def sample_weights(spark, sf):
    f = FT.with_host_features(DV.spark_domains(spark, sf), "domain")
    return D.sample_weights(f).select("id", "brand_match", "is_suspicious_tld", "weight")


# ------------------------------------------------------------ J1, J2, L3


# The feature cache a previous run left holds the ranked-list domains.


@register(
    "feature_cache_missing",
    _with(["labelled", "ranked"], [
        Q.rules_cte(),
        ("miss", "SELECT DISTINCT domain FROM labelled l WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.domain = l.domain)"),
        ("miss_a", f"SELECT domain, {Q.clean_host('domain')} AS host FROM miss"),
        *Q.split_ctes("miss_a", "host", "mhp"),
    ])
    + f"SELECT domain, {_feature_sql()} FROM mhp",
)
def feature_cache_missing(spark, sf):
    wanted = DV.spark_labelled(spark, sf).select("domain").distinct()
    # the cache's keys, each once: an anti-join cannot split a hot key on this side
    cached = DV.spark_ranked(spark, sf).select("domain").distinct()
    missing = wanted.join(cached, "domain", "left_anti")
    return _round_entropy(FT.with_host_features(missing, "domain"))


@register(
    "feature_cache_keyed",
    _with(["labelled", "ranked"], [
        Q.rules_cte(),
        ("known", "SELECT DISTINCT domain FROM (SELECT domain FROM ranked UNION ALL SELECT domain FROM labelled) WHERE domain IS NOT NULL"),
        ("known_a", f"SELECT domain, {Q.clean_host('domain')} AS host FROM known"),
        *Q.split_ctes("known_a", "host", "khp"),
        ("feat", f"SELECT domain, {_feature_sql()} FROM khp"),
    ])
    + "SELECT l.id, l.label, f.* FROM labelled l LEFT JOIN feat f ON l.domain = f.domain",
)
def feature_cache_keyed(spark, sf):
    """L3 with J1: a cache of the ranked domains, upserted twice with the labelled ones,
    then read by the labelled rows bucket to bucket."""
    from hostscope.session import shared_path
    from hostscope.sources.feature_cache import create_cache, open_cache, upsert

    path = shared_path(spark, "feature-cache")
    create_cache(FT.with_host_features(DV.spark_ranked(spark, sf).select("domain").distinct(), "domain"), path)
    labelled = DV.spark_labelled(spark, sf)
    for _ in range(2):
        upsert(spark, labelled.select("domain"), path, lambda d: FT.with_host_features(d, "domain"))
    rows = labelled.join(open_cache(spark, path), "domain", "left")
    return _round_entropy(rows.select("id", "label", "domain", *FT.FEATURE_COLUMNS))


@register(
    "feature_join",
    _with(["feed_text_raw", "feed_csv_raw", "ranked", "corrections"], _DATASET_SQL + [
        Q.rules_cte(),
        ("uniq", "SELECT DISTINCT domain FROM dataset"),
        ("uniq_a", f"SELECT domain, {Q.clean_host('domain')} AS host FROM uniq"),
        *Q.split_ctes("uniq_a", "host", "uhp"),
        ("feat", f"SELECT domain, {_feature_sql()} FROM uhp"),
    ])
    + "SELECT d.domain, d.label, d.copy, "
    + ", ".join(f"f.{c}" for c in lists.FEATURE_ORDER)
    + " FROM dataset d LEFT JOIN feat f ON d.domain = f.domain",
)
def feature_join(spark, sf):
    from hostscope.operators.joins import hot_keys, key_counts, split_join
    from hostscope.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    # written once: the counts and both branches of the join read it
    data = _dataset(spark, sf).checkpoint(eager=True)
    # D3: features once per domain; the per-domain counts also name the hot
    # domains, which J1 serves from a broadcast of their feature rows
    counts = key_counts(data, ["domain"]).checkpoint(eager=True)
    feats = _round_entropy(FT.with_host_features(counts.select("domain"), "domain"))
    feats = feats.select("domain", *lists.FEATURE_ORDER)
    out = split_join(data, feats, ["domain"], hot_keys(counts, ["domain"]))
    return out.select("domain", "label", "copy", *lists.FEATURE_ORDER)


# ------------------------------------------------------------ scan log


@register(
    "scan_stats",
    _with(["scans"]) + "SELECT count(*) AS total_scanned, "
    "coalesce(sum(CASE WHEN label = 'legitimate' THEN 1 ELSE 0 END), 0)::BIGINT AS legitimate, "
    "coalesce(sum(CASE WHEN label = 'phishing' THEN 1 ELSE 0 END), 0)::BIGINT AS phishing FROM scans",
)
def scan_stats(spark, sf):
    return S.scan_stats(DV.spark_scans(spark, sf))


@register(
    "label_counts",
    _with(["scans"]) + "SELECT label, sum(one)::BIGINT AS n FROM (SELECT label, 1 AS one FROM scans "
    "UNION ALL SELECT 'legitimate', 0 UNION ALL SELECT 'phishing', 0) GROUP BY label",
)
def label_counts(spark, sf):
    return S.label_counts(DV.spark_scans(spark, sf))


@register(
    "class_share",
    _with(["scans"], [("st", "SELECT count(*) AS total_scanned, "
                             "coalesce(sum(CASE WHEN label = 'legitimate' THEN 1 ELSE 0 END), 0)::BIGINT AS legitimate, "
                             "coalesce(sum(CASE WHEN label = 'phishing' THEN 1 ELSE 0 END), 0)::BIGINT AS phishing "
                             "FROM scans")])
    + "SELECT total_scanned, legitimate, phishing, "
    "CASE WHEN legitimate + phishing = 0 THEN 50 ELSE floor(legitimate::DOUBLE / (legitimate + phishing)::DOUBLE * 100.0 + 0.5) END::BIGINT AS legitimate_pct, "
    "CASE WHEN legitimate + phishing = 0 THEN 50 ELSE floor(phishing::DOUBLE / (legitimate + phishing)::DOUBLE * 100.0 + 0.5) END::BIGINT AS phishing_pct "
    "FROM st",
)
def class_share(spark, sf):
    return S.class_share(DV.spark_scans(spark, sf))


@register(
    "top_risky_tlds",
    _with(["scans"], [
        ("t", "SELECT lower(string_split(domain, '.')[-1]) AS tld, id FROM scans "
              "WHERE label = 'phishing' AND contains(domain, '.')"),
        ("g", "SELECT tld, count(*) AS cnt, min(id) AS first_id FROM t GROUP BY tld"),
        ("top", f"SELECT * FROM g ORDER BY cnt DESC, first_id ASC LIMIT {lists.TOP_TLDS}"),
    ])
    + "SELECT row_number() OVER (ORDER BY cnt DESC, first_id ASC) AS rank, tld, cnt::BIGINT AS count, "
    "floor(cnt / max(cnt) OVER () * 100.0 + 0.5)::BIGINT AS bar_pct FROM top",
)
def top_risky_tlds(spark, sf):
    return S.top_risky_tlds(DV.spark_scans(spark, sf))


_HIST_SQL = _with(["scans"], [
    ("latest", f"SELECT id, domain, label, confidence, ts FROM scans ORDER BY ts DESC, id DESC LIMIT {lists.HISTORY_LIMIT}"),
    Q.rules_cte(),
    ("la", f"SELECT *, {Q.clean_host('domain')} AS __host FROM latest"),
    *Q.split_ctes("la", "__host", "lhp", names=("__sub", "__root", "__suffix")),
    ("ind", f"SELECT id, domain, label, confidence, ts, {Q.is_ip('__host')} AS is_ip, "
            f"{Q.has_mixed_script('__host')} AS has_mixed_script, "
            f"{Q.in_list('__suffix', lists.HIGH_RISK_TLDS)} AS tld_is_risky FROM lhp"),
]) + (
    f"SELECT * REPLACE ({_TS_SQL} AS ts), floor(confidence * 100.0 + 0.5)::BIGINT AS confidence_pct, "
    "coalesce(nullif(concat_ws(',', CASE WHEN is_ip THEN 'is_ip' END, CASE WHEN has_mixed_script THEN 'has_mixed_script' END, "
    "CASE WHEN tld_is_risky THEN 'tld_is_risky' END), ''), 'none') AS triggered FROM ind"
)


@register("scan_history", _HIST_SQL)
def scan_history(spark, sf):
    out = S.scan_history(DV.spark_scans(spark, sf))
    return out.withColumn("ts", _ts_text(F.col("ts")))


_STATS_SQL = _with(["scans"], [
    ("lab", "SELECT label, sum(one)::BIGINT AS n FROM (SELECT label, 1 AS one FROM scans UNION ALL SELECT 'legitimate', 0 "
            "UNION ALL SELECT 'phishing', 0) GROUP BY label"),
    ("t", "SELECT lower(string_split(domain, '.')[-1]) AS tld, id FROM scans WHERE label = 'phishing' AND contains(domain, '.')"),
    ("g", "SELECT tld, count(*) AS cnt, min(id) AS first_id FROM t GROUP BY tld"),
]) + (
    "SELECT 'total' AS section, 1::BIGINT AS rank, 'rows' AS key, count(*)::BIGINT AS n FROM scans "
    "UNION ALL SELECT 'label', row_number() OVER (ORDER BY label), label, n FROM lab "
    "UNION ALL SELECT * FROM (SELECT 'tld', row_number() OVER (ORDER BY cnt DESC, first_id) AS rank, tld, cnt::BIGINT FROM g) "
    f"WHERE rank <= {lists.TOP_TLDS}"
)


@register("stats_document", _STATS_SQL)
def stats_document(spark, sf):
    """G4 from one scan of the log."""
    return S.stats_rows(S.stats_document(DV.spark_scans(spark, sf)))


LOG_BATCHES = 12


def _batched_log(spark, sf) -> str:
    """The derived scan log as a stored log of ``LOG_BATCHES`` batches, by time."""
    from hostscope.session import shared_path
    from hostscope.sources.tables import SCAN_SCHEMA

    scans = DV.spark_scans(spark, sf)
    lo, hi = scans.agg(F.min("ts"), F.max("ts")).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.unix_micros(F.lit(hi).cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp")) + 1
    batch = F.floor((at - F.unix_micros(F.lit(lo).cast("timestamp"))) * LOG_BATCHES / span).cast("int")
    path = shared_path(spark, "scanlog")
    rows = scans.select(
        "id", "domain", "label", "confidence", F.col("ts").cast("timestamp").alias("ts"),
        F.lit(None).cast(SCAN_SCHEMA["features"].dataType).alias("features"), batch.alias("batch_id"))
    rows.write.partitionBy("batch_id").parquet(path)
    return path


@register("stats_from_slices", _STATS_SQL)
def stats_from_slices(spark, sf):
    """R2 + G4: a log of several batches, indexed, one batch replaced by a replay with
    new files, and the statistics summed from the slices."""
    from hostscope.session import remove_path
    from hostscope.sources.log_index import index_path, indexed_stats, refresh_index
    from hostscope.sources.tables import SCAN_SCHEMA, write_batch

    log = _batched_log(spark, sf)
    refresh_index(spark, log)
    last = spark.read.schema(SCAN_SCHEMA).parquet(f"{log}/batch_id={LOG_BATCHES - 1}")
    write_batch(last.checkpoint(eager=True), log, LOG_BATCHES - 1)
    out = S.stats_rows(indexed_stats(spark, log))
    remove_path(spark, log)
    remove_path(spark, index_path(log))
    return out


@register("history_from_zones", _HIST_SQL)
def history_from_zones(spark, sf):
    """O2 + L4 over a stored log, reading only batches that can hold a latest row."""
    from hostscope.session import remove_path
    from hostscope.sources.log_index import index_path, indexed_history

    log = _batched_log(spark, sf)
    out = indexed_history(spark, log)
    remove_path(spark, log)
    remove_path(spark, index_path(log))
    return out.drop("features").withColumn("ts", _ts_text(F.col("ts")))


@register(
    "ranked_head",
    _with(["ranked"]) + f"SELECT rank, domain FROM {DV.sql_ranked_head(lists.RANKED_HEAD_APP)}",
)
def ranked_head(spark, sf):
    return DV.spark_ranked_head(spark, sf, lists.RANKED_HEAD_APP).select("rank", "domain")


# ------------------------------------------------------------ metrics

_CNT_SQL = ("cnt", "SELECT sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, "
                   "sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, "
                   "sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, "
                   "sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp FROM predictions")


@register(
    "confusion_matrix",
    _with(["predictions"], [_CNT_SQL])
    + "SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cnt UNION ALL SELECT 0, 1, fp FROM cnt "
    "UNION ALL SELECT 1, 0, fn FROM cnt UNION ALL SELECT 1, 1, tp FROM cnt",
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(DV.spark_predictions(spark, sf))


def _sdiv(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


_PC_SQL = ("pc", (
    f"SELECT 'legitimate' AS label, {_sdiv('tn', 'tn + fn')} AS precision, {_sdiv('tn', 'tn + fp')} AS recall, "
    "tn + fp AS support FROM cnt UNION ALL "
    f"SELECT 'phishing', {_sdiv('tp', 'tp + fp')}, {_sdiv('tp', 'tp + fn')}, fn + tp FROM cnt"))


@register(
    "class_metrics",
    _with(["predictions"], [
        _CNT_SQL, _PC_SQL,
        ("pcf", f"SELECT *, {_sdiv('2 * precision * recall', 'precision + recall')} AS f1 FROM pc"),
    ])
    + f"SELECT label, {_rs('precision')} AS precision, {_rs('recall')} AS recall, {_rs('f1')} AS f1, support::BIGINT AS support FROM pcf "
    f"UNION ALL SELECT 'accuracy', NULL, NULL, {_rs(_sdiv('tn + tp', 'tn + fp + fn + tp'))}, (tn + fp + fn + tp)::BIGINT FROM cnt "
    f"UNION ALL SELECT 'macro avg', {_rs('avg(precision)')}, {_rs('avg(recall)')}, {_rs('avg(f1)')}, sum(support)::BIGINT FROM pcf "
    f"UNION ALL SELECT 'weighted avg', {_rs(_sdiv('sum(precision * support)', 'sum(support)'))}, "
    f"{_rs(_sdiv('sum(recall * support)', 'sum(support)'))}, {_rs(_sdiv('sum(f1 * support)', 'sum(support)'))}, "
    "sum(support)::BIGINT FROM pcf",
)
def class_metrics(spark, sf):
    out = M.class_metrics(DV.spark_predictions(spark, sf))
    return out.select("label", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register(
    "weighted_metrics",
    _with(["predictions"], [
        _CNT_SQL, _PC_SQL,
        ("pcf", f"SELECT *, {_sdiv('2 * precision * recall', 'precision + recall')} AS f1 FROM pc"),
    ])
    + f"SELECT sum(support)::BIGINT AS n, {_rs(_sdiv('(SELECT tn + tp FROM cnt)', 'sum(support)'))} AS accuracy, "
    f"{_rs(_sdiv('sum(precision * support)', 'sum(support)'))} AS precision_weighted, "
    f"{_rs(_sdiv('sum(recall * support)', 'sum(support)'))} AS recall_weighted, "
    f"{_rs(_sdiv('sum(f1 * support)', 'sum(support)'))} AS f1_weighted FROM pcf",
)
def weighted_metrics(spark, sf):
    out = M.weighted_metrics(DV.spark_predictions(spark, sf))
    return out.select(F.col("n").cast("long"), *[_r(F.col(c)).alias(c) for c in
                                                 ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")])


@register(
    "roc_auc",
    _with(["predictions"], [
        ("r", "SELECT y, rank() OVER (ORDER BY prob) AS lo, count(*) OVER (PARTITION BY prob) AS ties FROM predictions"),
        ("a", "SELECT sum(CASE WHEN y = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pos, "
              "sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)::BIGINT AS n_neg, "
              "sum(CASE WHEN y = 1 THEN lo + (ties - 1) / 2.0 ELSE 0 END) AS rank_sum FROM r"),
    ])
    + f"SELECT n_pos, n_neg, CASE WHEN n_pos = 0 OR n_neg = 0 THEN NULL ELSE "
    f"{_rs('(rank_sum - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg::DOUBLE)')} END AS auc FROM a",
)
def roc_auc(spark, sf):
    out = M.roc_auc(DV.spark_predictions(spark, sf))
    return out.select("n_pos", "n_neg", _r(F.col("auc")).alias("auc"))


@register(
    "sliced_accuracy",
    _with(["predictions"], [
        ("s", "SELECT count(*) AS n, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS correct FROM predictions WHERE brand_match = 1"),
    ])
    + "SELECT n::BIGINT AS n, CASE WHEN n = 0 THEN NULL ELSE round(correct::DOUBLE / n::DOUBLE, 9) END AS accuracy, "
    "CASE WHEN n = 0 THEN NULL ELSE correct::DOUBLE / n::DOUBLE > 0.95 END AS above_floor, "
    "CASE WHEN n = 0 THEN 'no samples' ELSE 'ok' END AS note FROM s",
)
def sliced_accuracy(spark, sf):
    out = M.sliced_accuracy(DV.spark_predictions(spark, sf))
    return out.withColumn("accuracy", _r(F.col("accuracy")))


# ------------------------------------------------------------ notebook build, P12-P14


def _nb_feeds(spark, sf):
    from hostscope.sources.feeds import notebook_subdomains

    part = DV.table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"),
        F.expr(DV.gen_url("p_partkey", "p_name", "p_size", "spark")).alias("url"),
    )
    phish = part.select(netloc_notebook("url").alias("domain"), F.lit(lists.PHISHING).alias("label"),
                        F.lit(1).alias("source_prio"), "pos")
    ranked = DV.spark_ranked_head(spark, sf, lists.RANKED_HEAD_NOTEBOOK).select(
        "domain", F.lit(lists.LEGITIMATE).alias("label"), F.lit(2).alias("source_prio"),
        F.col("rank").cast("long").alias("pos"),
    )
    return [phish, ranked, notebook_subdomains(spark, 3)]


_NB_SUBS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({Q.q(d)}, {i})" for i, d in enumerate(lists.NOTEBOOK_SUBDOMAINS)) + ") t(domain, pos)"


@register(
    "dedupe_first_notebook",
    _with(["feed_text_raw", "ranked"], [
        ("nb_subs", _NB_SUBS_SQL),
        ("nb_feeds",
         f"SELECT lower({Q.py_strip('domain')}) AS domain, label, source_prio, pos FROM ("
         f"SELECT {Q.netloc_notebook('url')} AS domain, 'phishing' AS label, 1 AS source_prio, pos::BIGINT AS pos FROM feed_text_raw "
         f"UNION ALL SELECT domain, 'legitimate', 2, rank::BIGINT FROM {DV.sql_ranked_head(lists.RANKED_HEAD_NOTEBOOK)} "
         "UNION ALL SELECT domain, 'legitimate', 3, pos::BIGINT FROM nb_subs) WHERE domain IS NOT NULL"),
    ])
    + "SELECT domain, label, source_prio, pos FROM (SELECT *, row_number() OVER "
    "(PARTITION BY domain ORDER BY source_prio, pos) AS rn FROM nb_feeds) WHERE rn = 1 AND length(domain) > 0",
)
def dedupe_first_notebook(spark, sf):
    from hostscope.sources.feeds import combine_feeds

    out = combine_feeds(_nb_feeds(spark, sf), notebook=True)
    return out.select("domain", "label", F.col("source_prio").cast("int"), "pos")


@register(
    "report_flip",
    _with(["scans"])
    + "SELECT id, domain, CASE WHEN label = 'phishing' THEN 'legitimate' ELSE 'phishing' END AS corrected_label, "
    f"length({Q.py_strip('domain')}) > 0 AND (CASE WHEN label = 'phishing' THEN 'legitimate' ELSE 'phishing' END) "
    "IN ('legitimate', 'phishing') AS valid FROM scans",
)
def report_flip(spark, sf):
    from hostscope.sources.tables import flip_label, valid_correction

    s = DV.spark_scans(spark, sf)
    flipped = flip_label(F.col("label"))
    return s.select("id", "domain", flipped.alias("corrected_label"),
                    valid_correction(F.col("domain"), flipped).alias("valid"))


_NB_HAVE = {"length", "subdomain_count", "hyphen_count", "digit_count", "special_char_count", "entropy",
            *[f"has_{w}" for w in lists.FEATURE_KEYWORDS], "brand_match", "known_brand_root",
            "min_brand_distance", "has_punycode", "contains_unicode", "unicode_ratio", "is_common_tld",
            "is_suspicious_tld"}


@register(
    "aligned_features",
    _with(["domains"], _NB_CTES + [("nbf", _NB_SELECT)])
    + "SELECT id, "
    + ", ".join(c if c in _NB_HAVE else f"0 AS {c}" for c in lists.FEATURE_ORDER)
    + " FROM nbf",
)
def aligned_features(spark, sf):
    from hostscope.operators.requests import align_features

    nb = notebook_features(spark, sf)
    return align_features(nb, lists.FEATURE_ORDER, keep=["id"])


@register(
    "union_weighted",
    _with(["feed_text_raw", "feed_csv_raw", "ranked", "corrections"], _DATASET_SQL[:-1] + [
        ("dataset_w",
         "SELECT domain, label, 1.0::DOUBLE AS weight FROM combined "
         f"UNION ALL SELECT domain, label, {float(lists.CURATED_COPIES)}::DOUBLE FROM curated "
         f"UNION ALL SELECT domain, label, {float(lists.CURATED_COPIES)}::DOUBLE FROM corr_last"),
    ])
    + "SELECT * FROM dataset_w",
)
def union_weighted(spark, sf):
    """A2 scalable mode: curated rows and latest corrections once each,
    carrying ``weight = 500`` instead of 500 copies."""
    base = dedupe_first(spark, sf).select("domain", "label", F.lit(1.0).alias("weight"))
    curated = D.as_weighted(_curated(spark))
    corr = D.keep_last(DV.spark_corrections(spark, sf), "domain", ("ts", "id")).select("domain", "label")
    return D.union_all([base, curated, D.as_weighted(corr)]).select("domain", "label", "weight")


# ------------------------------------------------------------ variants


@register(
    "top_risky_tlds_clean",
    _with(["scans"], [
        ("t", f"SELECT lower(string_split(h, '.')[-1]) AS tld, id FROM (SELECT {Q.clean_host('domain')} AS h, id, "
              "label FROM scans) WHERE label = 'phishing' AND contains(h, '.')"),
        ("g", "SELECT tld, count(*) AS cnt, min(id) AS first_id FROM t GROUP BY tld"),
        ("top", f"SELECT * FROM g ORDER BY cnt DESC, first_id ASC LIMIT {lists.TOP_TLDS}"),
    ])
    + "SELECT row_number() OVER (ORDER BY cnt DESC, first_id ASC) AS rank, tld, cnt::BIGINT AS count, "
    "floor(cnt / max(cnt) OVER () * 100.0 + 0.5)::BIGINT AS bar_pct FROM top",
)
def top_risky_tlds_clean(spark, sf):
    """G3 variant: TLDs of the cleaned host instead of the raw stored text."""
    return S.top_risky_tlds(DV.spark_scans(spark, sf), clean_first=True)


@register("host_features_distinct", HP + f"SELECT src, uid, {_feature_sql()} FROM hp")
def host_features_distinct(spark, sf):
    """H22 once per distinct URL, joined back through the skew-safe split join."""
    out = FT.with_host_features_distinct(DV.spark_urls(spark, sf), "url")
    return _round_entropy(out.select("src", "uid", *FT.FEATURE_COLUMNS))


@register(
    "batch_lines_valid",
    "SELECT doc_id, line_no, " + Q.valid_client("line") + " AS valid_client, " + Q.valid_server("line")
    + " AS valid_server FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, "
    f"{Q.js_trim('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE length(line) > 0",
)
def batch_lines_valid(spark, sf):
    """S16 -> V2 -> V1: every pasted line of every document, checked by the
    browser rule and the server rule (multilingual text)."""
    lines = batch_lines(DV.table(spark, sf, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_no", H.valid_client("line").alias("valid_client"),
                        H.valid_server("line").alias("valid_server"))
