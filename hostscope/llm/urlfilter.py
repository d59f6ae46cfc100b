"""URL filter: host and path rules, and boosted trees where no rule fits.

A rule names a host with all its subdomains and a path prefix; the longest rule
that fits decides.  The URLs that a rule decides are the labelled ones: gradient
boosted trees learn from lexical features of at most about ``MAX_ROWS`` of them
(length, depth, digit ratio, entropy, parameter counts, suffix statistics) and
judge the URLs that no rule decides.

Suffix statistics are the smoothed share of blocked URLs per host suffix (last
label, and last two labels).  They are counted over all labelled URLs of one hash
fold, aggregated map side and joined by the suffix; the trees learn from the
other fold, so they do not see a statistic that contains their own label.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C

MAX_ROWS = 20_000
TREES, DEPTH = 16, 4
SMOOTHING = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "digit_ratio", "hyphens",
    "specials", "entropy", "host_entropy", "parameters", "tracking", "percents", "has_fragment", "secure", "last_length",
    "top_blocked", "domain_blocked", "top_known", "domain_known",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#``;
    then the path up to ``?`` or ``#``.  Null or no ``://``: both empty."""
    rest = F.when(url.contains("://"), F.substr(url, F.position(F.lit("://"), url) + 3))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (``host/path`` -> verdict) that fits; null if none."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def _entropy(x: Column) -> Column:
    """Shannon entropy in bits of the characters; 0 for the empty string."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    n = F.size(chars)
    return F.when(n > 0, F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, c: acc - (F.size(F.filter(chars, lambda d: d == c)) / n)
        * F.log2(F.size(F.filter(chars, lambda d: d == c)) / n))).otherwise(F.lit(0.0))


def _lexical(rows: DataFrame) -> DataFrame:
    """Features of ``rows(url, host, path, ...)`` and the two suffixes."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    digits = count(url, "[0-9]")
    length = F.length(url).cast("double")
    return rows.select(
        "*",
        length.alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"), F.length(query).cast("double").alias("query_length"),
        count(F.col("path"), "/").alias("depth"), count(F.col("host"), r"[^.]+").alias("labels"),
        digits.alias("digits"), (digits / F.greatest(length, F.lit(1.0))).alias("digit_ratio"),
        count(url, "-").alias("hyphens"), count(url, r"[^A-Za-z0-9./:?&=#_-]").alias("specials"),
        _entropy(url).alias("entropy"), _entropy(F.col("host")).alias("host_entropy"),
        count(query, "[^&]+").alias("parameters"), count(query, "(?:^|&)(?:utm_[a-z]+|ref|source|fbclid|gclid)=").alias("tracking"),
        count(url, "%").alias("percents"), url.contains("#").cast("double").alias("has_fragment"),
        url.startswith("https://").cast("double").alias("secure"),
        F.length(F.substring_index("path", "/", -1)).cast("double").alias("last_length"),
        F.substring_index("host", ".", -1).alias("top"), F.substring_index("host", ".", -2).alias("domain"),
    )


def _statistics(labelled: DataFrame, key: str, base: float, name: str) -> DataFrame:
    counts = labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("label").alias("b"))
    return counts.select(
        F.col(key), ((F.col("b") + SMOOTHING * base) / (F.col("n") + SMOOTHING)).alias(f"{name}_blocked"),
        F.log1p("n").alias(f"{name}_known"))


def judge_urls(
    pages: DataFrame, block: list[str], allow: list[str], id_col: str = "page_id", url_col: str = "url",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``verdict`` is the fitting rule's, else the trees' (block at 0.5 or more);
    ``score`` is the trees' probability of block, null where a rule decides.
    Without labelled URLs of both classes in the fold that is learned from, the
    verdict without a rule is the labelled URLs' majority (ties and none: allow).
    Null and malformed URLs have empty host and path and are judged like others;
    repeated rows get equal results; an empty table gives an empty result; other
    columns are ignored.
    """
    rules = dict.fromkeys(block, "block") | dict.fromkeys(allow, "allow")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    rows = rows.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    blocked = F.col("rule").isin(block) if block else F.lit(False)
    rows = C.stored(_lexical(rows.withColumn("label", F.when(F.col("rule").isNotNull(), blocked.cast("double")))), "urls")

    labelled = rows.where("label IS NOT NULL")
    fold = F.pmod(F.xxhash64("url"), F.lit(2))
    counts = labelled.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("label").alias("b")).collect()
    total, blocks = sum(r.n for r in counts), sum(r.b for r in counts)
    learn = next(((r.n, r.b) for r in counts if r.fold == 1), (0, 0.0))
    base = (blocks + 1) / (total + 2)
    counted = labelled.where(fold == 0)
    scored = rows
    for key, name in (("top", "top"), ("domain", "domain")):
        scored = scored.join(_statistics(counted, key, base, name), key, "left")
    scored = scored.fillna({f"{n}_{s}": v for n in ("top", "domain") for s, v in (("blocked", base), ("known", 0.0))})
    features = array_to_vector(F.array(*[F.col(c).cast("double") for c in FEATURES])).alias("features")

    if 0 < learn[1] < learn[0]:
        share = min(1.0, max_rows / learn[0])
        draw = F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 30))
        chosen = scored.where("label IS NOT NULL").where(fold == 1).where(draw < int(share * (1 << 30)) + 1)
        chosen = C.stored(chosen.select("label", *FEATURES).orderBy("label", *FEATURES).coalesce(1), "learning")
        trees = GBTClassifier(
            labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32)
        model = trees.fit(chosen.select("label", features))
        # only URLs without a rule need the trees
        asked = model.transform(scored.select("page_id", "host", "path", "rule", features))
        score = vector_to_array("probability")[1]
    else:
        asked = scored.select("page_id", "host", "path", "rule")
        score = F.lit(1.0 if total and 2 * blocks > total else 0.0)
    score = F.when(F.col("rule").isNull(), score)
    ruled = F.when(F.col("rule").isin(block), "block").otherwise("allow") if block else F.lit("allow")
    verdict = F.when(F.col("rule").isNotNull(), ruled)
    return asked.select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
