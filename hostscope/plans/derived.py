"""Relations derived from the driver tables, each in two renderings.

The driver's tables carry no phishing feeds, so the registered queries read
relations Spark derives from them (their work grows with the tables):

* ``urls``       -- every ``pages.url`` plus one URL per ``part`` row
                    (schemes, userinfo, ports, paths, ``www.`` prefixes);
* ``domains``    -- one generated host per ``part`` row;
* ``labelled``   -- ``domains`` with a rule label plus hash noise;
* ``feed_text``, ``feed_csv``, ``ranked`` -- the three ingest sources
                    (all ``part`` rows, all ``customer`` rows, all
                    ``customer`` + ``supplier`` rows as a ranked list);
* ``scans``      -- the scan log, one row per ``events`` row;
* ``corrections``-- reported corrections, one per ``events`` row;
* ``predictions``-- a (y, pred, prob) relation over ``events``.

``spark_*`` functions return DataFrames; ``SQL`` holds the same relations as
DuckDB CTE bodies for the oracle.  The generator constants below are our own
choice, not reference values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.functions.urls import netloc_app
from hostscope.session import spread

GEN_TLDS = ["com", "net", "org", "in", "co.uk", "gov.in", "tk", "xyz", "top", "io",
            "cc", "shop", "app", "info", "ru", "de"]
GEN_SUBS = ["", "www.", "login.", "a.b.", "m.www."]
GEN_SCHEMES = ["http://", "https://", "", "HTTP://", "//", "ftp://"]
GEN_PORTS = ["", ":8080", "", ":443", ""]
GEN_PATHS = ["/", "/login", "?q=1", "#top", "", "/a/b.html"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------ dialect helpers


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(values: list[str], idx: str, dialect: str) -> str:
    """values[idx] with a 0-based integer index expression."""
    if dialect == "spark":
        return f"element_at(array({', '.join(_q(v) for v in values)}), CAST(({idx}) AS INT) + 1)"
    return f"([{', '.join(_q(v) for v in values)}])[({idx}) + 1]"


def _div(a: str, b: int, dialect: str) -> str:
    return f"({a} div {b})" if dialect == "spark" else f"({a} // {b})"


def gen_domain(key: str, name: str, size: str, dialect: str) -> str:
    """Host from an integer key, a free-text name and a small integer."""
    key, size = f"({key})", f"({size})"
    q = _div(key, 4, dialect)
    brand = _pick(lists.KNOWN_BRANDS, f"{q} % {len(lists.KNOWN_BRANDS)}", dialect)
    kw = _pick(lists.KEYWORDS, f"{q} % {len(lists.KEYWORDS)}", dialect)
    core = (
        f"CASE {key} % 4 WHEN 0 THEN {brand} "
        f"WHEN 1 THEN translate({brand}, 'oie', '013') "
        f"WHEN 2 THEN {kw} || '-' || {brand} "
        f"ELSE replace(lower({name}), ' ', '-') END"
    )
    tld = _pick(GEN_TLDS, f"{size} % {len(GEN_TLDS)}", dialect)
    sub = _pick(GEN_SUBS, f"{_div(key, 16, dialect)} % {len(GEN_SUBS)}", dialect)
    text = "STRING" if dialect == "spark" else "VARCHAR"
    # every 13th key is a dotted quad (some octets above 255); every 11th
    # core carries an ACE-style 'xn--' prefix
    quad = (f"CAST({key} % 256 AS {text}) || '.' || CAST({_div(key, 256, dialect)} % 256 AS {text}) "
            f"|| '.1.' || CAST({key} % 300 AS {text})")
    ace = f"CASE WHEN {key} % 11 = 7 THEN 'xn--' ELSE '' END"
    # some cores begin with a Cyrillic or an accented letter
    mark = f"CASE WHEN {key} % 19 = 4 THEN '\u0430' WHEN {key} % 23 = 6 THEN '\u00e9' ELSE '' END"
    return f"(CASE WHEN {key} % 13 = 5 THEN {quad} ELSE {sub} || {ace} || {mark} || ({core}) || '.' || {tld} END)"


def gen_url(key: str, name: str, size: str, dialect: str) -> str:
    key, size = f"({key})", f"({size})"
    scheme = _pick(GEN_SCHEMES, f"{key} % {len(GEN_SCHEMES)}", dialect)
    user = f"CASE WHEN {key} % 7 = 3 THEN 'user:pw@' ELSE '' END"
    port = _pick(GEN_PORTS, f"{key} % {len(GEN_PORTS)}", dialect)
    path = _pick(GEN_PATHS, f"{size} % {len(GEN_PATHS)}", dialect)
    # every 17th URL is pasted with surrounding blanks
    lead = f"CASE WHEN {key} % 17 = 2 THEN '  ' ELSE '' END"
    trail = f"CASE WHEN {key} % 17 = 2 THEN ' ' ELSE '' END"
    # every 29th host ends in a character that NFKC turns into a/c or a full-width slash
    sign = f"CASE {key} % 58 WHEN 8 THEN '\u2100' WHEN 37 THEN '\uff0f' ELSE '' END"
    return (f"({lead} || {scheme} || {user} || {gen_domain(key, name, size, dialect)} || {sign} || {port} || {path} "
            f"|| {trail})")


def _brand_host(key: str, tld_key: str, dialect: str, extra: str | None = None) -> str:
    key, tld_key = f"({key})", f"({tld_key})"
    brand = _pick(lists.KNOWN_BRANDS, f"{key} % {len(lists.KNOWN_BRANDS)}", dialect)
    tld = _pick(GEN_TLDS, f"{tld_key} % {len(GEN_TLDS)}", dialect)
    mid = f" || '-' || {extra}" if extra else ""
    return f"({brand}{mid} || '.' || {tld})"


def _scan_domain(dialect: str) -> str:
    text = "STRING" if dialect == "spark" else "VARCHAR"
    return gen_domain("user_id", f"'site ' || CAST(user_id AS {text})", "user_id", dialect)


def _phish_event() -> str:
    return "event_type IN ('error', 'purchase')"


def _label_rule(dialect: str) -> str:
    noise = "substr(md5(domain || ':7'), 1, 2) < '1a'"
    return (
        f"CASE WHEN ((id % 4) IN (1, 2)) <> ({noise}) THEN 'phishing' ELSE 'legitimate' END"
    )


# ------------------------------------------------------------ Spark side


def spark_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        F.lit("page").alias("src"), F.col("page_id").alias("uid"), "url"
    )
    part = _spread_part(spark, sf_dir).select(
        F.lit("part").alias("src"),
        F.col("p_partkey").alias("uid"),
        F.expr(gen_url("p_partkey", "p_name", "p_size", "spark")).alias("url"),
    )
    return pages.unionByName(part)


def _spread_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hosts are made of, over enough tasks for their features."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


def spark_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_part(spark, sf_dir).select(
        F.col("p_partkey").alias("id"),
        F.expr(gen_domain("p_partkey", "p_name", "p_size", "spark")).alias("domain"),
    )


def spark_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_domains(spark, sf_dir).withColumn("label", F.expr(_label_rule("spark")))


def spark_feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text feed: one URL per part row; domain by the app's netloc rule."""
    u = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.expr(gen_url("p_partkey", "p_name", "p_size", "spark")).alias("url"),
    )
    return u.select(
        netloc_app("url").alias("domain"), F.lit(lists.PHISHING).alias("label"),
        F.lit(1).alias("source_prio"), "pos",
    )


def spark_feed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    url = "'https://' || " + _brand_host("c_custkey", "c_nationkey", "spark", "lower(c_mktsegment)") + " || '/'"
    return c.select(
        netloc_app(F.expr(url)).alias("domain"), F.lit(lists.PHISHING).alias("label"),
        F.lit(2).alias("source_prio"), F.col("c_custkey").alias("pos"),
    )


def spark_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity list (rank, domain): every 11th rank a supplier, the others customers."""
    s = table(spark, sf_dir, "supplier").select(
        F.expr("s_suppkey * 11 + 11").alias("rank"),
        F.expr(_brand_host("s_suppkey", "s_nationkey", "spark")).alias("domain"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.expr("c_custkey + c_custkey div 10 + 1").alias("rank"),
        F.expr(_brand_host("c_custkey + 3", "c_nationkey + 1", "spark")).alias("domain"),
    )
    return s.unionByName(c)


def spark_ranked_head(spark: SparkSession, sf_dir: str, head: int) -> DataFrame:
    """The first ``head`` rows of the list, by position: the numbers may have gaps."""
    return spark_ranked(spark, sf_dir).orderBy("rank").limit(head)


def sql_ranked_head(head: int) -> str:
    return f"(SELECT rank, domain FROM ranked ORDER BY rank LIMIT {head})"


def spark_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    dom = _scan_domain("spark")
    stored = f"CASE WHEN event_type = 'click' THEN 'http://' || {dom} || '/login' ELSE {dom} END"
    return e.select(
        F.col("event_id").alias("id"),
        F.expr(stored).alias("domain"),
        F.expr(f"CASE WHEN {_phish_event()} THEN 'phishing' ELSE 'legitimate' END").alias("label"),
        (F.col("value") / (F.col("value") + F.lit(10.0))).alias("confidence"),
        F.col("ts"),
    )


def spark_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.expr(_scan_domain("spark")).alias("domain"),
        F.when(F.col("value") > 50, F.lit(lists.PHISHING)).otherwise(F.lit(lists.LEGITIMATE)).alias("label"),
        F.col("ts"),
    )


def spark_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    y = F.expr(f"CASE WHEN {_phish_event()} THEN 1 ELSE 0 END")
    prob = F.when(y == 1, (F.col("value") + 5.0) / (F.col("value") + 15.0)).otherwise(
        F.col("value") / (F.col("value") + 15.0)
    )
    return e.select(
        F.col("event_id").alias("id"), y.alias("y"), prob.alias("prob"),
        F.when(prob >= 0.5, 1).otherwise(0).alias("pred"),
        F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("brand_match"),
    )


# ------------------------------------------------------------ DuckDB side


def _sql_defs() -> dict[str, str]:
    d = "duckdb"
    dom = _scan_domain(d)
    url = gen_url("p_partkey", "p_name", "p_size", d)
    return {
        "urls": (
            "SELECT 'page' AS src, page_id AS uid, url FROM pages UNION ALL "
            f"SELECT 'part' AS src, p_partkey AS uid, {url} AS url FROM part"
        ),
        "domains": f"SELECT p_partkey AS id, {gen_domain('p_partkey', 'p_name', 'p_size', d)} AS domain FROM part",
        "labelled": f"SELECT id, domain, {_label_rule(d)} AS label FROM domains",
        "feed_text_raw": f"SELECT p_partkey AS pos, {url} AS url FROM part",
        "feed_csv_raw": (
            "SELECT c_custkey AS pos, 'https://' || "
            + _brand_host("c_custkey", "c_nationkey", d, "lower(c_mktsegment)")
            + " || '/' AS url FROM customer"
        ),
        "ranked": (
            f"SELECT s_suppkey * 11 + 11 AS rank, {_brand_host('s_suppkey', 's_nationkey', d)} AS domain FROM supplier "
            f"UNION ALL SELECT c_custkey + c_custkey // 10 + 1 AS rank, "
            f"{_brand_host('c_custkey + 3', 'c_nationkey + 1', d)} AS domain FROM customer"
        ),
        "scans": (
            f"SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'http://' || {dom} || '/login' "
            f"ELSE {dom} END AS domain, CASE WHEN {_phish_event()} THEN 'phishing' ELSE 'legitimate' END "
            "AS label, value / (value + 10.0) AS confidence, ts FROM events"
        ),
        "corrections": (
            f"SELECT event_id AS id, {dom} AS domain, CASE WHEN value > 50 THEN 'phishing' "
            "ELSE 'legitimate' END AS label, ts FROM events"
        ),
        "predictions": (
            f"SELECT id, y, prob, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred, brand_match FROM ("
            f"SELECT event_id AS id, CASE WHEN {_phish_event()} THEN 1 ELSE 0 END AS y, "
            f"CASE WHEN {_phish_event()} THEN (value + 5.0) / (value + 15.0) ELSE value / (value + 15.0) END AS prob, "
            "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS brand_match FROM events)"
        ),
    }


SQL = _sql_defs()

# Which derived relations each derived relation needs (CTE order).
SQL_DEPS = {"labelled": ["domains"]}


def with_ctes(names: list[str], extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named relations (dependencies first)."""
    order: list[str] = []
    for n in names:
        for dep in SQL_DEPS.get(n, []):
            if dep not in order:
                order.append(dep)
        if n not in order:
            order.append(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"
