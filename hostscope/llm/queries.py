"""Registered queries of the llm operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hostscope.llm import (
    ann, conversations, decontam, langid, licenses, mixing, ngram_join, pii, suffixes, toxicity, urlfilter, warc, whitening)
from hostscope.llm.common import table

BLOCK_RULES = ["net/", "example.com/de/"]
ALLOW_RULES = ["example.net/en/", "org/fr/"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_mix_sources")
def op1_mix_sources(spark, sf):
    plan = mixing.mix_plan(table(spark, sf, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@register("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), k=5, every=50)


@register("op3_ngram_jaccard")
def op3_ngram_jaccard(spark, sf):
    out = ngram_join.ngram_components(table(spark, sf, "documents"), width=4, threshold=(85, 100))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "n_links")


@register("op4_license_scan", licenses.oracle_sql())
def op4_license_scan(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"))


@register("op5_decontaminate")
def op5_decontaminate(spark, sf):
    return decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op6_warc")
def op6_warc(spark, sf):
    return warc.archive_pages(table(spark, sf, "pages"))


@register("op7_url_filter")
def op7_url_filter(spark, sf):
    out = urlfilter.judge_urls(table(spark, sf, "pages"), BLOCK_RULES, ALLOW_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


@register("op8_pseudonyms")
def op8_pseudonyms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, "key of the query, no secret", count_col="n_replaced")


@register("op9_toxicity")
def op9_toxicity(spark, sf):
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op10_language")
def op10_language(spark, sf):
    return langid.detect_languages(table(spark, sf, "documents"))


@register("op11_whitening")
def op11_whitening(spark, sf):
    out = whitening.whiten(table(spark, sf, "embeddings"), components=4)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@register("op12_repeated_passages")
def op12_repeated_passages(spark, sf):
    return suffixes.repeated_passages(table(spark, sf, "documents"), least=50)


@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf):
    return conversations.damage_and_repair(table(spark, sf, "conversations"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
