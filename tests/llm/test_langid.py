"""Ids pass the language scorer unchanged."""

from hostscope.llm import langid


def test_ids_beside_a_null_stay_exact(spark):
    rows = [(2**53 + 1, "the cat and the dog", "en"), (None, "der Hund und die Katze", "de"), (2**62 + 3, None, None), (-1, "123", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = langid.detect_languages(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((d is None, d or 0) for d, _, _ in rows)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (2**62 + 3, -1)} == {2**62 + 3: "und", -1: "und"}
