"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector of ``DIM`` components (a fixed hash of
the code point).  A trigram's vector binds its letters, each permuted by its
place: ``roll(A, 2) * roll(B, 1) * C``.  A text's vector bundles (sums) the
vectors of its trigrams; a language's prototype bundles its learning texts, each
scaled to equal weight per trigram root so that a few long texts do not decide.
The prediction is the prototype of largest cosine.

Learning and prediction read all texts.  A task sends one vector per language,
so what reaches the driver is tasks x languages x DIM numbers summed by Spark
first: one row per language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C

DIM = 1_024
MAX_LANGUAGES = 2_000  # bound of what is collected and broadcast
DOCS_AT_ONCE = 256
PIECE_CHARS = 1 << 20
_U = np.uint64


def letter_vectors(points: np.ndarray, dim: int) -> np.ndarray:
    """(len(points), dim) of -1 and 1: bits of a counter hash of the code point."""
    words = (dim + 63) // 64
    base = C.mix64(points.astype(_U) + _U(0x51ED270B))[:, None]
    bits = C.mix64(base + np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    out = np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1)[:, :dim]
    return out.astype(np.int8) * 2 - 1


_LETTER = np.zeros(0x110000, np.int32)  # lower-cased letter, 0 for others, -1 unknown yet
_LETTER -= 1


def _letters(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters; a space (32) for everything else."""
    seen = np.unique(points)
    for p in seen[_LETTER[seen] < 0].tolist():
        ch = chr(p)
        low = ch.lower()
        _LETTER[p] = ord(low) if ch.isalpha() and len(low) == 1 else ord(ch) if ch.isalpha() else 32
    return _LETTER[points]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, as 63-bit codes, and their counts.  Words are
    runs of letters with a space on either side."""
    codes, counts = [], []
    for at in range(0, max(len(text) - 2, 1), PIECE_CHARS):
        # pieces overlap by two letters, so each trigram is counted once
        part = text[at : at + PIECE_CHARS + 2]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        a = _letters(points).astype(np.int64)
        if at == 0:
            a = np.concatenate([[32], a])
        if at + PIECE_CHARS + 2 >= len(text):
            a = np.concatenate([a, [32]])
        if len(a) < 3:
            continue
        code = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
        code = code[(a[1:-1] != 32)]  # the middle is a letter: no gaps, no runs of spaces
        c, n = np.unique(code, return_counts=True)
        codes.append(c)
        counts.append(n)
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    c, at = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def trigram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    letters, at = np.unique(
        np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]), return_inverse=True)
    at = at.reshape(3, -1)
    v = letter_vectors(letters, dim)
    return (np.roll(v, 2, 1)[at[0]] * np.roll(v, 1, 1)[at[1]] * v[at[2]]).astype(np.float32)


def text_vectors(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, dim) bundles and the number of trigrams of each text."""
    grams = [trigram_counts(t) if t else (np.zeros(0, np.int64),) * 2 for t in texts]
    codes, at = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
    total = np.array([g[1].sum() for g in grams])
    if not len(codes):
        return np.zeros((len(texts), dim), np.float32), total
    row = np.repeat(np.arange(len(texts)), [len(g[0]) for g in grams])
    count = np.concatenate([g[1] for g in grams]).astype(np.float32)
    out = np.zeros((len(texts), dim), np.float32)
    for a in range(0, len(codes), 4_096):  # bounded: 4,096 trigram vectors at a time
        b = min(a + 4_096, len(codes))
        mine = (at >= a) & (at < b)
        dense = np.zeros((len(texts), b - a), np.float32)
        dense[row[mine], at[mine] - a] = count[mine]
        out += dense @ trigram_vectors(codes[a:b], dim)
    return out, total


def _blocks(values: list) -> list[tuple[int, int]]:
    """Ranges of at most DOCS_AT_ONCE texts and about 2 MB of text."""
    out, first, size = [], 0, 0
    for i, v in enumerate(values):
        size += len(v) if v else 0
        if i + 1 - first >= DOCS_AT_ONCE or size > 2_000_000:
            out.append((first, i + 1))
            first, size = i + 1, 0
    if first < len(values):
        out.append((first, len(values)))
    return out


def learn_prototypes(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit prototype of each language of ``docs(text, lang)``; rows without
    text, letters or language teach nothing."""
    C.python_ready(docs.sparkSession)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            texts, langs = pdf["text"].tolist(), pdf["lang"].to_numpy()
            for a, b in _blocks(texts):
                v, n = text_vectors(texts[a:b], dim)
                v = v / np.sqrt(np.maximum(n, 1))[:, None]
                for lang in set(langs[a:b]):
                    s = v[langs[a:b] == lang].sum(0, dtype=np.float64)
                    sums[lang] = sums.get(lang, 0) + s
        if sums:
            # sums are whole thousandths, so adding them is exact in any order
            yield pd.DataFrame({"lang": list(sums), "v": [np.rint(s * 1000).astype(np.int64) for s in sums.values()]})

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = rows.mapInPandas(bundle, "lang string, v array<long>")
    total = (
        parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    )
    if len(total) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for r in total:
        v = np.array([e["x"] for e in r.v], np.float64)
        if v.any():
            out[r.lang] = v / np.linalg.norm(v)
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """``docs(key, text, ...)`` -> ``key, lang_pred, score``: the language of the
    largest cosine (ties: the smaller name) and that cosine, not below 0.  Texts
    that are null or have no letter, and all texts if nothing was learned, are
    ``und`` with score 0."""
    C.python_ready(docs.sparkSession)
    names = sorted(prototypes)
    known = np.array([prototypes[n] for n in names]).reshape(len(names), dim)

    def predict(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for a, b in _blocks(texts) if names else []:
                v, n = text_vectors(texts[a:b], dim)
                norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
                cos = (v.astype(np.float64) @ known.T) / np.maximum(norm, 1e-12)[:, None]
                best = cos.argmax(1)
                for i in np.flatnonzero((n > 0) & (norm > 0)):
                    pred[a + i] = names[best[i]]
                    score[a + i] = min(1.0, max(0.0, cos[i, best[i]]))
            # the ids stay in Arrow: pandas would turn them to doubles beside a null
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

    return docs.select(F.col("key").cast("long"), F.col("text").cast("string")).mapInArrow(
        predict, "key long, lang_pred string, score double")


def detect_languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``documents``,
    learned from the rows that are not held out.  Rows without id are never held
    out and never learned from; repeated rows are returned as often; an empty
    table gives an empty result; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text", "lang")
    prototypes = learn_prototypes(rows.where(F.col("key").isNotNull() & ~C.held_out(F.col("key"))))
    out = identify(rows, prototypes)
    return out.select(F.col("key").alias("doc_id"), C.held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
