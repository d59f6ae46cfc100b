"""Repeated passages against plain dictionaries of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostscope.llm import suffixes as sx

DOCS = "doc_id long, text string"


def brute(rows, least):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    holder = {}
    for d, x in raw:
        for i in range(len(x) - least + 1 if d is not None else 0):
            s = x[i : i + least]
            holder[s] = min(holder.get(s, d), d)
    out = []
    for d, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - least + 1 if d is not None else 0):
            if holder[x[i : i + least]] < d:
                gone[i : i + least] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(x) else 0
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, least=50):
    out = sx.repeated_passages(df, least=least)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def odd_rows(seed=1, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(r.choice([8, 12, 15, 30, 90])) for _ in range(12)] + ["x" * 49, "y" * 50, "z" * 51, "ab" * 60, "é" * 70]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(shared) if r.random() < 0.6 else text(r.randint(1, 30))
            if r.random() < 0.3:  # a part of a passage, from any place
                p = p[r.randint(0, len(p) // 2):]
            parts.append(p)
        rows.append((r.choice([i, i * 3, i - 90]), r.choice(["", " ", "\n"]).join(parts)))
    rows += [(7, None), (None, shared[8]), (None, shared[8]), (2_000, rows[3][1]), (2_001, rows[3][1]), rows[5], rows[5], (9**17, shared[11])]
    rows += [(5_000, text(4_000) + shared[7]), (5_001, shared[7] + text(4_000))]
    return rows


@pytest.mark.parametrize("least", [16, 50])
def test_equals_brute_force_on_odd_rows(spark, least):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("sha", F.lit("x")).withColumn("block", F.lit(1)).repartition(4)
    assert found(df, least) == brute(rows, least)


def test_many_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sx, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(sx, "BUCKET_KEYS", 200)
    monkeypatch.setattr(sx, "WIDE_FROM", 1)
    rows = odd_rows(4, 200)
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows, 50)


def test_suffix_buckets_and_long_ties(monkeypatch):
    monkeypatch.setattr(sx, "SUFFIX_BUCKET", 50)
    r = random.Random(2)
    for least in (16, 33, 50, 64, 150):
        unit = bytes(r.choice(b"ab") for _ in range(70))
        raw = b"".join(r.choice([unit, unit[3:50], bytes(r.choice(b"abc") for _ in range(40)), b"q" * 80]) for _ in range(60))
        at = np.array(sorted(r.sample(range(len(raw) - least), 1_500)))
        first = {}
        want = [first.setdefault(raw[p : p + least], p) for p in at.tolist()]
        assert sx.class_holders(np.frombuffer(raw, np.uint8), at, least).tolist() == want


def test_covers_hold_every_difference():
    for period, cover in sx.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_packed_keys_round_trip():
    r = np.random.default_rng(0)
    for n, top in [(0, 10), (1, 2**64 - 1), (1000, 2**40), (1000, 2**55), (5, 2**64 - 1)]:
        keys = np.sort(r.integers(0, top, n, dtype=np.uint64))
        assert (sx.unpack(sx.pack(keys)) == keys).all()
    some = [np.array([], int), np.array([-5, 9**17, 3]), np.arange(300) * 7, np.array([1, 200, -60_000])]
    assert [x.tolist() for x in sx.read_arrays(sx.arrays(*some))] == [x.tolist() for x in some]
    for below, n in [(1 << 20, 0), (1 << 20, 1), (1 << 20, 2), (1 << 20, 7), (1 << 25, 0), (1 << 25, 5)]:
        values = r.integers(0, below, n)
        assert (sx.read_numbers(sx.numbers(values, below)) == values).all()


def test_empty_tables(spark):
    assert sx.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0
    assert found(spark.createDataFrame([(None, None), (1, "")], DOCS)) == brute([(None, None), (1, "")], 50)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("octet_length(text) < 3000")
    assert found(df) == brute([tuple(r) for r in df.collect()], 50)
