"""The llm operators against brute force, round trips, and odd rows."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hostscope.llm import ann, common, decontam, langid, licenses, mixing, ngram_join, pii, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(common.WORD, (text or "").translate(LOWER))


def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "en", "a", 1), (2, long + " x", "en", "a", 1), (3, None, None, None, None), (4, "", "de", "b", 0),
            (None, "one two three", "en", "a", 5), (5, "one two three", "en", "a", 5), (5, "one two three", "en", "a", 5),
            (6, "   \n\t ", "fr", None, 3), (7, "Solo", None, "c", 4), (8, "ONE two three", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("class", F.lit("x")).withColumn("key", F.lit(1)).withColumn("copies", F.lit("y"))


def brute_components(rows, width, num, den):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width,threshold", [(4, (85, 100)), (5, (80, 100))])
def test_join_equals_brute_force(spark, width, threshold):
    base = [f"t{i}" for i in range(400)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):  # chains and stars of near copies of many sizes
        n = [6, 9, 14, 25, 60, 200][i % 6]
        w = base[(i % 5) * 7:(i % 5) * 7 + n]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = f"z{int(rng.integers(0, 40))}"
        rows.append((i, " ".join(w)))
    rows += [(900, ""), (901, None), (902, "a b"), (903, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width=width, threshold=threshold).collect()}
    assert got == brute_components(rows, width, *threshold)


def test_join_with_large_buckets(spark, monkeypatch):
    """A group larger than the blocks, whose members share one long passage."""
    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"q{i // 2}_{j}" for j in range(i % 3 * 6))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width=5).collect()}
    assert got == brute_components(rows, 5, 80, 100)


def test_finer_histogram_never_parts_linked_sets():
    """Exact distance against the histogram's, across the sizes where its bins double."""
    rng = np.random.default_rng(3)
    linked = parted = 0
    for n in (2_040, 2_060, 4_090, 4_100, 9_000):
        for share in (0.0, 0.5, 0.8, 0.89, 0.9, 0.95, 1.0):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) * np.uint64(2))
            both = a[: int(n * share)]
            b = np.unique(np.concatenate([both, rng.integers(0, 2**62, n - len(both), dtype=np.int64).view(np.uint64)]))
            fine = [ngram_join._fine_bins(x) for x in (a, b)]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([1]), pa.array([2]), pa.array([1]), pa.array([len(a)]), pa.array([len(b)]),
                 pa.array([fine[0]], pa.binary()), pa.array([fine[1]], pa.binary())],
                names=["a", "b", "n", "na", "nb", "fa", "fb"])
            passes = next(ngram_join._filter_fine(80, 100)(iter([batch]))).num_rows == 1
            same = len(np.intersect1d(a, b))
            if same * 100 >= 80 * (len(a) + len(b) - same):
                linked += 1
                assert passes
            elif None not in fine and share <= 0.5:
                parted += not passes
    assert linked >= 10 and parted >= 6


def test_join_of_long_texts(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(1_500)]
    rows = []
    for i in range(12):
        own = [f"u{i // 3}_{x}" for x in rng.permutation(2_700)] if i % 3 == 0 else own
        extra = [f"e{i}_{j}" for j in range((i % 3) * 160)]
        rows.append((i, " ".join(passage + own + extra)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width=5).collect()}
    assert got == brute_components(rows, 5, 80, 100)


def test_join_odd_rows(spark):
    out = ngram_join.ngram_components(odd_docs(spark), width=4, threshold=(85, 100)).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None)
    assert got == [(1, 29997, 1), (2, 29998, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (6, 0, 6), (7, 1, 7), (8, 1, 5)]
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(1, None)]
    assert ngram_join.ngram_components(odd_docs(spark).limit(0)).count() == 0
    kept = ngram_join.keep_one_per_group(odd_docs(spark))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, None])
    assert kept.columns == odd_docs(spark).columns


def test_scheme_keeps_every_linked_pair():
    scheme = ngram_join.Scheme(85, 100)
    rng = np.random.default_rng(1)
    for n in (6, 7, 12, 22, 23, 40, 150, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
            drop = int(rng.integers(0, len(a) * 15 // 100 + 1))
            b = np.unique(a[drop:])
            if len(b) * 100 < 85 * len(a):
                continue
            kept = []
            for s in (a, b):
                mine = set()
                for k, keep in scheme.all_keys(s):
                    mine.update(np.sort(k)[:keep].tolist())
                kept.append(mine)
            assert len(a) == len(b) or kept[0] & kept[1]


def test_keys_of_empty_segments_are_left_out():
    """Unrelated texts meet in no bucket, though every one has segments without a shingle
    and no list tells which keys are frequent; a near copy meets its original."""
    scheme, rng = ngram_join.Scheme(80, 100), np.random.default_rng(7)
    texts = [[f"w{x}" for x in rng.integers(0, 10**9, n)] for n in range(300, 460, 4)]
    texts += [[*t[:-8], "other", "end"] for t in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": [" ".join(t) for t in texts]})
    label = [ngram_join._set_class(s) for _, s in ngram_join._shingle_sets(batch, 5)]
    assert any((k >= ngram_join.EMPTY).any() for _, s in ngram_join._shingle_sets(batch, 5) for k, _ in scheme.all_keys(s))
    none = np.zeros(0, np.int64)
    met = {(r["a"], r["b"]) for out in ngram_join._emit_keys(5, scheme, none.view(np.uint64), none)([batch])
           for r in out.to_pylist() if r["b"] is not None}
    assert met == {(min(p), max(p)) for p in zip(label[:40], label[40:])}
    # nor do they take places in the list of frequent keys
    unrelated = batch.slice(0, 40)
    assert not [r for out in ngram_join._describe(5, scheme)([unrelated]) for r in out.to_pylist() if r["kind"] == 1]


def test_mix(spark):
    docs = common.table(spark, SF, "documents")
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == docs.count() and plan.copies.between(0, 3).all()
    by = plan.assign(taken=plan["size"] * plan.copies).groupby("source", dropna=False).agg(
        taken=("taken", "sum"), target=("target", "first"), mass=("size", "sum"), least=("size", "min"))
    assert abs(by.target.sum() - by.mass.sum()) < 1e-6 * by.mass.sum() and (by.target <= 3 * by.mass + 1e-6).all()
    assert ((by.taken - by.target).abs() <= np.maximum(0.02 * by.target, by.least + 1)).all()
    assert plan.equals(mixing.mix_plan(docs).toPandas()) or sorted(map(tuple, plan.values)) == sorted(
        map(tuple, mixing.mix_plan(docs).toPandas().values))


def test_mix_rates_solve_the_dual(spark):
    """Every source's rates against bisection over its single documents."""
    plan = mixing.mix_plan(common.table(spark, SF, "documents")).toPandas()
    tilted = 0
    for _, rows in plan.groupby("source", dropna=False):
        size, target, rate = rows["size"].to_numpy(float), rows.target.iloc[0], rows.rate.to_numpy()
        some = size > 0
        assert (rate[~some] == 0).all()
        size, rate = size[some], rate[some]
        if target >= 3 * size.sum() * (1 - 1e-12):
            assert (rate == 3).all()
            continue
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lam = (lo + hi) / 2
            taken = (size * np.minimum(3, np.exp(np.minimum(lam * size, 700)))).sum()
            lo, hi = (lam, hi) if taken < target else (lo, lam)
        assert rate == pytest.approx(np.minimum(3, np.exp(np.minimum(lo * size, 700))), rel=1e-6, abs=1e-9)
        tilted += len(set(rate)) > 2
    assert tilted


def test_mix_targets_equal_repeated_resharing(spark):
    masses = {"a": 10.0, "b": 1000.0, "c": 5.0, "d": 300.0, "e": 0.0, None: 40.0}
    order = sorted(k for k in masses if k is not None) + [None]
    weight = {k: (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(order)}
    target, full, total = {}, set(), sum(masses.values())
    while True:
        rest = total - sum(3 * masses[k] for k in full)
        share = sum(weight[k] for k in masses if k not in full)
        target = {k: 3 * masses[k] if k in full else rest * weight[k] / share for k in masses}
        more = {k for k in masses if k not in full and target[k] > 3 * masses[k] + 1e-9}
        if not more:
            break
        full |= more
    df = spark.createDataFrame([(k, v) for k, v in masses.items()], "grp string, mass double")
    got = {r.grp: r.target for r in mixing.capped_targets(mixing.cyclic_weights(df)).collect()}
    assert got == pytest.approx(target)


def test_mix_odd_rows(spark):
    plan = mixing.mix_plan(odd_docs(spark))
    assert plan.count() == 10 and mixing.mix_plan(odd_docs(spark).limit(0)).count() == 0
    out = mixing.mix_documents(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns and out.where("copies < 1 or copies > 3").count() == 0


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 4
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            best = sorted({(-float(ann.cosine(q, v[None])[0]), j) for j, v in ok if j != i})
            out[i] = [j for _, j in best[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype("f4").tolist()) for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300, 340)]  # copies: ties to the smaller id
    rows += [(1000, None), (1050, [0.0] * 4), (1100, [float("nan"), 1.0, 1.0, 1.0]), (1150, [1.0, None, 1.0, 1.0]), (None, [1.0] * 4),
             (1200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(0)).withColumn("id", F.lit(0))
    got = defaultdict(list)
    for r in ann.nearest(df, every=10, cell_rows=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    want = brute_nearest(rows, 5, 10)
    assert set(got) == set(want) and got[300] == [301, 302, 303, 304, 305] and got[310] == [300, 301, 302, 303, 304]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    few = ann.nearest(df.where("vec_id in (0, 1)"), every=10).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "Some words.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "licensed  under CC-BY NC 4.0"),
            (3, "This is the GNU story about a license in general."), (4, None), (5, ""), (6, "MIT"),
            (7, "x\n\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not\n"
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.lit(1))
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df).collect()}
    assert got == {1: "Apache-2.0", 2: "CC-BY-NC-4.0", 3: None, 4: None, 5: None, 6: None, 7: "MPL-2.0"}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_masks_survive_two_substitutions():
    for lost in itertools.combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(
            all(bit == "0" or at + j not in lost for j, bit in enumerate(mask))
            for mask in decontam.MASKS for at in range(decontam.WINDOW - len(mask) + 1))


def test_masks_see_short_items():
    """Whatever word of an item of 7 to 12 words is replaced, or none of a shorter
    one, the item is found; with one more replaced it is not."""
    for n in range(1, 13):
        words = [f"w{j}" for j in range(n)]
        index = decontam.SeedIndex([(1, " ".join(words))])

        def found(lost):
            text = " ".join(["before", *("other" if j in lost else w for j, w in enumerate(words)), "after"])
            hashes, _ = common.word_hashes(*common.text_bytes(pa.array([text])), common.IS_PUNCTUATION)
            return index.hits(hashes) == {1: n - len(lost)}

        allowed = decontam.SUBSTITUTIONS * n // decontam.WINDOW
        assert all(found(lost) for lost in itertools.combinations(range(n), allowed))
        assert not any(found(lost) for lost in itertools.combinations(range(n), allowed + 1))


def test_decontamination(spark, monkeypatch):
    item = [f"i{j}" for j in range(20)]
    changed = item[:]
    changed[4] = changed[9] = changed[15] = "other"
    noise = " ".join(f"n{j}" for j in range(5000))
    rows = [(1, noise + " " + " ".join(item) + "! " + noise), (2, " ".join(changed)), (3, " ".join(item[:12])), (4, noise), (5, None),
            (6, ""), (7, ", ".join(item).upper()), (8, " ".join(item[::-1])), (8, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))
    bench = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, None), (12, ""), (None, "x y z"), (13, "too short")],
                                  "item_id long, text string")
    want = [(1, [10]), (2, [10]), (3, []), (4, []), (5, []), (6, []), (7, [10]), (8, []), (8, [10])]
    for words_per_block in (decontam.BLOCK_WORDS, 10):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", words_per_block)
        got = [(r.doc_id, list(r.item_ids)) for r in decontam.contamination(docs, bench).collect()]
        assert sorted(got) == sorted(want)
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_warc_round_trip(spark, tmp_dir):
    big = "<p>" + "é" * 70_000 + "\x1f\x8b\x08</p>"
    rows = [(1, "http://a/ b", "x" * 100), (2, None, "x" * 100), (3, "http://c", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", big), (None, "u", big), (7, "u", ""), (2, None, "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    got = Counter(tuple(r) for r in warc.archive_pages(pages).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        again = len(b) >= 100 and i != first
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert got == want
    records = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    manifest = warc.write_archives(records, f"file://{tmp_dir}/w")
    whole = Counter(tuple(r) for r in warc.read_archives(manifest).collect())
    for split in (37, 1000):  # any split gives each record once, undamaged
        assert Counter(tuple(r) for r in warc.read_archives(manifest, split_bytes=split).collect()) == whole
    assert not any(k[-1] for k in whole) and sum(whole.values()) == len(rows)
    assert warc.read_archives(warc.find_archives(spark, f"file://{tmp_dir}/w")).count() == len(rows)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [(1, "http://x.NET/a"), (2, "https://example.net/en/1?q"), (3, "http://a.example.com/de/#f"), (4, "ftp://b.org/fr/x"),
            (5, "http://b.org/de/"), (6, None), (7, "no scheme"), (8, "http://"), (9, "http://net"), (10, "http://notnet/"), (11, "HTTP://Q.Net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urlfilter.judge_urls(df, ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]).collect()}
    assert {i: r.rule for i, r in got.items()} == {
        1: "net/", 2: "example.net/en/", 3: "example.com/de/", 4: "org/fr/", 5: None, 6: None, 7: None, 8: None, 9: None, 10: None, 11: "net/"}
    assert got[1].verdict == got[3].verdict == "block" and got[2].verdict == got[4].verdict == "allow"
    assert (got[2].host, got[2].path, got[9].path, got[6].host, got[7].path) == ("example.net", "/en/1", "", "", "")
    assert urlfilter.judge_urls(df.limit(0), ["net/"], []).count() == 0


def test_url_trees_learn_the_rules(spark):
    rows = [(i, f"https://h{i}.bad.example/{'a-' * 9}{i}?x=1&y=2&utm_source=z" if i % 2 else f"http://h{i}.good.example/a/{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    asked = df.where("page_id < 100").unionByName(df.where("page_id >= 100").withColumn(
        "url", F.regexp_replace("url", r"\.example", ".test")))
    out = urlfilter.judge_urls(asked, ["bad.example/"], ["good.example/"]).where("rule IS NULL").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in out) >= 0.95 * len(out)


@pytest.mark.parametrize("inside", [300, 4])
def test_every_link_is_counted(spark, monkeypatch, inside):
    monkeypatch.setattr(ngram_join, "INSIDE", inside)
    rng = np.random.default_rng(9)
    texts = []
    for group, (copies, edits) in enumerate([(3, 1), (12, 1), (14, 5), (2, 1), (1, 0)]):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(copies):
            w = list(base)
            for at in rng.choice(np.arange(0, 120, 6), edits, replace=False):
                w[at] = f"x{int(rng.integers(0, 10**9))}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(100, texts[0]), (101, ""), (101, None), (None, texts[1]), (2, texts[2])]
    sets = {i: frozenset(zip(*(words(t)[k:] for k in range(4)))) for i, t in rows if i is not None and t}
    classes = set(sets.values())
    want = {i: sum(x != y and 85 * len(x | y) <= 100 * len(x & y) for y in classes) for i, x in sets.items()}
    assert [want[i] for i in range(3)] == [2, 2, 2] and want[100] == 2
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=4, threshold=(85, 100))
    got = got.collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_links) for r in got if r.doc_id in want} == set(want.items())
    assert all(r.n_links == 0 for r in got if r.doc_id not in want)


def test_pseudonyms(spark):
    texts = ["card 4845168114407329, 4111 1111 1111 1111 and 4868701055796358", "+1 (183) 555-1276 and 212-555-1000", "10.0.0.1 999.1.1.1 v1.2.3",
             "2024-02-29 2023-02-30 31/12/1999", "123-45-6789 666-12-1234", "Mail a.b@c.example.com. Mail a.b@c.example.com!", None, "", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("old"))
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k", count_col="n").collect()}
    assert [out[i].n for i in range(9)] == [2, 2, 1, 2, 1, 2, 0, 0, 0]
    for i, (old, new) in enumerate((t, out[i].text) for i, t in enumerate(texts)):
        if i != 5 and old:
            assert re.sub("[0-9]", "0", old) == re.sub("[0-9]", "0", new) or i == 2
    assert "4868701055796358" in out[0].text and "999.1.1.1 v1.2.3" in out[2].text and "2023-02-30" in out[3].text and "666-12-1234" in out[4].text
    assert len(set(re.findall(r"\S+@example.invalid", out[5].text))) == 1
    assert (out[6].text, out[7].text, out[8].text) == (None, "", "nothing")


def test_pseudonyms_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    cases = [(f"{card} 123", card, 1), ("4111111111111111 12/25", "4111111111111111", 1), ("order 7 4845168114407329", "4845168114407329", 1),
             ("4111111111111111 555-123-4567", "4111111111111111", 2), (f"1234 {card}", card, 1), (f"{card} 4845168114407329", card, 2),
             ("(555-123-4567)", "555-123-4567", 1), ("tel.555-123-4567", "555-123-4567", 1), ("(555) 123-4567", "555) 123-4567", 1),
             ("2024-02-29 4111111111111111", "4111111111111111", 2), ("4111111111111112 12", "\0", 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k", count_col="n").collect()}
    for i, (text, value, n) in enumerate(cases):
        assert out[i].n == n and value not in out[i].text, text
        assert re.sub("[0-9]", "0", out[i].text) == re.sub("[0-9]", "0", text)
    # equal cards get equal pseudonyms whatever stands beside them
    one = out[0].text[:19].replace(" ", "")
    assert out[0].text == f"{out[0].text[:19]} 123" and out[1].text == f"{one} 12/25" and out[3].text.startswith(one)
    assert out[2].text.startswith("order 7 ") and out[10].text == cases[10][0]


def test_feistel_is_a_permutation(spark):
    x = spark.range(189 * 773).select(pii.feistel(F.col("id"), F.lit(189), F.lit(773), "k", "date").alias("x"))
    assert tuple(x.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()) == (146_097, 0, 146_096)


def test_dates_get_distinct_pseudonyms(spark):
    days = spark.range(146_097).select(F.expr("date_add(date'1800-01-01', cast(id as int))").alias("d"))
    late = days.where("day(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("text"))
    both = late.unionByName(days.where("day(d) <= 2").select(F.date_format("d", "dd/MM/yyyy").alias("text")))
    got = both.withColumn("new", pii._date(F.col("text"), "k"))
    n = both.count()
    assert late.count() == pii.LATE_DAYS and got.select("new").distinct().count() == n
    assert got.where("new = text").count() < n / 1000
    assert got.where(F.col("text").rlike("^[0-9]{2}/(1[3-9]|[23])") != F.col("new").rlike("^[0-9]{2}/(1[3-9]|[23])")).count() == 0


def test_key_is_required(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([("x",)], "text string"), "")
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) >= 16
    df = spark.createDataFrame([("4111 1111 1111 1111",)] * 2, "text string")
    one, two = (pii.pseudonymise(df, k).distinct().collect() for k in ("a", "b"))
    assert len(one) == len(two) == 1 and one != two
    assert pii.pseudonymise(df.limit(0), "a").count() == 0
    long = " ".join(["word"] * 50_000 + ["10.0.0.1"])
    out = pii.pseudonymise(spark.createDataFrame([(long,)], "text string"), "a").first().text
    assert out.startswith("word word") and not out.endswith(" 10.0.0.1") and out.count(".") == 3


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{int(x)}" for x in rng.zipf(1.5, 60) % 500]
        bad = i % 5 == 0
        for j in range(4 * bad):
            w[int(rng.integers(0, 60))] = f"slur{int(rng.integers(0, 6))}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "slur1 slur2")], "doc_id long, text string").withColumn("label", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None), (9001, 0)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, lab).collect()
    held = [r for r in out if r.held_out and r.doc_id < 600]
    assert sum((r.predicted == 1) == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held) and len(out) == 603
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in out if r.doc_id in (9000, 9001))
    assert toxicity.score_documents(docs, lab.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.drop_toxic(docs, docs, lab).columns == docs.columns


def test_toxicity_counts_all_labels(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        w = [f"w{int(x)}" for x in rng.zipf(1.5, 60) % 500]
        for j in range(4 * (i % 15 == 0)):
            w[int(rng.integers(0, 60))] = f"slur{int(rng.integers(0, 6))}"
        rows.append((i, " ".join(w), int(i % 15 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    # a bound on the rows of the regression is none on the counts: no toxic label in 15 may go
    model = toxicity.learn(docs, docs, max_rows=45)
    x = model.features(pa.array([t for _, t, _ in rows]))
    held = {r.doc_id for r in docs.where(common.held_out(F.col("doc_id"))).collect()}
    mean = {bad: np.mean([x[i, 1] for i, _, b in rows if i in held and b == bad]) for bad in (0, 1)}
    assert mean[1] > 1.5 and mean[0] < 0.5
    # counts that are too many to broadcast stay Spark tables, with the same scores
    near = lambda: {r.doc_id: r.score for r in toxicity.score_documents(docs, docs).collect()}
    kept = lambda: {r.doc_id for r in toxicity.drop_toxic(docs, docs, docs).collect()}
    odd = docs.unionByName(spark.createDataFrame([(9000, None, None), (9001, "", None), (9001, "", None)], docs.schema))
    one, few = near(), kept()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    two = near()
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-5 and few == kept() and 0 < len(few) < 900
    assert toxicity.score_documents(odd, docs).count() == 903


def brute_evidence(texts, labels):
    """Evidence of every pair of words (None before the first) of class-conditional
    Kneser-Ney models, from dictionaries of counts."""
    n = [Counter(), Counter()]
    for text, label in zip(texts, labels):
        n[label].update({(v, w) for v, w in zip([None, *words(text)], words(text))})

    def discounted(counts):
        m = Counter(counts.values())
        y = m[1] / (m[1] + 2 * m[2])
        d = {j: min(max(j - (j + 1) * y * m[j + 1] / m[j], 0.05), j) for j in (1, 2, 3)}
        return {k: x - d[min(x, 3)] for k, x in counts.items()}

    pairs = set(n[0]) | set(n[1])
    before = Counter(w for _, w in pairs)
    c = [Counter(w for _, w in x) for x in n]
    dc, dn = [discounted(x) for x in c], [discounted(x) for x in n]
    less = [labels.count(k) / min(labels.count(0), labels.count(1)) for k in (0, 1)]
    taken = lambda d, x: 1 - sum(sum(y.values()) for y in d) / sum(sum(y.values()) for y in x)
    g = taken(dc, c)

    def one(k, w):
        shared = (before[w] + 0.5) / (len(pairs) + 0.5 * len(before) + 0.5)
        return (1 - g) * dc[k].get(w, 0) / sum(dc[k].values()) + g * shared

    of = lambda x, v: {p: y for p, y in x.items() if p[0] == v}
    out = {}
    for v in {v for v, _ in pairs}:
        seen, left = [of(x, v) for x in n], [of(x, v) for x in dn]
        g_v = max(taken(left, seen), 0.05)
        for w in {w for u, w in pairs if u == v}:
            alone = math.log(one(1, w) / one(0, w))
            two = [(1 - g_v) * left[k].get((v, w), 0) / sum(left[k].values()) + g_v * one(k, w) if left[k] else one(k, w) for k in (0, 1)]
            often = [sum(x[w] / s for x, s in zip(c, less)), sum(x[v, w] / s for x, s in zip(n, less))]
            clip = lambda x, most: min(max(x, -most), most)
            more = clip(math.log(two[1] / two[0]) - alone, 3) * often[1] / (often[1] + toxicity.PAIR_SIGHTS)
            out[v, w] = clip(alone * often[0] / (often[0] + toxicity.WORD_SIGHTS), 3), clip(more, 0.5)
    return out


def test_toxicity_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 30) % 200) + (" bad word" if i % 4 == 0 else " fair word") for i in range(400)]
    labels = [int(i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame(list(zip(range(400), texts, labels)), "doc_id long, text string, toxic int")
    kept = sorted(r.doc_id for r in docs.where(~common.held_out(F.col("doc_id"))).collect())
    want = brute_evidence([texts[i] for i in kept], [labels[i] for i in kept])
    model = toxicity.learn(docs, docs)
    for text in [texts[i] for i in kept]:
        hashes, at = common.word_hashes(*common.text_bytes(pa.array([text])), common.IS_PUNCTUATION)
        got = model.ratios(hashes, at)
        parts = [want[p] for p in zip([None, *words(text)], words(text))]
        assert len(got) == len(parts)
        # both parts are kept in steps
        assert all(abs(r - max(min(a + b, 3), -3)) <= 0.5 / 16 + 0.5 / 8 + 1e-5 for r, (a, b) in zip(got, parts))
    assert max(a for a, _ in want.values()) > 1 and max(abs(b) for _, b in want.values()) > 0.1


def test_discounts_are_estimated():
    assert toxicity.discounts(10, 4, 2, 1) == pytest.approx([1 - 2 * (10 / 18) * 0.4, 2 - 3 * (10 / 18) * 0.5, 3 - 4 * (10 / 18) * 0.5])
    assert toxicity.discounts(0, 0, 0, 0) == [0.5, 0.5, 0.5]


def test_language(spark):
    docs = common.table(spark, SF, "documents")
    got = langid.detect_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = langid.detect_languages(odd_docs(spark)).collect()
    assert len(odd) == 10 and {r.lang_pred for r in odd if r.doc_id in (3, 4, 6)} == {"und"}
    assert langid.detect_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.detect_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_keeps_clean_documents_and_columns(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "mix_sources"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, seen, SF), name)
        assert out.columns == docs.columns and 0.7 * seen.count() <= out.count() <= seen.count()
        seen = out
    parts = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    groups = [parts[r.doc_id][1] for r in seen.where("length(text) > 0").collect()]
    assert len(groups) == len(set(groups))
    assert seen.where(F.col("text").rlike(r"@mail[0-9]")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.where("copies < 1 or copies > 3").count() == 0


def test_toxicity_words_and_contexts_by_broadcast_or_shuffle(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 12)) + (" vile scum" if i % 3 == 0 else " kind words")) for i in range(240)]
    rows += [(None, "vile scum"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    sides = []
    joinable = common.Scratch.joinable

    def seen(self, df, name, *most):
        out = joinable(self, df, name, *most)
        sides.append((name, "broadcast" in out._jdf.queryExecution().logical().toString().lower()))
        return out

    monkeypatch.setattr(common.Scratch, "joinable", seen)
    got = []
    for most in (toxicity.JOIN_ROWS, 10):
        monkeypatch.setattr(toxicity, "JOIN_ROWS", most)
        sides.clear()
        got.append(sorted(map(tuple, toxicity.score_documents(docs, labels).collect()), key=str))
        assert {hinted for name, hinted in sides if name.endswith("of_pairs")} == {most > 10}
    assert got[0] == got[1] and len({r[2] for r in got[0]}) > 2
    assert toxicity.JOIN_ROWS < common.BROADCAST_ROWS


def test_evidence_is_collected_as_keys_and_steps(spark):
    """9 bytes a row pass the driver, and the ratios are those of the evidence."""
    T = toxicity

    v, w = [5, -7, 2**62], [11, -13, 17]
    words = spark.createDataFrame(list(zip(w, [0.0625, -3.0, 2.5])), "w long, r float")
    pairs = spark.createDataFrame(list(zip(v, w, [0.5, -0.125, 0.25])), "v long, w long, r float")
    model = T.Model((words, pairs))
    model.gather()
    assert [t.rows.dtype for t in model.tables] == [np.int8, np.int8]
    key = np.array(w, np.int64).view(np.uint64)
    both = common.mix64(np.array(v, np.int64).view(np.uint64) * T._PAIR + key)
    assert (model.tables[0][key][:, 0] / T.WORD_STEPS).tolist() == [0.0625, -3.0, 2.5]
    assert (model.tables[1][both][:, 0] / T.PAIR_STEPS).tolist() == [0.5, -0.125, 0.25]
    assert model.ratios(key, np.array([0, 3])).tolist() == [0.0625, -3.0, 2.5]


def test_large_evidence_is_read_in_parts_without_a_shuffle_of_texts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(500):
        w = [f"w{int(x)}" for x in rng.zipf(1.5, 40) % 300]
        for _ in range(4 * (i % 6 == 0)):
            w[int(rng.integers(0, 40))] = f"slur{int(rng.integers(0, 6))}"
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    rows += [(7, rows[7][1], rows[7][2]), (None, "slur1 slur2", None), (9000, None, None), (9001, "", None), (9002, "slur1 w1 " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = toxicity.learn(docs, docs)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    dealt = toxicity.learn(docs, docs)
    assert dealt.weights.tolist() == whole.weights.tolist() and max(len(t.shared) for t in dealt.tables) > 2
    texts = [pa.array([t for _, t, _ in rows[i : i + 90]]) for i in range(0, len(rows), 90)] + [pa.array([], pa.string())]
    want = [whole.features(t).tolist() for t in texts]
    for words in (0, 700, toxicity.ROUND_WORDS):  # a group of texts at once, some, all of a task
        monkeypatch.setattr(toxicity, "ROUND_WORDS", words)
        assert [x.tolist() for x in dealt.features_of(iter(texts))] == want
    got = []
    for model in (whole, dealt):
        monkeypatch.setattr(toxicity, "learn", lambda *a, m=model: m)
        outs = toxicity.score_documents(docs, docs), toxicity.drop_toxic(docs, docs, docs)
        got.append([sorted(map(tuple, out.collect()), key=str) for out in outs])
        plans = [out._jdf.queryExecution().executedPlan().toString() for out in outs]
        assert not any(node in plan for plan in plans for node in ("Exchange", "Join"))
    assert got[0] == got[1] and len({r[2] for r in got[0][0]}) > 100 and 0 < len(got[0][1]) < len(rows) == len(got[0][0])


def test_parts_find_what_a_table_finds():
    rng = np.random.default_rng(9)
    key = np.unique(common.mix64(rng.integers(0, 1 << 62, 5000).astype(np.uint64)))
    step = rng.integers(-4, 5, len(key)).astype(np.int8)
    asked = np.concatenate([key[::3], common.mix64(np.arange(700, dtype=np.uint64)), np.array([0, 2**64 - 1], np.uint64), key[:9]])
    rng.shuffle(asked)
    whole = toxicity.Table(key, step.reshape(-1, 1))[asked]

    class Held:
        def __init__(self, value):
            self.value = value

    for bits in (0, 1, 4, 13):  # with more parts than keys some are empty
        which = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
        parts = toxicity.Parts([Held((key[which == i], step[which == i])) for i in range(1 << bits)])
        assert (parts[asked] == whole).all() and (parts[asked[:0]].shape == (0, 1))
