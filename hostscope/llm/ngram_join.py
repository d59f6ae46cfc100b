"""N-gram Jaccard self-join by universe partitioning and the pigeonhole rule.

A document is the set of its distinct word shingles (64-bit hashes).  Sets are
put into size bands.  In a band, the universe of shingles is hashed into ``m``
segments; two sets that reach the threshold differ in at most ``H`` shingles, so
they agree exactly on at least ``m - H`` segments.  A set's key for a segment is
the hash of its subset there.

Allocation.  Bands with few differences to allow (``H <= DELETION_H``) use
``ceil((H + 1) / 2)`` segments and index each segment subset plus its
one-deletion neighbourhood: two sets must agree on a segment up to one shingle,
so one of them has a key of the other.  All other bands use ``m = H + 1 + spare``
exact keys, and every set keeps only its ``H + 1`` cheapest ones, by the order
(empty segment, times a frequent key was seen, key).  The cheapest segment on which
two sets agree has at most ``H`` cheaper keys in either set, so both keep it: leaving
the dear keys out loses no pair.  An empty segment's key, which all sets of a band
share that have nothing there, is told by its top bit; there are as many as segments
of all bands, so they have no place in the list.  The costs come from a bounded list
of frequent keys; they only choose among valid allocations, never whether a pair is
found.

Verification.  Equal sets become one class first (by their 64-bit set hash,
which includes the size).  Every bucket of a key pairs its classes with the
smallest one; of its pairs every class has one verified, exactly on the shingle
sets: a linear number.
Where a bucket still spans several components, its remaining pairs across
components are met with a sound filter (the difference of two bin histograms
never exceeds the difference of the sets; long sets have a second, finer
histogram, so that the filter is as sharp for them), and what passes is verified
exactly.  Pairs of small buckets are joined.  Large buckets are compared in blocks
of ``BLOCK`` classes, each pair under the least bucket key it shares: a first pass
names the classes that pass the filter with any class of another component, a second one has their exact sets and returns only
links that join components.  So no link between components is lost, while a group
of thousands of near copies costs one pass instead of all its pairs, and the rows
that leave a block are at most those of its classes.

Number of links.  Links lie inside components, so where not every pair of a
component is a verified link already, all its pairs are compared once, in blocks of
``INSIDE`` classes, by sizes, histogram and exact sets; only the counts leave a block.

Shingles and words are compared by 64-bit hashes, the only approximation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C
from hostscope.llm.components import components

GROWTH = 1.5  # size ratio of neighbouring bands
DELETION_H = 3  # differences up to which the one-deletion neighbourhood is used
SPARE = 0.1  # segments beyond H + 1, as a share of H
FREQUENT_TASK, FREQUENT_ALL = 2_048, 65_536  # frequent keys kept: a task, in all
BIN_BITS = 8
BINS = 1 << BIN_BITS  # histogram bins of the filter
FINE_SHARE = 8  # shingles a bin of the finer histogram, for sets of more than FINE_SHARE * BINS
FEW = 64  # classes of a bucket up to which its pairs are joined directly
BLOCK = 1_000  # classes that are compared with each other at once
INSIDE = 300  # classes whose exact sets are compared with each other at once
INSIDE_SHINGLES = 1_000_000  # and their shingles
CROSS, CROSS_SHINGLES = 2_000, 4_000_000  # the same for links that join components: fewer, larger blocks
FLUSH = 4_000_000  # keys a task holds before it sends them on
_U = np.uint64
EMPTY = _U(1 << 63)  # set in the keys of empty segments that a set may leave out


class Scheme:
    """Bands, segments and keys for one threshold num / den."""

    def __init__(self, num: int, den: int):
        if not 0.68 < num / den <= 1:
            raise ValueError("the threshold must lie above 0.68 and be at most 1")
        self.num, self.den = num, den
        self.low = [1]

    def differences(self, n: int) -> int:
        """Most differences between a set of n and any set that it links to."""
        return (n + n * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def bands(self, n: int) -> list[int]:
        """The set's own band, and the next if a partner may be there."""
        while self.low[-1] <= n * self.den // self.num + 1:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * GROWTH)))
        own = int(np.searchsorted(self.low, n, "right")) - 1
        return [own, own + 1] if n * self.den >= self.low[own + 1] * self.num else [own]

    def keys(self, shingles: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """(all keys of the set under the band's scheme, how many it must keep)."""
        n = len(shingles)
        most, own = self.differences(self.low[band + 1] - 1), self.differences(n)
        salt = C.mix64(np.array([band + 1], _U) * _U(0xD1B54A32D192ED03))[0]
        values = C.mix64(shingles ^ salt)
        if most <= DELETION_H:
            m = (most + 2) // 2
            part = (values % _U(m)).astype(np.int64)
            values = C.mix64(values)
            sums = np.zeros(m, _U)
            np.add.at(sums, part, values)
            raw = np.concatenate([sums, sums[part] - values])
            part = np.concatenate([np.arange(m), part])
            keep, empty = len(raw), np.zeros(len(raw), bool)
        else:
            m = most + 1 + max(1, int(SPARE * most))
            part = (values % _U(m)).astype(np.int64)
            raw = np.zeros(m, _U)
            np.add.at(raw, part, C.mix64(values))
            empty = np.bincount(part, minlength=m) == 0
            part = np.arange(m)
            keep = own + 1
        keys = C.mix64(raw + salt + (part.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        return np.where(empty, keys | EMPTY, keys & ~EMPTY), keep

    def all_keys(self, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        if self.differences(len(shingles)):  # else only equal sets link
            for band in self.bands(len(shingles)):
                yield self.keys(shingles, band)


def _set_class(shingles: np.ndarray) -> int:
    total = C.mix64(shingles ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) + _U(len(shingles))
    return int(C.signed(C.mix64(np.array([total], _U)))[0])


def _shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its shingles) for the rows that have any."""
    buf, offsets = C.text_bytes(batch.column("text"))
    for a, b in C.text_groups(offsets):
        words, at = C.word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i, shingles in enumerate(C.shingle_hashes(words, at, width)):
            if len(shingles):
                yield a + i, shingles


def _merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)
    if len(k) > FREQUENT_TASK * 8:
        top = np.sort(np.argpartition(-n, FREQUENT_TASK * 8)[: FREQUENT_TASK * 8])
        k, n = k[top], n[top]
    return k, n


SETS = "kind int, a long, b long, c long, bins binary, fine binary"


def _fine_bins(shingles: np.ndarray) -> bytes | None:
    """Histogram over a power of two of bins, about FINE_SHARE shingles each and
    counted up to 255; None where the common histogram is as fine."""
    if len(shingles) <= FINE_SHARE * BINS:
        return None
    bits = int(len(shingles) - 1).bit_length() - (FINE_SHARE.bit_length() - 1)
    counts = np.bincount((shingles >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _describe(width: int, scheme: Scheme):
    """Rows of kind 0: doc_id, size, class, histograms; of kind 1: a frequent key
    and its count in this task."""

    def rows(kind, a, b, c, bins, fine):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.array(c, pa.int64()), pa.array(bins, pa.binary()), pa.array(fine, pa.binary())],
            names=["kind", "a", "b", "c", "bins", "fine"],
        )

    def run(batches):
        keys, counts, held, seen = [], [], 0, set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            size, label = [0] * len(ids), [None] * len(ids)
            bins, fine = [None] * len(ids), [None] * len(ids)
            for i, s in _shingle_sets(batch, width):
                size[i], label[i] = len(s), _set_class(s)
                bins[i] = np.bincount((s >> _U(64 - BIN_BITS)).astype(np.int64), minlength=BINS).astype("<u4").tobytes()
                fine[i] = _fine_bins(s)
                if label[i] not in seen:  # copies do not make a key dear
                    if len(seen) < 1_000_000:
                        seen.add(label[i])
                    for k, keep in scheme.all_keys(s):
                        if keep < len(k):
                            k = k[k < EMPTY]
                            keys.append(k)
                            counts.append(np.ones(len(k), np.int64))
                            held += len(k)
            if held > FLUSH // 2:
                k, n = _merge_counts(keys, counts)
                keys, counts, held = [k], [n], len(k)
            yield rows(0, ids, size, label, bins, fine)
        if keys:
            k, n = _merge_counts(keys, counts)
            order = np.argsort(-n, kind="stable")[:FREQUENT_TASK]
            order = order[n[order] >= 3]
            yield rows(1, C.signed(k[order].copy()), n[order], n[order], [None] * len(order), [None] * len(order))

    return run


def _emit_keys(width: int, scheme: Scheme, frequent: np.ndarray, times: np.ndarray):
    """(key, a, b): a bucket's local smallest class a with b null, to be met by
    other tasks under the key; or a member b of a's bucket, which needs no meeting."""

    def costs(keys):
        if not len(frequent):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        return np.where(frequent[at] == keys, times[at], 0)

    def flush(keys, classes):
        k = np.concatenate(keys)
        c = np.repeat(np.array([x for x, _ in classes], np.int64), [n for _, n in classes])
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])  # one row per key and class
        k, c = k[fresh], c[fresh]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        low = c[np.flatnonzero(first)][np.cumsum(first) - 1]
        for a in range(0, len(k), 50_000):
            z = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(C.signed(k[z].copy())), pa.array(low[z]), pa.array(c[z], mask=first[z])],
                names=["key", "a", "b"],
            )

    def run(batches):
        keys, classes, held, seen = [], [], 0, set()
        for batch in batches:
            for _, s in _shingle_sets(batch, width):
                label = _set_class(s)
                if label in seen:
                    continue
                seen.add(label)
                for k, keep in scheme.all_keys(s):
                    if keep < len(k):
                        k = k[np.lexsort((k, costs(k), k >= EMPTY))[:keep]]
                    keys.append(k)
                    classes.append((label, len(k)))
                    held += len(k)
            if held > FLUSH:
                yield from flush(keys, classes)
                keys, classes, held, seen = [], [], 0, set()
        if keys:
            yield from flush(keys, classes)

    return run


def _emit_sets(width: int):
    def run(batches):
        for batch in batches:
            labels, sets = [], []
            for _, s in _shingle_sets(batch, width):
                labels.append(_set_class(s))
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int64()), pa.array(sets, pa.binary())], names=["class", "items"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(both * den >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(nx, bx, ny, by, num: int, den: int):
    """Sound test on sizes and histograms: False only where the sets cannot link."""
    apart = np.abs(bx - by).sum(-1)
    total = nx + ny
    return (np.minimum(nx, ny) * den >= num * np.maximum(nx, ny)) & (
        apart * (den + num) <= total * (den - num))


def _filter_pairs(num: int, den: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, BINS).astype(np.int64)
                        for c in ("ba", "bb")]
                ok = _near(bins[0].sum(1), bins[0], bins[1].sum(1), bins[1], num, den)
                yield batch.select(["a", "b", "n"]).filter(pa.array(ok))

    return run


def _near_fine(na: int, x: bytes | None, nb: int, y: bytes | None, num: int, den: int) -> bool:
    """The same test on the finer histograms; True without two of them."""
    if x is None or y is None:
        return True
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    apart = int(np.abs(x.reshape(n, -1).sum(1) - y.reshape(n, -1).sum(1)).sum())
    return apart * (den + num) <= (na + nb) * (den - num)


def _filter_fine(num: int, den: int):
    def run(batches):
        for batch in batches:
            sides = zip(*(batch.column(c).to_pylist() for c in ("na", "fa", "nb", "fb")))
            yield batch.select(["a", "b", "n"]).filter(pa.array([_near_fine(*s, num, den) for s in sides], pa.bool_()))

    return run


def _near_other(num: int, den: int):
    """(key, class) of the classes of one block pair that pass the filter with a class
    of another component.  Two classes are met under the least key they share."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        earlier, fine = [frozenset(k) for k in pdf["earlier"]], pdf["fine"].tolist()
        bins = np.frombuffer(b"".join(pdf["bins"]), "<u4").reshape(-1, BINS).astype(np.int64)
        size, comp, block = bins.sum(1), pdf["component"].to_numpy(), pdf["block"].to_numpy()
        hit = np.zeros(len(pdf), bool)
        for i, at in _pairs_across(block, int(key[1]), int(key[2]), comp):
            at = at[_near(size[i], bins[i], size[at], bins[at], num, den)]
            at = [j for j in at if earlier[i].isdisjoint(earlier[j])
                  and _near_fine(size[i], fine[i], size[j], fine[j], num, den)]
            hit[at] = True
            hit[i] |= len(at) > 0
        return pd.DataFrame({"key": np.full(int(hit.sum()), key[0]), "class": pdf["class"].to_numpy()[hit]})

    return run


def _pairs_across(block: np.ndarray, one: int, two: int, group: np.ndarray):
    """(i, members that i is to be compared with) in a block pair; ``group`` is read
    anew at every step, so that what was joined meanwhile is left out."""
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    for i in left:
        at = right if one != two else right[right > i]
        at = at[group[at] != group[i]]
        if len(at):
            yield i, at


def _cross_links(num: int, den: int):
    """Links of one block pair that join components, on the exact sets: a spanning
    forest, so at most one row less than there are components."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class")
        sets = [np.frombuffer(x, _U) for x in pdf["items"]]
        size, cls = np.array([len(x) for x in sets]), pdf["class"].to_numpy()
        bins = np.stack([np.bincount((x >> _U(64 - BIN_BITS)).astype(np.int64), minlength=BINS) for x in sets])
        universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids, np.cumsum(size)[:-1])
        group, mark = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1], np.zeros(len(universe), bool)
        a, b = [], []
        for i, at in _pairs_across(pdf["block"].to_numpy(), int(key[1]), int(key[2]), group):
            at = at[_near(size[i], bins[i], size[at], bins[at], num, den)]
            mark[ids[i]] = True
            for j in at:
                if group[j] != group[i]:
                    both = int(np.count_nonzero(mark[ids[j]]))
                    if both * den >= num * (size[i] + size[j] - both):
                        a.append(min(cls[i], cls[j]))
                        b.append(max(cls[i], cls[j]))
                        group[group == group[j]] = group[i]
            mark[ids[i]] = False
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _count_links(num: int, den: int):
    """(class, n): links of the classes of one block pair of a component."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class")
        one, two = int(key[1]), int(key[2])
        sets = [np.frombuffer(x, _U) for x in pdf["items"]]
        size, block = np.array([len(x) for x in sets]), pdf["block"].to_numpy()
        bins = np.stack([np.bincount((x >> _U(64 - BIN_BITS)).astype(np.int64), minlength=BINS) for x in sets])
        universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids, np.cumsum(size)[:-1])
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        mark, n = np.zeros(len(universe), bool), np.zeros(len(sets), np.int64)
        for i in left:
            at = right if one != two else right[right > i]
            at = at[_near(size[i], bins[i], size[at], bins[at], num, den)]
            mark[ids[i]] = True
            both = np.array([np.count_nonzero(mark[ids[j]]) for j in at], np.int64)
            mark[ids[i]] = False
            at = at[both * den >= num * (size[i] + size[at] - both)]
            n[i] += len(at)
            n[at] += 1
        return pd.DataFrame({"class": pdf["class"].to_numpy(), "n": n})

    return run


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = 5, threshold: tuple[int, int] = (80, 100), count_links: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_links``.

    ``n_shingles`` is the size of the row's set of distinct ``width``-word
    shingles; rows link when den * intersection >= num * union; ``component_id``
    is the smallest id reachable by links, the own one included; ``n_links`` is
    the number of links of the row's class of equal sets to other classes; without
    ``count_links`` the column is left out.

    Null, empty and blank texts have no shingles and link with nothing; fewer
    than ``width`` words make one shingle.  A row without id is returned with
    its size and a null component and takes no part.  Repeated rows are
    returned as often; rows that share an id count as one document, whose texts
    all link.  An empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    C.python_ready(spark)
    num, den = threshold
    scheme = Scheme(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    tmp = C.Scratch()
    described = C.stored(rows.mapInArrow(_describe(width, scheme), SETS), "sets")
    sets = described.where("kind = 0").select(
        F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("class"), "bins", "fine")
    top = (
        described.where("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("times"))
        .orderBy(F.desc("times"), "key").limit(FREQUENT_ALL).collect()
    )
    frequent = np.array([r.key for r in top], np.int64).view(_U)
    order = np.argsort(frequent)
    times = np.array([r.times for r in top], np.int64)[order]

    taking_part = sets.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = tmp.stored(
        taking_part.groupBy("class").agg(
            F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"),
            F.min("bins").alias("bins"), F.min("fine").alias("fine")), "classes")

    named = rows.where("doc_id IS NOT NULL")
    sent = named.mapInArrow(
        _emit_keys(width, scheme, frequent[order], times), "key long, a long, b long")
    # the rows to be met have no b and come together by key; the others have
    # their b in the partitioning and are spread over all tasks
    forward = F.col("b").isNull()
    low = F.min(F.when(forward, F.col("a"))).over(_by("key", "b"))
    buckets = tmp.stored(
        sent.select("key", F.when(forward, low).otherwise(F.col("a")).alias("a"),
                    F.when(forward, F.col("a")).otherwise(F.col("b")).alias("b"))
        .where("a <> b").select("key", "a", "b"), "buckets")

    texts = named  # whole texts again for the few classes that need their sets

    def sets_of(ends: DataFrame) -> DataFrame:
        """(class, items) of the given distinct classes."""
        wanted = ends.join(classes, "class").select("class", F.col("rep").alias("doc_id"))
        items = texts.join(tmp.joinable(wanted.select("doc_id").distinct(), "wanted"), "doc_id", "left_semi")
        items = items.mapInArrow(_emit_sets(width), "class long, items binary")
        return tmp.stored(items.join(ends, "class", "left_semi"), "items")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link, on their exact sets."""
        pairs = tmp.stored(pairs, "pairs")
        items = sets_of(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct())
        x = items.select(F.col("class").alias("a"), F.col("items").alias("x"))
        y = items.select(F.col("class").alias("b"), F.col("items").alias("y"))
        return tmp.stored(
            pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
            .mapInArrow(_verify(num, den), "a long, b long").distinct(), "links")

    def near(pairs: DataFrame) -> DataFrame:
        x = classes.select(F.col("class").alias("a"), F.col("bins").alias("ba"))
        y = classes.select(F.col("class").alias("b"), F.col("bins").alias("bb"))
        pairs = tmp.stored(
            pairs.join(x, "a").join(y, "b").select("a", "b", "n", "ba", "bb")
            .mapInArrow(_filter_pairs(num, den), "a long, b long, n long"), "close")
        long_sets = classes.where("fine IS NOT NULL")
        x = long_sets.select(F.col("class").alias("a"), F.col("size").alias("na"), F.col("fine").alias("fa"))
        y = long_sets.select(F.col("class").alias("b"), F.col("size").alias("nb"), F.col("fine").alias("fb"))
        return (pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "n", "na", "nb", "fa", "fb")
                .mapInArrow(_filter_fine(num, den), "a long, b long, n long"))

    def contracted(links: DataFrame) -> DataFrame:
        """(class, component) with the smallest id as component; also joins the
        classes of rows that share an id."""
        ids = taking_part.select("doc_id", "class").distinct()
        shared = ids.join(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "doc_id")
        ends = classes.select("class", "rep")
        a = ends.select(F.col("class").alias("a"), F.col("rep").alias("u"))
        b = ends.select(F.col("class").alias("b"), F.col("rep").alias("v"))
        graph = links.join(a, "a").join(b, "b").select("u", "v").unionByName(
            shared.join(ends, "class").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
        found = components(graph)
        return ends.join(found.withColumnRenamed("vertex", "rep"), "rep", "left").select(
            "class", F.coalesce("component", "rep").alias("component"))

    # one pair per class first: what it links need not be verified again
    # (the one with the most buckets in common)
    common = near(buckets.groupBy("a", "b").agg(F.count("*").alias("n")))
    tried = tmp.stored(
        common.groupBy("b").agg(F.max(F.struct("n", "a"))["a"].alias("a")).select("a", "b"), "tried")
    links = verified(tried)
    parts = tmp.stored(contracted(links), "parts")

    # what the buckets still have to say: pairs across components
    members = buckets.select("key", F.col("a").alias("class")).union(
        buckets.select("key", F.col("b").alias("class"))).distinct()
    members = members.join(parts, "class")
    mixed = members.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")
    ).where("lo <> hi").select("key", "n")
    members = tmp.stored(members.join(mixed, "key"), "members")
    few, many = members.where(F.col("n") <= FEW), members.where(F.col("n") > FEW)
    # at most FEW / 2 pairs per row of a small bucket
    x = few.select("key", F.col("class").alias("a"), F.col("component").alias("ca"))
    y = few.select("key", F.col("class").alias("b"), F.col("component").alias("cb"))
    rest = x.join(y, "key").where("a < b AND ca <> cb").select("a", "b").distinct()
    rest = near(rest.withColumn("n", F.lit(0).cast("long"))).select("a", "b")
    more = verified(rest.join(tried, ["a", "b"], "left_anti"))  # a < b in both
    if not many.isEmpty():
        def block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
            return (
                rows.withColumn("blocks", blocks.cast("int"))
                .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")))

        # of a class, as many keys as it keeps at most
        shared = many.groupBy("class").agg(F.collect_list("key").alias("keys"))
        spread = many.join(shared, "class").select(
            "key", "class", "component", "n", F.filter("keys", lambda k: k < F.col("key")).alias("earlier"))
        hit = tmp.stored(
            block_pairs(spread.join(classes.select("class", "bins", "fine"), "class"), F.ceil(F.col("n") / BLOCK))
            .groupBy("key", "one", "two").applyInPandas(_near_other(num, den), "key long, class long").distinct(), "hit")
        sized = hit.join(classes.select("class", "size"), "class")
        sized = sized.join(sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "key")
        cells = block_pairs(
            sized.join(parts, "class"), F.greatest(F.ceil(F.col("n") / CROSS), F.ceil(F.col("total") / CROSS_SHINGLES))
        ).join(sets_of(hit.select("class").distinct()), "class").select("key", "one", "two", "class", "component", "block", "items")
        found = cells.groupBy("key", "one", "two").applyInPandas(_cross_links(num, den), "a long, b long")
        more = more.unionByName(tmp.stored(found.distinct(), "links"))
    if not more.isEmpty():
        links = links.unionByName(more).distinct()
        parts = tmp.stored(contracted(links), "parts")

    def degrees() -> DataFrame:
        """(class, n_links) of the classes with links."""
        known = links.join(parts.withColumnRenamed("class", "a"), "a").groupBy("component").agg(F.count("*").alias("known"))
        sized = classes.select("class", "rep", "size").join(parts, "class")
        whole = sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
        inside = tmp.stored(sized.join(whole.join(known, "component", "left"), "component"), "inside")
        closed = F.coalesce("known", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2
        blocks = F.greatest(F.ceil(F.col("n") / INSIDE), F.ceil(F.col("total") / INSIDE_SHINGLES)).cast("int")
        todo = inside.where(~closed).select("class", "component", "rep", blocks.alias("blocks")).withColumn(
            "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        items = texts.join(tmp.joinable(todo.select(F.col("rep").alias("doc_id")).distinct(), "reps"), "doc_id", "left_semi")
        cells = (
            items.mapInArrow(_emit_sets(width), "class long, items binary")
            .join(tmp.joinable(todo.drop("rep"), "todo"), "class")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
            .select("component", "one", "two", "class", "block", "items"))
        counted = cells.groupBy("component", "one", "two").applyInPandas(_count_links(num, den), "class long, n long")
        return counted.groupBy("class").agg(F.sum("n").alias("n_links")).unionByName(
            inside.where(closed).select("class", (F.col("n") - 1).alias("n_links")))

    of_class = C.stored(parts.join(degrees(), "class", "left") if count_links else parts, "components")
    tmp.clear()
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    key = F.when(F.col("doc_id").isNotNull(), F.col("class"))
    out = sets.withColumn("class", key).join(of_class, "class", "left")
    n_links = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", F.coalesce(alone, F.col("component")).alias("component_id"), *n_links)


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def keep_one_per_group(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document of each group: the one with the group's
    smallest ``doc_id``.  Documents without words and rows without id form no
    group and stay; exactly repeated rows of a kept document are returned once."""
    parts = ngram_components(docs, width=width, threshold=threshold, count_links=False)
    leaving = parts.where("doc_id IS NOT NULL AND component_id <> doc_id").select("doc_id").distinct()
    stay = docs.join(C.joinable(leaving, "leaving"), "doc_id", "left_anti")
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    twice = C.joinable(twice, "twice")
    once = stay.join(twice, "doc_id", "left_anti")
    return once.unionByName(stay.join(twice, "doc_id", "left_semi").distinct())
