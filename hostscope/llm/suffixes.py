"""Repeated passages by blockwise suffix sorting with a difference cover.

A difference cover ``D`` modulo ``v`` holds two elements for every difference, so
for any two positions there is an offset below ``v`` that takes both of them to
cover positions.  Texts are dealt to blocks of about ``BLOCK_BYTES`` by a hash of
the document id, and every block is worked on alone, in bounded memory:

1. Cover samples.  Two equal strings of ``least`` bytes share cover positions from
   which ``least - v + 1`` bytes agree.  The hashes of those strings at the cover
   positions of every block are met bucket by bucket; a sample that stands in no
   other document takes its suffixes out of the work.
2. Suffix sorting of a block.  The samples left are sorted to full depth and ranked,
   with the common prefix of neighbours giving ranks for every smaller depth.  Then
   the suffixes are sorted one bucket (a range of leading words) at a time, by the
   words that hold their first ``v`` bytes; longer ties are resolved by the ranks of
   the samples at a common cover offset.  Suffixes that agree in ``least`` bytes form
   a class, held by the block's smallest document that has them.
3. Classes of all blocks meet bucket by bucket under a fingerprint of their
   ``least`` bytes: one row of packed fingerprints a block and bucket, so a passage
   of thousands of documents is one entry a block.  Where another block holds the
   class in a smaller document, the holder's bytes go as well.

Exact copies of whole texts are settled first, by SHA-256.  Sample hashes (as wide
as 16 bits more than the number of bytes asks for) only admit suffixes to the sort;
fingerprints of classes have 64 bits, and 96 from 2 GiB of text on.  These, and
the SHA-256 of whole texts, are the only approximations.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C

#: Perfect difference sets by their modulus.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 21  # sample hashes, or classes, of a bucket
SUFFIX_BUCKET = 1 << 18  # suffixes of a block that are sorted at once
WIDE_FROM = 1 << 31  # bytes of text from which fingerprints have 96 bits
BROADCAST_SPANS = 250_000  # documents whose spans may go to every task
_U = np.uint64
PAD = 64


def cover_of(least: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover whose samples still span three fifths of ``least``."""
    period = max(v for v in COVERS if v <= max(3, least - least * 3 // 5 + 1))
    return period, COVERS[period]


# ------------------------------------------------------------- numpy on one block


def words_of(buf: np.ndarray) -> np.ndarray:
    """The big-endian word that begins at each byte, zeros after the end."""
    padded = np.concatenate([buf, np.zeros(PAD, np.uint8)])
    return np.ndarray((len(buf) + PAD - 7,), ">u8", padded, strides=(1,))


def hash_at(words: np.ndarray, at: np.ndarray, depth: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the ``depth`` bytes from each position."""
    h = np.full(len(at), _U(seed * 2 + 1) * _U(0x9E3779B97F4A7C15))
    for o in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        h = C.mix64((h ^ words[at + o].astype(_U)) * _U(0xD6E8FEB86659FD93))
    return h


def sample_positions(starts: np.ndarray, ends: np.ndarray, depth: int, period: int, cover) -> np.ndarray:
    """Cover positions, counted from each text's start, with ``depth`` bytes left."""
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= depth:
            at = (np.arange(0, b - a - depth + 1, period)[:, None] + np.array(cover)).ravel()
            out.append(at[at <= b - a - depth] + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each value is in."""
    fresh = np.ones(len(sorted_values), bool)
    fresh[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.cumsum(fresh) - 1


def sort_suffixes(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their first ``depth`` bytes, rounded up to whole
    words; group numbers, equal for equal ones).  Every further word sorts only what
    is still tied."""
    order = np.argsort(words[at].astype(_U), kind="stable")
    at = at[order]
    group = _runs(words[at].astype(_U))
    for o in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = words[at[where] + o].astype(_U)
        order = np.lexsort((key, group[where]))
        at[where] = at[where[order]]
        key = key[order]
        fresh = np.zeros(len(at), bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[where[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(fresh)
    return at, group


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the strings at ``a`` and ``b`` have in common, up to whole words
    that hold ``depth`` bytes."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for o in range(0, depth, 8):
        x = words[a[open_] + o].astype(_U) ^ words[b[open_] + o].astype(_U)
        for j in range(8):
            out[open_] += x < (_U(1) << _U(56 - 8 * j)) if j < 7 else x == 0
        open_ = open_[x == 0]
    return out


def class_holders(buf: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """For each of the ascending positions ``at`` the first of them with the same
    ``least`` bytes."""
    period, cover = cover_of(least)
    words = words_of(buf)
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    near = np.zeros(len(buf) + period + 1, np.int32)  # cover positions some suffix looks at
    np.add.at(near, at, 1)
    np.add.at(near, at + period, -1)
    samples = np.flatnonzero(np.cumsum(near)[: len(buf)] > 0)
    samples = samples[in_cover[samples % period]]
    ranked, _ = sort_suffixes(words, samples.copy(), least)
    shared = np.concatenate([[0], common_prefix(words, ranked[:-1], ranked[1:], least)]) if len(ranked) else np.zeros(0, int)
    rank = np.zeros(len(buf) + period, np.int32)
    rank[ranked] = np.arange(len(ranked), dtype=np.int32)
    classes = [np.cumsum(shared < least - o).astype(np.int32) for o in range(period)]  # by depth least - o

    holder = at.copy()
    index = np.zeros(len(buf) + 1, np.int32)
    index[at] = np.arange(len(at), dtype=np.int32)
    lead = words[at].astype(_U)
    n = max(1, len(at) // SUFFIX_BUCKET)
    borders = np.unique(np.sort(lead[:: max(1, len(lead) // (n * 64))])[::64][1:]) if n > 1 else np.zeros(0, _U)
    bucket = np.searchsorted(borders, lead, "right")
    for b in range(len(borders) + 1):  # one suffix bucket at a time
        mine, group = sort_suffixes(words, at[bucket == b], period)
        tied = np.zeros(len(mine), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        mine, group = mine[tied], group[tied].astype(np.int64)
        order = np.argsort(mine, kind="stable")
        mine, group = mine[order], group[order]
        first = mine.copy()
        for o in range(period):  # long ties: by the ranks at the cover offset o
            on = np.flatnonzero(in_cover[(mine + o) % period])
            key = group[on] * (len(ranked) + 1) + classes[o][rank[mine[on] + o]]
            order = np.argsort(key, kind="stable")
            on, run = on[order], _runs(key[order])
            heads = mine[on][np.concatenate([[True], run[1:] != run[:-1]])] if len(run) else mine[:0]
            np.minimum.at(first, on, heads[run])
        holder[index[mine]] = first
    return holder


# ------------------------------------------------------------------ packed blobs


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, then differences in 4, 6 or 8 bytes each."""
    steps = np.diff(keys)
    top = int(steps.max(initial=0))
    width = 4 if top < 1 << 32 else 6 if top < 1 << 48 else 8
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if len(raw) <= 1:
        return np.zeros(0, _U)
    width = int(raw[0])
    steps = np.zeros((1 + (len(raw) - 9) // width, 8), np.uint8)
    steps[0] = raw[1:9]
    steps[1:, :width] = raw[9:].reshape(-1, width)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=_U)


def arrays(*values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, for what is in order or in runs."""
    steps = [np.diff(v.astype(np.int64), prepend=0) for v in values]
    kinds = [next((t for t in ("<i1", "<i2", "<i4") if not len(s) or (np.iinfo(t).min <= s.min() and s.max() <= np.iinfo(t).max)), "<i8")
             for s in steps]
    head = np.array([[len(s), int(t[2])] for s, t in zip(steps, kinds)], "<u8").tobytes()
    return bytes([len(values)]) + head + zlib.compress(b"".join(s.astype(t).tobytes() for s, t in zip(steps, kinds)), 1)


def read_arrays(blob: bytes) -> list[np.ndarray]:
    head = np.frombuffer(blob, "<u8", 2 * blob[0], 1).reshape(-1, 2).tolist()
    raw, at, out = zlib.decompress(blob[1 + 16 * blob[0] :]), 0, []
    for n, width in head:
        out.append(np.cumsum(np.frombuffer(raw, f"<i{width}", n, at).astype(np.int64)))
        at += n * width
    return out


def numbers(values: np.ndarray, below: int) -> bytes:
    """Numbers of 20 bits, if all are below 2^20, or of 32 bits each."""
    if below > 1 << 20:
        return b"\x20" + values.astype("<u4").tobytes()
    high = np.append(values >> 16, 0)[: len(values) + len(values) % 2].astype(np.uint8)
    return bytes([20, len(values) % 2]) + (values & 0xFFFF).astype("<u2").tobytes() + (high[::2] | high[1::2] << 4).tobytes()


def read_numbers(blob) -> np.ndarray:
    if blob[0] == 32:
        return np.frombuffer(blob, "<u4", offset=1).astype(np.int64)
    n = (len(blob) - 2 - 3 * blob[1]) // 5 * 2 + blob[1]  # a pair has 5 bytes, an odd one 3
    pairs = np.frombuffer(blob, np.uint8, offset=2 + 2 * n).astype(np.int64)
    high = np.stack([pairs & 15, pairs >> 4], 1).ravel()[:n]
    return np.frombuffer(blob, "<u2", n, 2).astype(np.int64) | high << 16


def cut(keys: np.ndarray, bits: int, bucket_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys of ``bits`` bits, by leading bits."""
    if not len(keys):
        return []
    lead = (keys >> _U(bits - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
    return list(zip(lead[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)]))


class Block:
    """The texts of one block in the order of their ids."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("sha", "ascending")]).combine_chunks()
        self.ids = table.column("doc_id").to_numpy()
        self.shas = table.column("sha").to_pylist()
        column = table.column("text")
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
        self.buf, self.offsets = C.text_bytes(column)
        self.starts, self.ends = self.offsets[:-1], self.offsets[1:]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def samples(self, least: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cover positions, their distinct sample hashes, which one each has)."""
        period, cover = cover_of(least)
        depth = least - period + 1
        at = sample_positions(self.starts, self.ends, depth, period, cover)
        keys = hash_at(words_of(self.buf), at, depth) >> _U(64 - bits)
        distinct, which = np.unique(keys, return_inverse=True)
        return at, distinct, which

    def candidates(self, least: int, at: np.ndarray, which: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Suffixes of ``least`` bytes or more near a sample that another text may have."""
        period, _ = cover_of(least)
        owner = self.ids[self.text_of(at)]
        low, high = np.full(len(elsewhere), np.iinfo(np.int64).max), np.full(len(elsewhere), np.iinfo(np.int64).min)
        np.minimum.at(low, which, owner)
        np.maximum.at(high, which, owner)
        hit = at[(elsewhere | (low != high))[which]]
        text = self.text_of(hit)
        change = np.zeros(len(self.buf) + 2, np.int32)
        np.add.at(change, np.maximum(hit - period + 1, self.starts[text]), 1)
        np.add.at(change, hit + 1, -1)
        found = np.flatnonzero(np.cumsum(change)[: len(self.buf)] > 0)
        return found[found + least <= self.ends[self.text_of(found)]]


# ---------------------------------------------------------------- tasks on blocks


def _send_samples(least: int, bits: int, bucket_bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(pa.Table.from_batches(list(batches)))
        _, keys, _ = block.samples(least, bits)
        parts = cut(keys, bits, bucket_bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array([b for b, _, _ in parts], pa.int64()),
             pa.array([pack(keys[i:j]) for _, i, j in parts], pa.binary())], names=["block", "bucket", "keys"])

    return run


def _meet_samples(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block's keys of a bucket: which of them another block has, a bit each."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    keys = [unpack(b.as_buffer()) for b in table.column("keys")]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    run = _runs(keys[order])
    shared = np.zeros(len(keys), bool)
    shared[order] = np.bincount(run)[run] > 1
    shared = np.split(shared, np.cumsum(sizes)[:-1])
    yield pa.RecordBatch.from_arrays(
        [pa.concat_arrays(table.column("block").chunks), pa.array([key[0].as_py()] * len(shared), pa.int64()),
         pa.array([np.packbits(s).tobytes() for s in shared], pa.binary()), pa.array([int(s.sum()) for s in shared], pa.int64())],
        names=["block", "bucket", "bits", "n_shared"])


CLASSES = "block long, bucket long, keys binary, more binary, number binary, holders binary, ids array<long>, shas array<string>, state binary"
_CLASSES = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("number", pa.binary()),
    ("holders", pa.binary()), ("ids", pa.list_(pa.int64())), ("shas", pa.list_(pa.string())), ("state", pa.binary())])


def _send_classes(least: int, bits: int, first_bits: int, then_bits: int, wide: bool):
    """The classes of a block: a row of packed fingerprints a bucket, and one row
    (no keys) with the class of each of its suffixes, which passes the buckets as is."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _CLASSES.empty_table()
        number = texts.column("block")[0].as_py()
        block = Block(texts)
        at, keys, which = block.samples(least, bits)
        answers = sorted(answers.select(["bucket", "bits"]).to_pylist(), key=lambda r: r["bucket"])
        sizes = [j - i for _, i, j in cut(keys, bits, first_bits)]
        elsewhere = np.concatenate([
            np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=n).astype(bool) for r, n in zip(answers, sizes)]
            or [np.zeros(0, bool)])
        at = block.candidates(least, at, which, elsewhere)
        if not len(at):
            return _CLASSES.empty_table()
        holder = class_holders(block.buf, at, least)
        heads = np.unique(holder)
        words = words_of(block.buf)
        marks = hash_at(words, heads, least, 1)
        more = hash_at(words, heads, least, 2).astype("<u4") if wide else None
        order = np.argsort(marks, kind="stable")
        holders, firsts = np.unique(block.text_of(heads), return_index=True)  # classes are numbered by text
        holders = arrays(block.ids[holders], firsts)
        rows = [{
            "block": number, "bucket": bucket, "keys": pack(marks[order[i:j]]),
            "more": more[order[i:j]].tobytes() if wide else None, "number": numbers(order[i:j], len(heads)), "holders": holders}
            for bucket, i, j in cut(marks[order], 64, then_bits)]
        steps = np.diff(at, prepend=at[0] - 2)
        run_begin = np.flatnonzero(steps != 1)
        class_of = np.searchsorted(heads, holder)
        with_any = np.unique(block.text_of(at))
        state = arrays(at[run_begin], np.diff(run_begin, append=len(at)), class_of, block.starts[with_any])
        rows.append({
            "block": number, "bucket": rows[0]["bucket"], "ids": block.ids[with_any].tolist(),
            "shas": [block.shas[i] for i in with_any.tolist()], "state": state})
        return pa.Table.from_pylist(rows, _CLASSES)

    return run


MET = "block long, number binary, ids array<long>, shas array<string>, state binary"
_MET = pa.schema([("block", pa.int64()), ("number", pa.binary()), ("ids", pa.list_(pa.int64())),
                  ("shas", pa.list_(pa.string())), ("state", pa.binary())])


def _meet_classes(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every block the numbers of its classes that a smaller document of another
    block holds."""
    blocks, keys, more, docs, counted = [], [], [], [], []
    for batch in batches:
        passing = batch.filter(pc.is_valid(batch.column("state")))
        if passing.num_rows:
            yield passing.select(["block", "number", "ids", "shas", "state"]).cast(_MET)
        for r in batch.filter(pc.is_valid(batch.column("keys"))).select(
                ["block", "keys", "more", "number", "holders"]).to_pylist():
            n, (ids, firsts) = read_numbers(r["number"]), read_arrays(r["holders"])
            blocks.append(r["block"])
            keys.append(unpack(r["keys"]))
            more.append(None if r["more"] is None else np.frombuffer(r["more"], "<u4"))
            docs.append(ids[np.searchsorted(firsts, n, "right") - 1])
            counted.append(n)
    if not keys:
        return
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    k, d = np.concatenate(keys), np.concatenate(docs)
    if more[0] is None:
        order = np.argsort(k, kind="stable")
        run = _runs(k[order])
    else:
        m = np.concatenate(more)
        order = np.lexsort((m, k))
        run = _runs(_runs(k[order]) * (1 << 32) + m[order])
    least = np.minimum.reduceat(d[order], np.flatnonzero(np.diff(run, prepend=-1)))[run]
    goes = np.zeros(len(k), bool)
    goes[order] = d[order] > least
    out = [{"block": b, "number": arrays(np.sort(n[g]))} for b, n, g in zip(blocks, counted, np.split(goes, sizes)) if g.any()]
    yield pa.RecordBatch.from_pylist(out, _MET)


SPANS = "doc_id long, sha string, begins array<long>, finishes array<long>"
_SPANS = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("begins", pa.list_(pa.int64())), ("finishes", pa.list_(pa.int64()))])


def _spans(least: int):
    """The removed byte ranges of a block's documents."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ids, shas, goes = None, None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["state"] is not None:
                    state, ids, shas = read_arrays(r["state"]), np.array(r["ids"], np.int64), r["shas"]
                else:
                    goes += read_arrays(r["number"])
        run_at, run_n, class_of, starts = state
        at = np.repeat(run_at - np.concatenate([[0], np.cumsum(run_n)[:-1]]), run_n) + np.arange(int(run_n.sum()))
        text = np.searchsorted(starts, at, "right") - 1
        _, head = np.unique(class_of, return_index=True)
        gone = ids[text] > ids[text[head]][class_of]
        if goes:
            elsewhere = np.zeros(len(head), bool)
            elsewhere[np.concatenate(goes)] = True
            gone |= elsewhere[class_of]
        at, text = at[gone], text[gone]
        if not len(at):
            return
        fresh = np.ones(len(at), bool)  # a text's removed strings that overlap or touch are one span
        fresh[1:] = (at[1:] > at[:-1] + least) | (text[1:] != text[:-1])
        begin = np.flatnonzero(fresh)
        last = np.concatenate([begin[1:] - 1, [len(at) - 1]])
        owner = text[begin]
        begins, finishes = at[begin] - starts[owner], at[last] + least - starts[owner]
        rows = []
        border = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for i, j in zip(border.tolist(), [*border[1:].tolist(), len(owner)]):
            t = int(owner[i])
            rows.append({"doc_id": int(ids[t]), "sha": shas[t], "begins": begins[i:j].tolist(), "finishes": finishes[i:j].tolist()})
        yield pa.RecordBatch.from_pylist(rows, _SPANS)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of what the spans leave of every text."""
    for batch in batches:
        buf, offsets = C.text_bytes(batch.column("text"))
        raw, out = memoryview(buf), []
        for i, (begins, finishes) in enumerate(zip(batch.column("begins").to_pylist(), batch.column("finishes").to_pylist())):
            digest, at = hashlib.sha256(), int(offsets[i])
            for b, f in zip(begins, finishes):
                digest.update(raw[at : int(offsets[i]) + b])
                at = int(offsets[i]) + f
            digest.update(raw[at : int(offsets[i + 1])])
            out.append((sum(finishes) - sum(begins), len(begins), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sha"), pa.array([r[0] for r in out], pa.int64()),
             pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
            names=["doc_id", "sha", "n_removed", "n_spans", "kept_sha256"])


# ------------------------------------------------------------------ the operator


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.sha2("text", 256).alias("sha"))


def _power(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def repeated_spans(rows: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """``doc_id, sha, begins, finishes``: byte ranges of the texts ``rows(doc_id,
    text, sha)`` that are covered by strings of ``least`` bytes which also start in
    a text of a smaller id; texts without such a string have no row.  ``known``:
    the same rows with ``n_bytes`` in place of the text."""
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    period, cover = cover_of(least)
    bits = min(64, _power(total) + 16)
    first_bits = min(bits, _power(total * len(cover) / period / BUCKET_KEYS))
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))
    answers = C.stored(
        dealt.groupBy("block").applyInArrow(_send_samples(least, bits, first_bits), "block long, bucket long, keys binary")
        .groupBy("bucket").applyInArrow(_meet_samples, "block long, bucket long, bits binary, n_shared long"), "samples")
    shared = answers.agg(F.sum("n_shared")).first()[0] or 0
    then_bits = _power(shared * period / len(cover) / BUCKET_KEYS)
    classes = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _send_classes(least, bits, first_bits, then_bits, total >= WIDE_FROM), CLASSES)
    met = C.stored(classes.groupBy("bucket").applyInArrow(_meet_classes, MET), "classes")
    C.discard(answers)
    spans = C.stored(met.groupBy("block").applyInArrow(_spans(least), SPANS), "spans")
    C.discard(met)
    return spans


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Of every text, as UTF-8 bytes, those bytes go that a string of ``least`` bytes
    covers which also starts in a text of a smaller id; strings never span texts and
    are judged on the input.  ``n_spans`` counts the maximal removed runs,
    ``kept_sha256`` is of the bytes that remain.

    A null text is empty.  Empty texts, and those shorter than ``least``, keep all.
    A row without id takes no part and keeps all its bytes.  Repeated rows are
    returned as often; rows of one id do not remove from each other.  An empty table
    gives an empty result.  Other columns are ignored, whatever their names.
    """
    if least < 16:
        raise ValueError("strings must have 16 bytes at least")
    C.python_ready(docs.sparkSession)
    rows = _documents(docs, id_col, text_col)
    known = C.stored(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    taking_part = known.where((F.col("n_bytes") >= least) & F.col("doc_id").isNotNull())
    earliest = taking_part.groupBy("sha").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    earliest = C.joinable(earliest.where("latest > earliest").drop("latest"), "earliest")
    copies = C.joinable(
        taking_part.join(earliest, "sha").where("doc_id > earliest").select("doc_id", "sha").distinct(), "copies")
    originals = rows.where((F.octet_length("text") >= least) & F.col("doc_id").isNotNull()).join(copies, ["doc_id", "sha"], "left_anti")
    spans = repeated_spans(originals, taking_part.join(copies, ["doc_id", "sha"], "left_anti"), least)
    spans = spans.dropDuplicates(["doc_id", "sha"])
    if spans.count() <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    changed = rows.join(spans, ["doc_id", "sha"]).select("doc_id", "sha", "text", "begins", "finishes").mapInArrow(
        _kept, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string")
    changed = C.stored(changed.dropDuplicates(["doc_id", "sha"]), "changed")
    copy = copies.withColumn("copy", F.lit(True))
    out = known.join(changed, ["doc_id", "sha"], "left").join(copy, ["doc_id", "sha"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
