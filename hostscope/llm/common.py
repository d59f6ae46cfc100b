"""Shared helpers of the llm operators.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; only A-Z are lower-cased.  Words, shingles and sets
are handled as 64-bit values computed with numpy over whole Arrow batches, so
no Python object is made per word.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import hostscope
from hostscope.session import shared_path

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1_000  # rows of text handed to Python at once
PIECE_BYTES = 1 << 20  # text bytes that one round of vector operations covers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the cluster's shared folder and read it back: cuts the
    lineage, survives lost executors and is columnar, unlike a checkpoint.  The
    shuffle files of the write go as soon as it has ended."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The tables that one operator stores, to be deleted together once its result
    no longer reads them."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def joinable(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        side = self.stored(df, name)
        return F.broadcast(side) if side.count() <= (BROADCAST_ROWS if most is None else most) else side

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []


BROADCAST_ROWS = 1_000_000  # ids and other few-column rows: some tens of MB


def joinable(side: DataFrame, name: str) -> DataFrame:
    """A stored side of a join with whole texts: broadcast if it has at most
    ``BROADCAST_ROWS`` rows, so that texts are not shuffled; else as it is, for a
    shuffled join."""
    side = stored(side, name)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def python_ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a
    cluster it is installed, and this adds nothing), and hand them texts in
    batches of at most ``BATCH_ROWS`` rows."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(hostscope.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(key: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- 64-bit hashes

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]  # A-Z as a-z
    return values


BYTE_VALUE = _byte_values()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For uses where punctuation does not matter: all ASCII but letters and digits parts words.
IS_PUNCTUATION = np.ones(256, bool)
IS_PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_POWER = np.ones(256, _U)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n or _POWER[1] == 1:
        out = np.full(max(n, 256), _U(0xD6E8FEB86659FD93))
        out[0] = 1
        _POWER = np.multiply.accumulate(out)
    return _POWER


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its
    texts; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_groups(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def _piece_hashes(buf: np.ndarray, begins: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and start offsets of ``buf``; ``begins``: where texts begin."""
    n = len(buf)
    word = ~parts[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = begins[begins < n]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), starts
    number = np.cumsum(first, dtype=np.int32) - 1
    offset = np.arange(n, dtype=np.int64) - starts[np.maximum(number, 0)]
    offset[~word] = 0
    values = BYTE_VALUE[buf] * _powers(int(offset.max()) + 1)[offset]
    values[~word] = 0
    length = np.add.reduceat(word.astype(np.int64), starts).astype(_U)
    return mix64(np.add.reduceat(values, starts) + length * _U(0x9E3779B97F4A7C15)), starts


def word_hashes(
    buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the given texts, and the n + 1 offsets of the
    texts in them.  ``parts``: which bytes part words.  Long texts are taken in
    pieces that end at such a byte."""
    hashes, starts, at, n = [], [], 0, len(buf)
    begins = offsets[:-1]
    while at < n:
        end = min(n, at + PIECE_BYTES)
        while end < n and not parts[buf[end]]:
            gap = np.flatnonzero(parts[buf[end : end + PIECE_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(n, end + PIECE_BYTES)
        h, s = _piece_hashes(buf[at:end], begins[(begins >= at) & (begins < end)] - at, parts)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  A text of fewer words has
    its whole word sequence as its one shingle; one without words has none."""
    factor = mix64(np.arange(11, 11 + width, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, _U)
        for j in range(width):
            rolled += words[j : len(words) - width + 1 + j] * factor[j]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * factor[: b - a]).sum(dtype=_U) + _U(b - a)
            out.append(mix64(mix64(np.array([short], _U))))
        else:
            out.append(np.zeros(0, _U))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
