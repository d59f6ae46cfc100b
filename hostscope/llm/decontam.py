"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words; only the words under a 1
are hashed, so a substitution under a 0 does not lose the hit.  Every position of
every benchmark text is hashed under every mask into one index; every position
of every document is looked up in it.  Each hit fixes an alignment (item,
diagonal), which is verified on the words themselves: a document is contaminated
by an item if some ``WINDOW`` consecutive words of the item (the whole item, if
shorter) stand in it with at most ``SUBSTITUTIONS`` words replaced.

The index is taken in blocks of at most about ``BLOCK_WORDS`` benchmark words,
which bounds what is broadcast; more benchmark text means more blocks, each
joined with all documents, and never a smaller index.  Long items are cut into
overlapping pieces first.  Documents are read whole and not shuffled, so a
passage that very many of them share costs nothing extra.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C

#: Any 13 aligned words with 2 substitutions, and any 11 or 12 with 1, keep at
#: least one of these whole (a test tries all placements).
MASKS = ("111111", "11001010011")
WINDOW, SUBSTITUTIONS = 13, 2
BLOCK_WORDS = 1_000_000
PIECE_WORDS, PIECE_OVERLAP = 4_096, 64
BITS = 24  # size of the prefilter: 2 ** BITS entries
_U = np.uint64
_FACTOR = C.mix64(np.arange(101, 101 + max(map(len, MASKS)), dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` words.  An item of 7 to 10 words gets three
    of its own length, each blind to every third word, so whatever word is replaced
    one of them does not see it; shorter items must stand word for word."""
    if n > 10:
        return MASKS
    if n > WINDOW // SUBSTITUTIONS:
        return tuple("".join("0" if j % 3 == k else "1" for j in range(n)) for k in range(3))
    return ("1" * n,) if n else ()


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at every position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(int("1" + mask, 2)))
    for j, bit in enumerate(mask):
        if bit == "1":
            out += words[j : j + n] * _FACTOR[j]
    return C.mix64(out)


class SeedIndex:
    """Benchmark texts with their seeds; lookups of whole documents."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        self.words, self.at = C.word_hashes(*C.text_bytes(column), C.IS_PUNCTUATION)
        seeds, item, place = [], [], []
        self.masks: set[str] = set()  # those that some item needs
        for k in range(len(items)):
            mine = self.words[self.at[k] : self.at[k + 1]]
            for mask in masks_of(len(mine)):
                self.masks.add(mask)
                h = seed_hashes(mine, mask)
                seeds.append(h)
                item.append(np.full(len(h), k, np.int32))
                place.append(np.arange(len(h), dtype=np.int32))
        seeds = np.concatenate([np.zeros(0, _U), *seeds])
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.item = np.concatenate([np.zeros(0, np.int32), *item])[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *place])[order]
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.seeds >> _U(64 - BITS)).astype(np.int64)] = True

    def alignments(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of all hits in a document."""
        found: set[tuple[int, int]] = set()
        for mask in sorted(self.masks):
            h = seed_hashes(words, mask)
            at = np.flatnonzero(self.maybe[(h >> _U(64 - BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
            times = hi - lo
            some = np.flatnonzero(times)
            if not len(some):
                continue
            entry = np.repeat(lo[some] - np.cumsum(times[some]) + times[some], times[some]) + np.arange(times[some].sum())
            diagonal = np.repeat(at[some], times[some]) - self.place[entry]
            found.update(zip(self.item[entry].tolist(), diagonal.tolist()))
        return found

    def hits(self, words: np.ndarray) -> dict[int, int]:
        """item id -> most equal words of a verified alignment."""
        out: dict[int, int] = {}
        for k, d in self.alignments(words):
            item = self.words[self.at[k] : self.at[k + 1]]
            need = min(WINDOW, len(item))
            a, b = max(0, -d), min(len(item), len(words) - d)
            if b - a < need:
                continue
            same = np.concatenate([[0], np.cumsum(item[a:b] == words[a + d : b + d])])
            if (same[need:] - same[:-need]).max() >= need - SUBSTITUTIONS * need // WINDOW:
                out[self.ids[k]] = max(out.get(self.ids[k], 0), int(same[-1]))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    words = F.split(F.col("text"), r"[\x00-/:-@\[-`{-\x7f]+")
    step = PIECE_WORDS - PIECE_OVERLAP
    pieces = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = (
        pieces.where("id IS NOT NULL AND text IS NOT NULL").distinct().withColumn("w", words)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - PIECE_OVERLAP, F.lit(1)), F.lit(step))))
        .select("id", F.array_join(F.slice("w", F.col("at"), PIECE_WORDS), " ").alias("text"),
                F.least(F.size("w") - F.col("at") + 1, F.lit(PIECE_WORDS)).alias("n"))
    )
    pieces = C.stored(pieces, "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    count = -(-total // BLOCK_WORDS)
    for k in range(count):
        mine = pieces.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).orderBy("id", "text")
        yield [(r.id, r.text) for r in mine.select("id", "text").collect()]


HITS = "array<struct<item_id: long, words: int>>"


def _lookup(shared):
    @F.arrow_udf(HITS)
    def hits(text: pa.Array) -> pa.Array:
        index: SeedIndex = shared.value
        buf, offsets = C.text_bytes(text)
        out = []
        for a, b in C.text_groups(offsets):
            words, at = C.word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], C.IS_PUNCTUATION)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                found = index.hits(words[i:j])
                out.append([{"item_id": k, "words": found[k]} for k in sorted(found)])
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32())])))

    return hits


def _merge(*blocks: pa.Array) -> pa.Array:
    out = []
    for row in zip(*(b.to_pylist() for b in blocks)):
        best: dict[int, int] = {}
        for hit in (h for hits in row for h in hits or ()):
            best[hit["item_id"]] = max(best.get(hit["item_id"], 0), hit["words"])
        out.append([{"item_id": k, "words": best[k]} for k in sorted(best)])
    return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32())])))


def benchmark_hits(spark, benchmark: DataFrame, text: Column, id_col: str = "item_id", text_col: str = "text") -> Column:
    """A column ``array<struct<item_id, words>>`` for a text column: the items
    found in it, by id, with the equal words of the best alignment."""
    C.python_ready(spark)
    found = [
        _lookup(spark.sparkContext.broadcast(SeedIndex(items)))(text)
        for items in _blocks(benchmark, id_col, text_col)
    ]
    if not found:
        return F.expr(f"CAST(array() AS {HITS})")
    if len(found) == 1:
        return found[0]
    return F.arrow_udf(_merge, HITS)(*found)  # pieces of one item may be hit in several blocks


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, item_ids, longest`` for every row of ``docs``.

    ``item_ids`` are the benchmark items found, in order; ``longest`` the most
    equal words of one alignment (0 if none).  Words are runs of ASCII letters,
    digits and non-ASCII characters, A-Z lower-cased, so punctuation and
    layout do not matter.  Null and empty texts are clean; items that are null or
    without words are never found; an item of fewer than 13 words must stand
    whole, with substitutions in proportion: one from 7 words on, none below.
    Repeated rows are each judged, in either table; an empty benchmark leaves
    all clean; other columns are ignored.
    """
    hits = benchmark_hits(docs.sparkSession, benchmark, F.col("text"))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", hits.alias("hits"))
    return rows.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["words"])), F.lit(0)).alias("longest"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Rows with a null or empty text stay; repeated rows stay or go together; all
    columns are kept, whatever their names.  An empty benchmark drops nothing,
    an empty table gives an empty result.
    """
    hits = benchmark_hits(docs.sparkSession, benchmark, F.col("text"))
    return docs.where(F.size(hits) == 0)
