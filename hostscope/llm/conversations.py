"""Conversation structure repair with Four-Russians block tables.

A repaired conversation's role initials must read ``(s?(ua)+)?``, an automaton of
four states.  The cost to go from a row on is a vector of one cost a state; less
its minimum it takes few values, so the step over a row, and over any block of
``BLOCK`` rows, is a table from (normalised vector, block of symbols) to
(normalised vector, cost).  The tables depend on the edit costs alone.  A
conversation is read from its end block by block, one lookup each, keeping the
vector at every block's border; then the blocks are expanded again, each from its
right border backward, and traced forward.  As the vectors hold costs to go, the
trace can take the ASCII-least of the cheapest edits at every step, which gives the
least of all cheapest audits.

Spark sorts the rows by conversation and turn into ranges, so a very long
conversation is spread over many tasks.  Conversations inside a range are finished
in place.  Those at a range's ends, and those of more rows than ``piece_rows``, come
as pieces: their symbols (a byte a row, as long as the audit that is returned) are
traced together, their texts are edited piece by piece, and the texts stream in
order through the hash, which is sequential by nature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C

REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
BLOCK = 4
PIECE_ROWS, PIECE_BYTES = 20_000, 8 << 20
#: x: must go; then the initials (o: any other), in capitals if truncated.
SYMBOLS = "xsuaoSUAO"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "o": {}}
#: The one role, and its state, that may come next if it may be chosen.
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
NEXT_ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
_FAR = 1 << 30


def _with_inserts(cost: list[int]) -> list[int]:
    out = list(cost)
    for _ in range(3):  # the longest chain of inserts that can pay
        out = [min(c, INSERT + out[NEXT[s]]) for s, c in enumerate(out)]
    return out


END = _with_inserts([0, _FAR, _FAR, 0])


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of one row, in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != "x":
        extra = UNFINISHED if symbol.isupper() else 0
        if state in KEEP[symbol.lower()]:
            out.append(("K", extra, KEEP[symbol.lower()][state]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


class Tables:
    """Block and trace tables over all vectors that can occur."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        known: dict[tuple[int, ...], int] = {}

        def number(vector):
            low = min(vector)
            key = tuple(c - low for c in vector)
            if key not in known:
                known[key] = len(self.vectors)
                self.vectors.append(key)
            return known[key], low

        self.end, _ = number(END)
        step, cost, trace = [], [], []
        at = 0
        while at < len(self.vectors):
            after = self.vectors[at]
            for symbol in SYMBOLS:
                edits = [_edits(symbol, s) for s in range(4)]
                here = _with_inserts([min(c + after[t] for _, c, t in e) for e in edits])
                to, low = number(here)
                step.append(to)
                cost.append(low)
                trace.append([self._least(here, after, edits, s) for s in range(4)])
            at += 1
        k = len(SYMBOLS)
        self.step1, self.cost1 = np.array(step).reshape(-1, k), np.array(cost, np.int64).reshape(-1, k)
        self.trace = trace  # [vector * k + symbol][state] -> (inserts, edit, state after)
        # a block's symbols are read from its last to its first
        self.step, self.cost = self.step1, self.cost1
        for _ in range(BLOCK - 1):
            self.cost = (self.cost[:, :, None] + self.cost1[self.step]).reshape(len(self.step1), -1)
            self.step = self.step1[self.step].reshape(len(self.step1), -1)
        self.rows = [a.tolist() for a in (self.step, self.cost, self.step1, self.cost1)]

    @staticmethod
    def _least(here, after, edits, state):
        inserts = 0
        while True:
            best = [(e, t) for e, c, t in edits[state] if c + after[t] == here[state]]
            first = best[0][0] if best else "Z"
            if here[state] == INSERT + here[NEXT[state]] and "I" < first:
                inserts, state = inserts + 1, NEXT[state]
                continue
            return (inserts, *best[0])

    def border_vectors(self, symbols: bytes) -> tuple[list[int], int, int]:
        """(vector at the right border of every block, vector before the first row,
        cost of the whole); blocks are aligned to the end."""
        step, cost, step1, cost1 = self.rows
        k, head = len(SYMBOLS), len(symbols) % BLOCK
        digits = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, BLOCK)[:, ::-1]  # last symbol leads
        codes = (digits.astype(np.int64) @ (k ** np.arange(BLOCK - 1, -1, -1))).tolist()
        vector, total, borders = self.end, 0, [0] * len(codes)
        for i in range(len(codes) - 1, -1, -1):
            borders[i] = vector
            total += cost[vector][codes[i]]
            vector = step[vector][codes[i]]
        if head:
            borders.insert(0, vector)
            for s in symbols[:head][::-1]:
                total += cost1[vector][s]
                vector = step1[vector][s]
        return borders, vector, total + self.vectors[vector][START]

    def repair(self, symbols: bytes) -> tuple[int, list[tuple[int, str, int]], int]:
        """(cost, (inserts before the row, edit, state after) of every row, state)."""
        borders, _, cost = self.border_vectors(symbols)
        step1, k, head = self.rows[2], len(SYMBOLS), len(symbols) % BLOCK
        state, out, at = START, [], 0
        for i, vector in enumerate(borders):
            upto = at + (head if i == 0 and head else BLOCK)
            inside = []
            for s in symbols[at:upto][::-1]:  # the block expanded from its right border
                inside.append(self.trace[vector * k + s])
                vector = step1[vector][s]
            for choice in reversed(inside):
                out.append(choice[state])
                state = choice[state][2]
            at = upto
        return cost, out, state


_tables: list[Tables] = []


def tables() -> Tables:
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def closing_inserts(state: int) -> int:
    return {START: 0, AFTER_A: 0, AFTER_U: 1, AFTER_S: 2}[state]


def audit_of(choices, closing: int = 0) -> str:
    return "".join("I" * n + e for n, e, _ in choices) + "I" * closing


def repaired_lines(choices, state: int, roles, texts, closing: int = 0) -> list[str]:
    """The rows that remain, as ``role:text``; ``state``: the one before the first."""
    out = []
    for (inserts, edit, after), role, text in zip(choices, roles, texts):
        for _ in range(inserts):
            state = NEXT[state]
            out.append(NEXT_ROLE[state] + ":")
        if edit == "K":
            out.append(f"{role}:{text}")
        elif edit == "R":
            out.append(f"{NEXT_ROLE[after]}:{text}")
        state = after
    for _ in range(closing):
        state = NEXT[state]
        out.append(NEXT_ROLE[state] + ":")
    return out


# ---------------------------------------------------------------- tasks on ranges


class Rows:
    """The rows of one conversation, or of a piece of one, copies side by side."""

    def __init__(self, batch: pa.Table):
        n = batch.column("n").to_numpy()
        self.batch = batch
        self.take = np.repeat(np.arange(len(n)), n)
        again = np.ones(len(self.take), bool)
        again[(np.cumsum(n) - n)[n > 0]] = False
        again |= ~batch.column("first").to_numpy()[self.take]
        blank = batch.column("blank").to_numpy()[self.take]
        cut = batch.column("cut").to_numpy()[self.take]
        who = batch.column("who").to_numpy()[self.take]  # 1 s, 2 u, 3 a, 4 other
        gone, cut = blank | again, cut & ~blank & ~again
        self.symbols = np.where(gone, 0, who + 4 * cut).astype(np.uint8).tobytes()
        turns = batch.column("turn").filter(pc.and_(pc.greater(batch.column("n"), 0), pc.is_valid(batch.column("turn"))))
        turns = turns.to_numpy()
        self.turns = (int(turns[0]), int(turns[-1]), 1 + int((turns[1:] != turns[:-1]).sum())) if len(turns) else None
        self.ends = (int(who[0]), int(who[-1])) if len(who) else None
        self.counts = (int(blank.sum()), int((again & ~blank).sum()), int(cut.sum()), _illegal(who[:-1], who[1:]))

    def texts(self):
        return [self.batch.column(c).take(pa.array(self.take)).to_pylist() for c in ("role", "text")]


def _illegal(a: np.ndarray, b: np.ndarray) -> int:
    pair = a.astype(int) * 8 + b
    return int((~np.isin(pair, [1 * 8 + 2, 2 * 8 + 3, 3 * 8 + 2])).sum())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = ("no int, symbols binary, first_turn long, last_turn long, distinct_turns long, first_who int, last_who int, "
         "roles array<string>, texts array<string>")


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in text.split(", ")])


def _finish(rows: Rows) -> dict:
    cost, choices, state = tables().repair(rows.symbols)
    closing = closing_inserts(state)
    lines = repaired_lines(choices, START, *rows.texts(), closing)
    first, last, distinct = rows.turns or (0, 0, 1)
    return dict(zip(("blank", "duplicate", "truncated", "illegal"), rows.counts)) | {
        "gaps": last - first + 1 - distinct, "cost": cost, "audit": audit_of(choices, closing),
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _piece(rows: Rows, no: int) -> dict:
    roles, texts = rows.texts()
    out = dict(zip(("blank", "duplicate", "truncated", "illegal"), rows.counts))
    out |= {"no": no, "symbols": rows.symbols, "roles": roles, "texts": texts}
    if rows.turns:
        out |= dict(zip(("first_turn", "last_turn", "distinct_turns"), rows.turns))
    if rows.ends:
        out |= dict(zip(("first_who", "last_who"), rows.ends))
    return out


def _conversations(piece_rows: int):
    """Finished conversations (``no`` null) and pieces of those that other ranges,
    or later pieces, may continue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(RESULT + ", " + PIECE)
        held, held_bytes, held_rows, no, is_open = [], 0, 0, 0, True

        def out(found):
            if found:
                ids = pa.concat_arrays([i for i, _ in found])
                rest = pa.RecordBatch.from_pylist([r for _, r in found], schema)
                yield pa.RecordBatch.from_arrays([ids, *rest.columns], names=["conv_id", *schema.names])

        def close(last: bool):
            nonlocal no
            whole = pa.concat_tables(held).combine_chunks()
            held.clear()
            key = whole.column("conv_id").slice(0, 1).combine_chunks()
            rows = Rows(whole)
            if last:
                no += 1
                return key, _piece(rows, no)
            return key, _finish(rows)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            ids = table.column("conv_id").combine_chunks()
            if held:
                before = held[-1].column("conv_id").combine_chunks()
                ids = pa.concat_arrays([before.slice(len(before) - 1), ids])
            a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            differs |= a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(differs) + (0 if held else 1)
            found, at = [], 0
            for begin in [*starts.tolist(), table.num_rows]:  # a conversation begins at each but the last
                part = table.slice(at, begin - at)
                if part.num_rows:
                    held.append(part)
                    held_rows += part.num_rows
                    held_bytes += part.nbytes
                if begin < table.num_rows:
                    found.append(close(is_open))
                    held_rows, held_bytes, is_open = 0, 0, False
                elif held_rows >= piece_rows or held_bytes >= PIECE_BYTES:
                    found.append(close(True))
                    held_rows, held_bytes, is_open = 0, 0, True
                    held.append(_marker(table.schema, found[-1][0]))
                at = begin
            yield from out(found)
        if held:
            yield from out([close(True)])

    return run


def _marker(schema: pa.Schema, key: pa.Array) -> pa.Table:
    """A row without copies, which says which conversation goes on."""
    row = {"n": 0, "first": False, "blank": False, "cut": False, "who": 4}
    return pa.table([key if f.name == "conv_id" else pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)


def _trace_pieces(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a piece of a conversation: its edits, the state before it, the
    inserts that close the conversation; and the conversation's figures in the first."""
    pieces = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["no"]))
    cost, choices, state = tables().repair(b"".join(p["symbols"] for p in pieces))
    total = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
    turned = [p for p in pieces if p["distinct_turns"]]
    distinct = sum(p["distinct_turns"] for p in turned) - sum(
        a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
    total["gaps"] = turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0
    spoken = [p for p in pieces if p["first_who"]]
    total["illegal"] += _illegal(np.array([p["last_who"] for p in spoken[:-1]], int), np.array([p["first_who"] for p in spoken[1:]], int))
    total["cost"] = cost
    at, before, out = 0, START, []
    for i, p in enumerate(pieces):
        mine = choices[at : at + len(p["symbols"])]
        closing = closing_inserts(state) if i == len(pieces) - 1 else 0
        out.append(total | {"part": p["part"], "no": p["no"], "before": before, "closing": closing, "audit": audit_of(mine, closing)})
        at += len(mine)
        before = mine[-1][2] if mine else before
    rest = pa.RecordBatch.from_pylist(out, _schema(TRACED))
    ids = pa.array([key[0].as_py()] * len(out), key[0].type)
    yield pa.RecordBatch.from_arrays([ids, *rest.columns], names=["conv_id", *rest.schema.names])


TRACED = ("part int, no int, before int, closing int, gaps long, blank long, duplicate long, truncated long, "
          "illegal long, cost long, audit string")


def _edit_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text of every piece, null where nothing of it is left."""
    for batch in batches:
        texts = []
        for r in batch.select(["audit", "before", "closing", "roles", "texts"]).to_pylist():
            audit, state, choices, inserts = r["audit"], r["before"], [], 0
            body = audit[: len(audit) - r["closing"]] if r["closing"] else audit
            after, at = state, 0
            for e in body:
                if e == "I":
                    inserts, after = inserts + 1, NEXT[after]
                    continue
                if e == "K":
                    after = KEEP[_initial(r["roles"][at])][after]
                elif e == "R":
                    after = NEXT[after]
                choices.append((inserts, e, after))
                inserts, at = 0, at + 1
            lines = repaired_lines(choices, state, r["roles"], r["texts"], r["closing"])
            texts.append("\n".join(lines) if lines else None)
        keep = [c for c in batch.schema.names if c not in ("roles", "texts")]
        yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(texts, pa.string())], names=[*keep, "repaired"])


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> one row a conversation; only the hash, the audit so far
    and one batch of pieces are held."""
    held, digest, audit, key, begun = None, None, [], None, False
    names = RESULT.split(", ")

    def result():
        row = {k: held[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        row |= {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        rest = pa.RecordBatch.from_pylist([row], _schema(", ".join(names)))
        return pa.RecordBatch.from_arrays([pa.array([key[1]], key[0]), *rest.columns], names=["conv_id", *rest.schema.names])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if held is None or key != (kind, r["conv_id"]):
                if held is not None:
                    yield result()
                held, digest, audit, key, begun = r, hashlib.sha256(), [], (kind, r["conv_id"]), False
            audit.append(r["audit"])
            if r["repaired"] is not None:
                digest.update((("\n" if begun else "") + r["repaired"]).encode())
                begun = True
    if held is not None:
        yield result()


# ------------------------------------------------------------------ the operator


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with one row more per row (``n`` copies of it remain) after
    the damage that crc32(``conv_id:turn``) % 20 names; null is one space."""
    space = F.lit(" ")
    code = F.crc32(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, F.lit("user")).when(F.col("code") != 0, F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .when(F.col("code") != 0, F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n"))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``rows(conv_id, turn, role, text, n)`` (n copies of a row; none only names
    its conversation) -> one row per ``conv_id``: ``gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``.

    Rows of a conversation are taken by turn, nulls first, those of one turn by role
    and text in byte order; of equal rows the first is the original.  Null role and
    text count as one space.  A null ``conv_id`` is a conversation like others.  A
    conversation without rows has zeros, an empty audit and the hash of the empty
    string; an empty table gives an empty result.  Roles other than those beginning
    with s, u, a cannot be kept.  Texts are taken whole.  Other columns are ignored,
    whatever their names.
    """
    spark = rows.sparkSession
    C.python_ready(spark)
    space = F.lit(" ")
    live = F.col("n") > 0
    rows = rows.select(
        "conv_id", "turn", F.when(live, F.coalesce("role", space)).alias("role"),
        F.when(live, F.coalesce("text", space)).alias("text"), "n")
    rows = C.stored(
        rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
        .withColumn("digest", F.sha2("text", 256)), "rows")
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = (
        rows.where(live).groupBy("conv_id", "role", "digest")
        .agg(F.min(order).alias("earliest"), F.count("*").alias("times")).where("times > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "earliest"))
    marked = rows.withColumn("order", order).join(
        repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    marked = marked.select(
        "conv_id", "turn", "role", "text", "n",
        (F.col("earliest").isNull() | (F.col("order") == F.col("earliest"))).alias("first"),
        F.coalesce(last == "", F.lit(True)).alias("blank"),
        F.coalesce(~last.isin("", ".", "!", "?"), F.lit(False)).alias("cut"),
        F.coalesce(F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3), F.lit(4)).cast("int").alias("who"))
    by = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ranges = marked.repartitionByRange(*by).sortWithinPartitions(*by)
    key = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    done = C.stored(
        ranges.mapInArrow(_conversations(piece_rows), f"{key}, {RESULT}, {PIECE}")
        .withColumn("part", F.spark_partition_id()), "conversations")
    whole = done.where("no IS NULL").drop(*_schema(PIECE).names, "part")

    pieces = done.where("no IS NOT NULL")
    traced = C.stored(
        pieces.select("conv_id", "part", "no", "symbols", "first_turn", "last_turn", "distinct_turns", "first_who", "last_who",
                      "blank", "duplicate", "truncated", "illegal")
        .groupBy("conv_id").applyInArrow(_trace_pieces, f"{key}, {TRACED}"), "traced")
    texts = pieces.select(F.col("part").alias("p"), F.col("no").alias("k"), "roles", "texts")
    edited = traced.join(texts, (F.col("part") == F.col("p")) & (F.col("no") == F.col("k"))).drop("p", "k")
    edited = edited.mapInArrow(_edit_pieces, f"{key}, {TRACED}, repaired string")
    hashed = edited.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(_hash_pieces, f"{key}, {RESULT}")
    return whole.unionByName(hashed)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``damaged``: one row per original ``conv_id``."""
    return repair(damaged(conversations))
