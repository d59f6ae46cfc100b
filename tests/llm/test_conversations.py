"""Conversation repair against a plain recursion over whole audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostscope.llm import conversations as cv

ROWS = "conv_id long, turn long, role string, text string"
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
CHOICE = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """rows: (initial, must go, truncated) -> (cost, audit), the ASCII-least of the cheapest."""

    def with_inserts(best):
        for _ in range(4):
            best = {s: min(best[s], (best[CHOICE[s]][0] + 3, "I" + best[CHOICE[s]][1])) for s in best}
        return best

    best = with_inserts({s: (0, "") if s in ("", "a") else (10**9, "") for s in CHOICE})
    for initial, gone, cut in reversed(rows):
        here = {}
        for state in CHOICE:
            options = [(best[state][0] + 4, "D" + best[state][1])]
            if not gone:
                if (state, initial) in MOVES:
                    c, s = best[MOVES[state, initial]]
                    options.append((c + 3 * cut, "K" + s))
                c, s = best[CHOICE[state]]
                options.append((c + 3 + 3 * cut, "R" + s))
            here[state] = min(options)
        best = with_inserts(here)
    return best[""]


def brute(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        kept = convs[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        row = (turn, "user" if code == 4 else role, text)
        kept.extend([row] * (2 if code == 3 else 1))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else
                          "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(tuple(
            (role[:1], fault in ("blank", "duplicate"), fault == "truncated") for (_, role, _), fault in zip(rows, faults)))
        lines, state, at = [], "", 0
        for e in audit:
            if e in "IR":
                state = CHOICE[state]
                lines.append(FULL[state] + ":" + (rows[at][2] if e == "R" else ""))
            elif e == "K":
                state = rows[at][1][:1]
                lines.append(rows[at][1] + ":" + rows[at][2])
            at += e != "I"
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.select("conv_id", *[f.split()[0] for f in cv.RESULT.split(", ")]).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def odd_table(seed=3, convs=120):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent", "System"]
    texts = ["Hi.", "Hello there", "Why?", "", None, " \t\n", "Yes!  \n", "ok", "ok.", "word " * 50 + "end.", "É　"]
    rows = []
    for c in range(convs):
        n = r.choice([0, 1, 2, 3, 5, 8, 13])
        for t in range(n):
            turn = r.choice([t, t, t, t + 2, None, t // 2])
            rows.append((r.choice([c, c, c, None]) if c % 40 == 0 else c, turn, r.choice(roles), r.choice(texts)))
    rows += rows[:15]
    return rows


def test_equals_brute_force_on_odd_rows(spark):
    rows = odd_table()
    df = spark.createDataFrame(rows, ROWS).withColumn("n", F.lit("x")).withColumn("first", F.lit(1)).repartition(5)
    assert as_dict(cv.damage_and_repair(df)) == brute(rows)


def test_long_conversations_come_in_pieces(spark):
    """Half of all rows in one conversation, more rows than a piece and a range hold."""
    r = random.Random(9)
    rows = [(5, t // 2 if t % 50 else None, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", f"t{t}.", f"u{t}", ""]))
            for t in range(700)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(10, 60) for t in range(8)]
    df = spark.createDataFrame(rows, ROWS)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        assert as_dict(cv.repair(cv.damaged(df), piece_rows=7)) == brute(rows)
    finally:
        spark.conf.set(key, before)


def test_empty_table_and_dropped_rows(spark):
    assert cv.damage_and_repair(spark.createDataFrame([], ROWS)).count() == 0
    gone = next((c, t) for c in range(100) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = as_dict(cv.damage_and_repair(spark.createDataFrame([(*gone, "user", "Hi.")], ROWS)))
    assert got == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_blocks_agree_with_single_steps():
    r = random.Random(1)
    t = cv.tables()
    for n in range(40):
        symbols = bytes(r.randrange(len(cv.SYMBOLS)) for _ in range(n))
        cost, choices, state = t.repair(symbols)
        rows = [(cv.SYMBOLS[s].lower(), s == 0, cv.SYMBOLS[s].isupper()) for s in symbols]
        assert (cost, cv.audit_of(choices, cv.closing_inserts(state))) == cheapest(tuple(rows))


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001/conversations.parquet"])
def test_given_table(spark, table):
    df = spark.read.parquet(table)
    assert as_dict(cv.damage_and_repair(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
