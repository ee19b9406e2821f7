"""Conversation repair against all sequences of edits, and against a table filled row by row."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, conversations as C, registry

GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("b" if BLANK.fullmatch(text) else "d" if (role, text) in seen else "-" if last in ".!?" else "t")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Least (cost, audit) over all edit sequences with up to three inserted turns."""
    faults, best = plain_faults(rows), None
    for more in range(4):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), more):
            choices = [[("I", "u"), ("I", "a")]] * more
            for inserted in itertools.product(*choices):
                for edits in itertools.product("KuaD", repeat=len(rows)):
                    out, cost, roles, k = "", 0, "", 0
                    for at in range(len(rows) + 1):
                        while k < more and places[k] == at:
                            out, cost, roles, k = out + "I", cost + 2, roles + inserted[k][1], k + 1
                        if at == len(rows):
                            break
                        e = edits[at]
                        if e == "D":
                            out, cost = out + "D", cost + 3
                            continue
                        if faults[at] in "bd" or e == "K" and rows[at][0] == "":
                            cost = None
                            break
                        cost += (0 if e == "K" else 2) + (faults[at] == "t")
                        out, roles = out + ("K" if e == "K" else "R"), roles + (rows[at][0][:1] if e == "K" else e)
                    if cost is not None and GRAMMAR.fullmatch(roles) and (best is None or (cost, out) < best):
                        best = (cost, out)
    return best


def filled(initials, faults):
    """Least (cost, audit) by row: each row's four states from the last row's, inserts until nothing changes."""
    best = {0: (0, "")}
    for k in range(len(initials) + 1):
        while True:
            more = {}
            for state, (cost, audit) in best.items():
                to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                new = (cost + 2, audit + "I")
                if new < best.get(to, (1 << 60, "")) and new < more.get(to, (1 << 60, "")):
                    more[to] = new
            if not more:
                break
            best |= more
        if k == len(initials):
            return min(best[s] for s in (0, 3) if s in best)
        after = defaultdict(list)
        for state, (cost, audit) in best.items():
            after[state].append((cost + 3, audit + "D"))
            if faults[k] not in "bd":
                extra = faults[k] == "t"
                after[{0: 2, 1: 2, 2: 3, 3: 2}[state]].append((cost + 2 + extra, audit + "R"))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initials[k]))
                if to is not None:
                    after[to].append((cost + extra, audit + "K"))
        best = {s: min(v) for s, v in after.items()}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text = say(role), say(text)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_report(original, damaged):
    groups = {conv: [] for conv, *_ in original}
    for row in damaged:
        groups[row[0]].append(row[1:])
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [(role, text) for _, role, text in rows]
        faults = plain_faults(pairs)
        turns = {t for t, *_ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [role[:1] for role, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = filled(initials, faults)
        lines, at, said = [], 0, ""
        for e in audit:
            need = "a" if said.endswith("u") else "u"
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[need] + ":")
            elif e == "K":
                lines.append(":".join(pairs[at]))
                need = pairs[at][0][0]
            elif e == "R":
                lines.append({"u": "user", "a": "assistant"}[need] + ":" + pairs[at][1])
            at += e != "I"
            said += "" if e == "D" else need
        assert GRAMMAR.fullmatch(said)
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_search_equals_all_sequences():
    r = random.Random(13)
    for _ in range(120):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["a.", "b.", "c", " ", "d!"])) for _ in range(r.randrange(0, 4))]
        found = C.search(tuple(x[:1] for x, _ in rows), "".join(plain_faults(rows)))
        assert found[:2] == exhaustive(rows), rows


def test_search_equals_a_filled_table():
    r = random.Random(14)
    for _ in range(400):
        n = r.randrange(0, 40)
        initials, faults = [r.choice("suaux ") for _ in range(n)], "".join(r.choice("--tbd") for _ in range(n))
        assert C.search(tuple(initials), faults)[:2] == filled(initials, faults)


def test_the_table(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert told(registry.op13_conversation_repair(spark, sf)) == plain_report(rows, plain_damage(rows))


def odd_rows():
    r = random.Random(15)
    rows = [(c, t, r.choice(["system", "user", "assistant"]), r.choice(["x.", "y", "z!", "", " ", "long? yes"])) for c in range(12) for t in range(r.randrange(1, 30))]
    rows += [(None, t, role, "n.") for t in (None, None, 3, -7) for role in ("user", None, "assistant", "")]
    rows += [(90, None, "user", None), (91, 5, None, "q."), (92, 5, "user", "tie b."), (92, 5, "user", "tie a."), (92, 5, "assistant", "tie."), (93, 1, "üser", "é😀."), (94, (1 << 63) - 1, "user", "x."), (94, -(1 << 63), "user", "y.")]
    rows += [(95, 1, "user", "same.")] * 9 + [(96, t, "user", f"line {t}.") for t in range(300)] + [(97, None, "user", f"{t}.") for t in range(40)]
    return rows


@pytest.mark.parametrize("s", [C.Settings(), C.Settings(shift=1), C.Settings(shift=3, most_rows=2), C.Settings(most_rows=5), C.Settings(most_chars=10)])
def test_odd_rows_in_any_cut(spark, s):
    rows = odd_rows()
    df = spark.createDataFrame([(*x, "clash", "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, k string, items string, piece int")
    bad = C.damaged(df)
    want = plain_report(rows, plain_damage(rows))
    want = [tuple(min(v, (1 << 63) - 1) if isinstance(v, int) else v for v in row) for row in want]
    repaired = C.repair(bad, s)
    assert told(C.report(df, repaired)) == want
    turns = repaired.turns()
    edits = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "edit"))), lambda p: p["edit"]), "").alias("audit"))
    assert {r.conv_id: r.audit for r in edits.collect()} == {row[0]: row[7] for row in want if row[7]}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.report(empty, C.repair(empty)).count() == 0
    gone = spark.createDataFrame([(c, 1, "user", "x.") for c in range(60)], "conv_id long, turn long, role string, text string")
    dropped = [c for c in range(60) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    got = {r.conv_id: r for r in C.report(gone, C.repair(C.damaged(gone))).collect()}
    assert dropped and all(got[c].audit == "" and got[c].cost == 0 and got[c].repaired_sha256 == hashlib.sha256(b"").hexdigest() for c in dropped)


def test_a_very_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(20_000)] + [(2, 0, "user", "x" * 20_000_000), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = told(C.report(df, C.repair(df)))
    assert [r[:7] for r in got] == [(1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 1, 0, 1)] and got[0][7] == "K" * 20_000
    assert got == plain_report(rows, rows)
