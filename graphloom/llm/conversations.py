"""Conversations repaired to a grammar of turns by the cheapest edits, found by Dijkstra's search.

Roles, by their first letters, are to read ``(s?(ua)+)?``: at most one system turn, then user and assistant
by turns, or nothing. A lattice has a node for each row index and state of the grammar; its edges are edits
of a row (keep, give another role, delete) and inserted empty turns. It is made as it is searched, with
priority (cost, audit), where the audit is the string of the edits' initials so far; the first accepting end
that leaves the queue has the least cost and, of those, the ASCII-least audit.

Rows are in the order of turn (nulls first), role and text. A conversation may hold any share of all
rows: it is dealt out in segments of ``2**shift`` turn numbers (rows without a turn by role and first characters of
the text), which are read as a stream and cut at ``most_rows`` rows or ``most_chars`` characters.
A conversation of one segment, as nearly all are, is repaired where it is read. For others, the search
runs from each state of each segment to each, and the segments' tables are joined in order. Joining is
exact: of two ways to a node with equal costs, neither audit begins the other, so a
smaller one stays smaller whatever follows.

Nulls in role and text stand for one space, as :func:`repair` says. A null conv_id is a conversation. Rows that
are repeated are duplicates, as the contents are the same. An empty role is in no state's reach: it is
given another or goes. An empty table has no conversations. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

# Costs of edits by their initials, and what an undeleted truncated row adds.
COSTS = {"K": 0, "R": 2, "I": 2, "D": 3}
TRUNCATED = 1
#: States: 0 before anything, 1 after a system turn, 2 after a user's, 3 after an assistant's.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = range(4), (0, 3)
#: The letter that an inserted turn or a new role has in each state: there is one for each.
TURN = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
LONG = (1 << 63) - 1

KEY = ("k", "b", "r", "t", "piece")
ITEM = "struct<turn:long,role:string,text:string,edit:string,new_role:string>"
#: A segment: what it holds, and its edits as if it were the whole conversation.
SEGMENT = (
    "k string, conv_id {id}, b long, r string, t string, piece int, initials array<string>, faults string, marks array<binary>, "
    "low long, high long, n_turns long, cost long, audit string, items array<" + ITEM + ">"
)


@dataclass(frozen=True)
class Settings:
    shift: int = 10
    most_rows: int = 4096
    most_chars: int = 8 << 20


def search(initials: tuple[str, ...], faults: str, start: int = 0, ends: tuple[int, ...] = ACCEPTING) -> tuple[int, str, int] | None:
    """:func:`dijkstra`, with what it finds for short conversations kept, as most are alike."""
    return (_kept if len(faults) <= 32 else dijkstra)(initials, faults, start, ends)


def dijkstra(initials: tuple[str, ...], faults: str, start: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Cost, audit and last state of the cheapest edits from ``start`` to one of ``ends``; None if none are reached.

    ``faults`` has a letter a row: b(lank) and d(uplicate) must go, t(runcated) costs more unless it goes.
    """
    queue, settled, n = [(0, "", 0, start)], set(), len(initials)
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in settled:
            continue
        if i == n and state in ends:
            return cost, audit, state
        settled.add((i, state))
        onward = STEPS[state, TURN[state]]
        heappush(queue, (cost + COSTS["I"], audit + "I", i, onward))
        if i == n:
            continue
        heappush(queue, (cost + COSTS["D"], audit + "D", i + 1, state))
        if faults[i] in "bd":
            continue
        more = TRUNCATED if faults[i] == "t" else 0
        heappush(queue, (cost + COSTS["R"] + more, audit + "R", i + 1, onward))
        kept = STEPS.get((state, initials[i]))
        if kept is not None:
            heappush(queue, (cost + COSTS["K"] + more, audit + "K", i + 1, kept))
    return None


_kept = lru_cache(maxsize=50_000)(dijkstra)


def script(rows: list[dict], audit: str, state: int = 0) -> list[dict]:
    """The edits of ``audit`` from ``state``: rows with edit and new_role (null if deleted), and inserted ones."""
    out, at = [], 0
    for edit in audit:
        row = {"turn": None, "role": None, "text": ""} if edit == "I" else rows[at]
        at += edit != "I"
        letter = row["role"][:1] if edit == "K" else TURN[state]
        new = None if edit == "D" else row["role"] if edit == "K" else NAMES[letter]
        state = state if edit == "D" else STEPS[state, letter]
        out.append({"turn": row["turn"], "role": row["role"], "text": row["text"], "edit": edit, "new_role": new})
    return out


def fault(text: str, again: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or -: a row's first fault."""
    told = text.rstrip(WHITE)
    return "b" if not told else "d" if again else "-" if told[-1] in ".!?" else "t"


def _mark(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class _Segment:
    """Rows of one key, in order, as they come from a stream."""

    def __init__(self, key: tuple, conv_id, piece: int):
        self.key, self.conv_id, self.piece = key, conv_id, piece
        self.rows, self.marks, self.faults, self.chars = [], [], [], 0
        self.seen: set[bytes] = set()

    def add(self, turn, role: str, text: str) -> None:
        mark = _mark(role, text)
        self.faults.append(fault(text, mark in self.seen))
        self.seen.add(mark)
        self.rows.append({"turn": turn, "role": role, "text": text})
        self.marks.append(mark)
        self.chars += len(text)

    def row(self) -> dict:
        turns = [r["turn"] for r in self.rows if r["turn"] is not None]
        initials, faults = [r["role"][:1] for r in self.rows], "".join(self.faults)
        cost, audit, _ = search(tuple(initials), faults)
        k, b, r, t = self.key
        return {
            "k": k, "conv_id": self.conv_id, "b": b, "r": r, "t": t, "piece": self.piece, "initials": initials, "faults": faults, "marks": self.marks,
            "low": min(turns, default=None), "high": max(turns, default=None), "n_turns": len(set(turns)), "cost": cost, "audit": audit, "items": script(self.rows, audit),
        }


def _segments(s: Settings, schema: pa.Schema):
    def run(batches):
        own: _Segment | None = None
        done, chars = [], 0
        for batch in batches:
            for k, conv_id, b, r, t, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "conv_id", "b", "r", "t", "turn", "role", "text")), strict=True):
                key = (k, b, r, t)
                if own is None or own.key != key or len(own.rows) >= s.most_rows or own.chars >= s.most_chars:
                    piece = 0
                    if own is not None:
                        piece = own.piece + 1 if own.key == key else 0
                        done.append(own.row())
                        chars += own.chars
                    own = _Segment(key, conv_id, piece)
                own.add(turn, role, text)
                if chars > 1 << 21 or len(done) > 2000:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, chars = [], 0
        if own is not None:
            done.append(own.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return run


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with a space for a null role or text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def segments(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """SEGMENT rows of conversations (conv_id, turn, role, text), written: one shuffle of the rows."""
    spark = conversations.sparkSession
    unturned = F.col("turn").isNull()
    dealt = rows_of(conversations).select(
        F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("")).alias("k"), "conv_id", F.shiftright("turn", s.shift).alias("b"),
        F.when(unturned, F.col("role")).alias("r"), F.when(unturned, F.substring("text", 1, 2)).alias("t"), "turn", "role", "text",
    )
    ordered = common.to_python(dealt.repartition("k", "b", "r", "t").sortWithinPartitions("k", "b", "r", "t", "turn", "role", "text"))
    schema = SEGMENT.format(id=dict(dealt.dtypes)["conv_id"])
    return common.materialize(ordered.mapInArrow(_segments(s, _arrow(spark, schema)), schema), "segments")


def without_repeats(parts: DataFrame) -> DataFrame:
    """KEY and the faults of segments of long conversations, with rows that an earlier segment has marked as duplicates."""
    place = F.struct(*KEY[1:], "at")
    rows = parts.select(*KEY, F.posexplode("marks").alias("at", "mark"))
    first = rows.groupBy("k", "mark").agg(F.min(place).alias("p")).select("k", "p.*")
    kept = first.groupBy(*KEY).agg(F.collect_set("at").alias("firsts"))  # most_rows at most
    kept = kept.withColumnsRenamed({c: f"f_{c}" for c in KEY})
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in KEY]
    letters = F.filter(F.split("faults", ""), lambda c: c != "")
    again = F.transform(letters, lambda c, i: F.when((c == "b") | F.coalesce(F.array_contains("firsts", i), F.lit(False)), c).otherwise("d"))
    return parts.join(kept, same, "left").select(*KEY, "initials", F.array_join(again, "").alias("faults"))


TABLE = "k string, b long, r string, t string, piece int, faults string, costs array<long>, audits array<string>"
CHOSEN = "k string, b long, r string, t string, piece int, faults string, start int, cost long, audit string"


def _tables(batches):
    """Each segment's cheapest edits from every state to every state; no cost where there are none."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            found = [search(tuple(row["initials"]), row["faults"], a, (b,)) for a in STATES for b in STATES]
            out.append({**{c: row[c] for c in KEY}, "faults": row["faults"], "costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found]})
        yield pa.RecordBatch.from_pylist(out, _arrow_of(TABLE))


def _arrow_of(schema: str) -> pa.Schema:
    """For the plain types of TABLE and CHOSEN, in tasks, where there is no session."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


class _Way:
    """A cheapest way to one state after a segment: its last piece, and the way before."""

    __slots__ = ("before", "audit", "start", "row", "cost")

    def __init__(self, before, audit, start, row, cost):
        self.before, self.audit, self.start, self.row, self.cost = before, audit, start, row, cost


def _less(a: _Way, b: _Way) -> bool:
    """Whether the audit of ``a`` is ASCII-less than that of ``b``: ways as long, read from where they part."""
    left, right = [], []
    while a is not b and a is not None:
        left.append(a.audit)
        right.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(left)) < "".join(reversed(right))


def _joined(batches):
    """Segments of a conversation come in order: of the ways to each state the best stays; the best accepting one is given out."""
    ways: dict[int, _Way | None] = {}
    key = None

    def chosen():
        best = None
        for state in ACCEPTING:
            way = ways.get(state)
            if way is not None and (best is None or way.cost < best.cost or way.cost == best.cost and _less(way, best)):
                best = way
        while best is not None:
            before = best.before.cost if best.before else 0
            yield {**{c: best.row[c] for c in KEY}, "faults": best.row["faults"], "start": best.start, "cost": best.cost - before, "audit": best.audit}
            best = best.before

    for batch in batches:
        for row in batch.to_pylist():
            if row["k"] != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist(list(chosen()), _arrow_of(CHOSEN))
                key, ways = row["k"], {0: None}
            after: dict[int, _Way] = {}
            for start, way in ways.items():
                for end in STATES:
                    cost = row["costs"][4 * start + end]
                    if cost is None:
                        continue
                    new = _Way(way, row["audits"][4 * start + end], start, row, cost + (way.cost if way else 0))
                    old = after.get(end)
                    if old is None or new.cost < old.cost or new.cost == old.cost and _less(new, old):
                        after[end] = new
            ways = after
    if key is not None:
        yield pa.RecordBatch.from_pylist(list(chosen()), _arrow_of(CHOSEN))


def _again(schema: pa.Schema):
    """Segments with the edits chosen for them in place of those as if each stood alone."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = [i for i in row["items"] if i["edit"] != "I"]
                out.append({**{n: row[n] for n in schema.names}, "faults": row["c_faults"], "cost": row["c_cost"], "audit": row["c_audit"], "items": script(rows, row["c_audit"], row["c_start"])})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


@dataclass(frozen=True)
class Repaired:
    """Edit scripts, in columns SEGMENT.

    ``every`` holds all segments as if each were a whole conversation, ``many`` the keys of conversations that
    have several, and ``long`` the segments of those as they are to be edited; both are None if there are none.
    """

    every: DataFrame
    many: DataFrame | None = None
    long: DataFrame | None = None

    def short(self, *columns) -> DataFrame:
        """Columns, k among them, of conversations of one segment."""
        own = self.every.select(*columns)
        return own if self.many is None else own.join(self.many, "k", "left_anti")

    def turns(self) -> DataFrame:
        """conv_id, place (segments and items in order), edit, turn, role, new_role and text: a row an edit."""
        columns = ("conv_id", *KEY, "items")
        rows = self.short(*columns) if self.long is None else self.short(*columns).unionByName(self.long.select(*columns))
        return rows.select("conv_id", *KEY[1:], F.posexplode("items").alias("at", "i")).select("conv_id", F.struct(*KEY[1:], "at").alias("place"), "i.*")


def repair(conversations: DataFrame, s: Settings = Settings()) -> Repaired:
    """Edit scripts of all conversations (conv_id, turn, role, text); see the module."""
    spark = conversations.sparkSession
    every = segments(conversations, s)
    many = common.materialize(every.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "long-conversations")
    if many.isEmpty():
        return Repaired(every)
    parts = common.materialize(every.select(*KEY, "initials", "faults", "marks").join(many, "k", "left_semi"), "long-segments")
    tables = without_repeats(parts).mapInArrow(_tables, TABLE)
    ways = tables.repartition("k").sortWithinPartitions(*KEY).mapInArrow(_joined, CHOSEN)
    chosen = common.materialize(ways.withColumnsRenamed({c.split(" ")[0]: f"c_{c.split(' ')[0]}" for c in CHOSEN.split(", ")}), "chosen-edits")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in KEY]
    schema = SEGMENT.format(id=dict(every.dtypes)["conv_id"])
    found = common.to_python(every.join(chosen, same)).mapInArrow(_again(_arrow(spark, schema)), schema)
    return Repaired(every, many, common.materialize(found, "long-repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn``, nulls as one space: a test of what :func:`repair` mends.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its full stops and marks, 3 repeats it, 4
    makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = rows_of(conversations).withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _lines() -> Column:
    kept = F.filter("items", lambda i: i["new_role"].isNotNull())
    return F.transform(kept, lambda i: F.concat(i["new_role"], F.lit(":"), i["text"]))


REPORT = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else min(LONG, high - low + 1 - n)


def _reports(batches):
    """A row for each conversation from its segments in order; lines are hashed as they come, not kept."""
    key, own, digest = None, {}, None

    def row():
        out = {c: own[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        out |= {"k": key, "gaps": _gaps(own["low"], own["high"], own["n"]), "audit": "".join(own["audit"]), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([out], pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split(" ") for c in REPORT.split(", "))]))

    for batch in batches:
        for r in batch.to_pylist():
            if r["k"] != key:
                if key is not None:
                    yield row()
                key, digest, begun = r["k"], hashlib.sha256(), False
                own = {"low": None, "high": None, "n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "last": None}
            if r["low"] is not None:
                own["n"] += r["n_turns"] - (own["high"] == r["low"])  # a turn on both sides of a cut
                own["low"], own["high"] = r["low"] if own["low"] is None else own["low"], r["high"]
            for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                own[name] += r["faults"].count(letter)
            own["illegal"] += _illegal(([own["last"]] if own["last"] is not None else []) + r["initials"])
            own["last"] = r["initials"][-1]
            own["cost"] += r["cost"]
            own["audit"].append(r["audit"])
            for line in r["lines"]:
                digest.update((("\n" if begun else "") + line).encode())
                begun = True
    if key is not None:
        yield row()


def report(conversations: DataFrame, repaired: Repaired) -> DataFrame:
    """conv_id and REPORT for every conversation of ``conversations``, of which ``repaired`` may hold none.

    A digest by SHA-256 is sequential: lines of a long conversation pass through one task, as a stream.
    """
    n = lambda letter: F.length("faults") - F.length(F.replace("faults", F.lit(letter), F.lit("")))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("initials") - 1)), lambda i: F.concat(F.get("initials", i - 1), F.coalesce(F.get("initials", i), F.lit("?"))))
    illegal = F.when(F.size("initials") < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin(*sorted(LEGAL)))))
    spread = F.col("high").cast("decimal(38,0)") - F.col("low") + 1 - F.col("n_turns")
    spread = F.when(spread.isNull(), 0).otherwise(F.least(F.lit(LONG).cast("decimal(38,0)"), spread)).cast("long")
    found = repaired.short(
        "k", spread.alias("gaps"), n("b").cast("long").alias("blank"), n("d").cast("long").alias("duplicate"), n("t").cast("long").alias("truncated"), illegal.cast("long").alias("illegal"),
        "cost", "audit", F.sha2(F.array_join(_lines(), "\n").cast("binary"), 256).alias("repaired_sha256"),
    )
    if repaired.long is not None:
        rows = repaired.long.select(*KEY, "initials", "faults", "low", "high", "n_turns", "cost", "audit", _lines().alias("lines"))
        found = found.unionByName(common.to_python(rows.repartition("k").sortWithinPartitions(*KEY)).mapInArrow(_reports, REPORT))
    every = conversations.select("conv_id").distinct().withColumn("k", F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("")))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    out = every.join(found, "k", "left").select("conv_id", *(v.alias(c) for c, v in zero.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
    return out
