"""Glossary notes as terms, terms defined twice, and mentions of terms in notes.

A glossary whose names and paths are proven to take at most ``BROADCAST_BYTES`` is sent to the tasks that parse the
notes. Of a larger one, of any size, tasks get a filter of fixed size: every note is read once, what passes the filter is
joined with the terms by name, and one pass over a note's hits keeps what a single automaton would have found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import columns as C, markdown
from graphloom.functions.terms import PIECE, Matcher, Sieve, closed, marks, name_hashes
from graphloom.operators import documents
from graphloom.operators.scratch import Scratch, materialize, small_batches

#: Bytes of names and paths: of a glossary that is broadcast, and of one shard (some 40,000 terms).
BROADCAST_BYTES = 2 << 20
SHARD_BYTES = 2 << 20
#: Words (of 8 bytes) of the filter that each shard adds, and the shards that add theirs: 8 MB at most. Past that more
#: passes the filter, which the join drops.
SHARD_WORDS = 1 << 14
MOST_SHARDS = 64


def terms(files: DataFrame) -> DataFrame:
    """name, path and definition of each note below glossary/."""
    own = C.of_kind(files, "md").filter(F.col("path").startswith("glossary/"))
    return own.select(C.file_stem(F.col("path")).alias("name"), "path", C.excerpt(F.col("content")).alias("definition"))


def duplicates(found: DataFrame) -> DataFrame:
    return found.groupBy("name").agg(F.count("*").alias("n_notes")).filter("n_notes > 1")


def unique(found: DataFrame) -> DataFrame:
    """name and path: of notes that define one term, the first by path counts."""
    return found.filter("name <> ''").groupBy("name").agg(F.min("path").alias("path"))


def annotated(files: DataFrame, found: DataFrame, scratch: Scratch | None = None, broadcast_bytes: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """documents.NOTE of every note of ``files``, with mentions of the terms ``found``."""
    own = materialize(unique(found), "glossary", scratch)
    size = own.agg(F.sum(F.octet_length("name") + F.octet_length("path"))).first()[0] or 0
    if size <= broadcast_bytes:
        rows = own.collect()  # of proven size
        return documents.notes(files, Matcher([(k, r.name, r.path) for k, r in enumerate(rows)]))
    return sharded(files, own, max(1, math.ceil(size / shard_bytes)), scratch)


_AT = ",".join(f"{n}:int" for n in documents.PLACES)
HIT = pa.struct([("at", pa.int64()), ("name", pa.string()), *((n, pa.int32()) for n in documents.PLACES)])
#: A note with all that may be mentions, outside code and brackets.
SEEN = documents.NOTE.split(", mentions")[0] + f", hits array<struct<at:bigint,name:string,{_AT}>>"
_SEEN = pa.schema([("path", pa.string()), ("headings", pa.list_(pa.string())), ("links", pa.list_(documents.LINK)), ("hits", pa.list_(HIT))])


def _marks(words: int):
    def run(batches):
        for batch in batches:
            at, bits = marks(name_hashes(batch.column("name").to_pylist()), words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view("int64"))], ["at", "bits"])

    return run


def sieve(own: DataFrame, shards: int) -> Sieve:
    """A filter of the names of ``own``, of ``SHARD_WORDS`` for each shard but ``MOST_SHARDS`` of them at most."""
    words = SHARD_WORDS * min(shards, MOST_SHARDS)
    ascii_ = F.length(F.regexp_extract("name", r"^[\x00-\x7F]*", 0))
    shapes = own.select(F.when(ascii_ == F.length("name"), -1).otherwise(ascii_).alias("first"), F.length("name").alias("n")).distinct().collect()
    found = own.select("name").mapInArrow(_marks(words), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row for each word at most
    table = np.zeros(words, np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Sieve(table, [tuple(r) for r in shapes])


def _hits(terms: Sieve):
    def some(paths: list[str], texts: list[str]) -> pa.RecordBatch:
        notes, asked, at, names, spans, ends = [markdown.read(text) for text in texts], [], [], [], [], [0]
        for text, note, found in zip(texts, notes, terms.places(texts, [n.body for n in notes]), strict=True):
            lines, ranges = markdown.Lines(text), closed(note)
            starts = [a for a, _ in ranges]
            for a, n in found:
                if not markdown.inside(a, ranges, starts):
                    at.append(a)
                    names.append(text[a : a + n])
                    spans.append(documents.span(lines, a, a + n))
            ends.append(len(at))
            asked.append(documents.links(note, lines))
        places = [pa.array([s[k] for s in spans], pa.int32()) for k in range(len(documents.PLACES))]
        hits = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(names, pa.string()), *places], fields=list(HIT))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([n.headings for n in notes], pa.list_(pa.string())), pa.array(asked, pa.list_(documents.LINK)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)], schema=_SEEN)

    def run(batches):
        for batch in batches:
            paths, texts, size = [], [], 0
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                paths.append(path)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= PIECE:
                    yield some(paths, texts)
                    paths, texts, size = [], [], 0
            if paths:
                yield some(paths, texts)

    return run


def _reconcile(batches) -> Iterator[pa.RecordBatch]:
    """Before a note come the names that are no terms and its own: at each place the longest term, then from left to right."""
    key, none, own = None, set(), None
    for batch in batches:
        hits = batch.column("hits")
        flat, first = hits.flatten(), 0  # nulls take no room
        at, names = flat.field("at").to_pylist(), flat.field("name").to_pylist()
        rows, kept, ends = [], [], [0]
        for row, (path, name, mine, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "name", "mine")), pc.list_value_length(hits).to_pylist(), strict=True)):
            if path != key:
                key, none, own = path, set(), None
            if name is not None:
                if mine:
                    own = name
                else:
                    none.add(name)
                continue
            k, stop, free = first, first + n, 0
            first = stop
            while k < stop:
                start, best = at[k], None
                while k < stop and at[k] == start:  # in order of length
                    best = best if names[k] in none else k
                    k += 1
                if best is not None and start >= free:
                    free = start + len(names[best])
                    if names[best] != own:
                        kept.append(best)
            rows.append(row)
            ends.append(len(kept))
        if rows:
            said = flat.take(pa.array(kept, pa.int64()))
            said = pa.StructArray.from_arrays([said.field(f.name) for f in documents.MENTION], fields=list(documents.MENTION))
            notes = batch.select(["path", "headings", "links"]).take(pa.array(rows, pa.int64()))
            yield notes.append_column("mentions", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), said))


def sharded(files: DataFrame, own: DataFrame, shards: int, scratch: Scratch | None = None) -> DataFrame:
    """As :func:`annotated`, with terms ``own`` (unique names, paths) in a filter for ``shards``. Paths of notes are unique.

    Contents are read once and not moved: what passes the filter is looked up among the terms by name, each name once for a note.
    """
    seen = materialize(small_batches(C.of_kind(files, "md").select("path", "content")).mapInArrow(_hits(sieve(own, shards)), SEEN), "seen", scratch)
    asked = seen.select("path", F.explode(F.array_distinct("hits.name")).alias("name"))
    null = lambda c: F.lit(None).cast(seen.schema[c].dataType).alias(c)
    told = lambda df, mine: df.select("path", "name", F.lit(mine).alias("mine"), *map(null, ("headings", "links", "hits")))
    names = told(asked.join(own.select("name"), "name", "left_anti"), False).unionByName(told(own, True))
    both = names.unionByName(seen.select("path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("mine"), "headings", "links", "hits"))
    return both.repartition("path").sortWithinPartitions("path", F.col("name").isNull()).mapInArrow(_reconcile, documents.NOTE)


def said(parsed: DataFrame) -> DataFrame:
    """One row for each mention in notes that were parsed with a glossary."""
    return parsed.select("path", F.explode("mentions").alias("m")).select("path", "m.*")


def mentions(files: DataFrame, found: DataFrame) -> DataFrame:
    """Every mention of a term in a note of ``files``."""
    return said(annotated(files, found))
