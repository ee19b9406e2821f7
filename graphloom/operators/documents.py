"""Notes and sources parsed to tables: one pass over the files, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import columns as C, markdown, source_code
from graphloom.functions.terms import Matcher
from graphloom.operators.scratch import Scratch, running, small_batches

#: Places are (line, character in code points, character in UTF-16 units), the end outside.
PLACES = ("start_line", "start_char", "end_line", "end_char", "start_utf16", "end_utf16")
LINK = pa.struct([("ordinal", pa.int32()), ("raw", pa.string()), *((n, pa.int32()) for n in PLACES)])
MENTION = pa.struct([("name", pa.string()), *((n, pa.int32()) for n in PLACES)])
_AT = ",".join(f"{n}:int" for n in PLACES)
NOTE = f"path string, headings array<string>, links array<struct<ordinal:int,raw:string,{_AT}>>, mentions array<struct<name:string,{_AT}>>"
SYMBOL = "file string, ordinal int, sym_path array<string>, qualified string, kind string, disambiguator string, " + ", ".join(f"{n} int" for n in (*PLACES, "name_line", "name_char", "name_end_line", "name_end_char", "name_utf16", "name_end_utf16"))
_OWN = [c.split()[0] for c in SYMBOL.split(", ")[2:]]
SOURCE = "file string, symbols array<struct<" + ",".join(c.replace(" ", ":") for c in SYMBOL.split(", ")[2:]) + ">>"
#: Order of extensions in which symbols are numbered.
RANKS = {"rs": 0, "c": 1, "h": 2}


def span(lines: markdown.Lines, a: int, b: int) -> tuple[int, ...]:
    return (*lines.place(a), *lines.place(b), lines.utf16(a), lines.utf16(b))


def links(note: markdown.Note, lines: markdown.Lines) -> list[dict]:
    """The links of a note as values of LINK."""
    return [dict(zip(LINK.names, (k, raw, *span(lines, a, b)), strict=True)) for k, (raw, a, b) in enumerate(note.links)]


def _notes(matcher: Matcher | None):
    def run(batches):
        for batch in batches:
            headings, asked, said = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text = text or ""
                note, lines = markdown.read(text), markdown.Lines(text)
                headings.append(note.headings)
                asked.append(links(note, lines))
                spans = matcher.find(text, note, path) if matcher else []
                said.append([dict(zip(MENTION.names, (matcher.terms[k][1], *span(lines, a, b)), strict=True)) for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(headings, pa.list_(pa.string())), pa.array(asked, pa.list_(LINK)), pa.array(said, pa.list_(MENTION))], ["path", "headings", "links", "mentions"])

    return run


def _sources(batches):
    """A row for each file, with its symbols in order."""
    kinds = [pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 12]
    for batch in batches:
        rows, ends = [], [0]
        for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            text = text or ""
            lines = markdown.Lines(text)
            for own, kind, a, b, c, d in source_code.symbols(path, text):
                rows.append((list(own), "::".join(own), kind, None, *span(lines, a, b), *span(lines, c, d)))
            ends.append(len(rows))
        fields = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=_OWN)
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
        yield pa.RecordBatch.from_arrays([batch.column("path"), found], ["file", "symbols"])


def notes(files: DataFrame, matcher: Matcher | None = None) -> DataFrame:
    """path, headings, links and, given a matcher, mentions of every Markdown file of ``files`` (path, content)."""
    own = C.of_kind(files, "md").select("path", "content")
    return small_batches(own).mapInArrow(_notes(matcher), NOTE)


def docs(files: DataFrame) -> DataFrame:
    """path and stem of every note; contents are not read."""
    return C.of_kind(files, "md").select("path", C.file_stem(F.col("path")).alias("stem"))


def sections(parsed: DataFrame) -> DataFrame:
    """One row for each occurrence of a heading."""
    return parsed.select("path", F.posexplode("headings").alias("ordinal", "heading"))


def references(parsed: DataFrame) -> DataFrame:
    """One row for each link, with what it asks for; positions are no part of that."""
    every = parsed.select(F.col("path").alias("from_path"), F.explode("links").alias("l")).select("from_path", "l.*")
    return every.withColumn("ref", C.parse_reference(F.col("raw"))).select("*", "ref.*").drop("ref")


def sources(files: DataFrame) -> DataFrame:
    """SOURCE: each Rust and C file of ``files`` (path, content) with its definitions, none or more.

    ``disambiguator`` is part of a descriptor, and null: nothing fills it yet.
    """
    own = C.of_kind(files, *RANKS).select("path", "content")
    return small_batches(own).mapInArrow(_sources, SOURCE)


def unfolded(parsed: DataFrame, *more: str) -> DataFrame:
    """A row for each symbol of ``parsed`` (SOURCE), without ids: columns SYMBOL."""
    return parsed.select("file", *more, F.posexplode("symbols").alias("ordinal", "s")).select("file", *more, "ordinal", "s.*")


def symbols(files: DataFrame) -> DataFrame:
    return unfolded(sources(files))


def firsts(parsed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``of`` and ``first``: each file of ``parsed`` (SOURCE, a table) with the id of its first symbol.

    Only files are sorted, by name and number of symbols. Paths are unique.
    """
    rank = F.coalesce(*[F.when(C.extension(F.col("file")) == e, r) for e, r in RANKS.items()], F.lit(len(RANKS)))
    sizes = parsed.select("file", rank.alias("rank"), F.size("symbols").alias("n"))
    return running(sizes, ["rank", "file"], {"first": "n"}, scratch).select(F.col("file").alias("of"), "first")


def counted(parsed: DataFrame, first: DataFrame) -> DataFrame:
    """``symbol_id`` and SYMBOL of the files of ``parsed`` that are in ``first``."""
    every = unfolded(parsed.join(first, F.col("file") == F.col("of")), "first")
    return every.select((F.col("first") + F.col("ordinal")).alias("symbol_id"), *(c.split()[0] for c in SYMBOL.split(", ")))


def numbered(parsed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``symbol_id``, dense from 0 by extension, file and place in the file, and SYMBOL, of ``parsed`` (SOURCE, a table).

    A symbol's id is its file's first one and its place.
    """
    return counted(parsed, firsts(parsed, scratch))
