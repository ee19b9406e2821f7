"""Editor-style lookups over a workspace: each is a projection, a filter or a join of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions import columns as C
from graphloom.operators import documents, glossary, graph, resolve
from graphloom.operators.graph import Workspace

# The messages of diagnostics, by status; the ambiguous one holds the number of candidates.
MESSAGES = {
    "DocHeadingDangling": "見出しが見つかりません（名前が変わったか削除されました）",
    "DocAmbiguous": "同名のドキュメントが複数あります。フルパスで指定してください",
    "DocDangling": "リンク先のドキュメントが見つかりません",
    "CodeAmbiguous": "候補が %d 件あります。disambiguator で絞り込んでください",
    "CodeDangling": "シンボルが見つかりません",
}
DUPLICATE_TERM = "用語「%s」が複数のファイルで定義されています"
STALE_HEADING = "⚠ 見出しが見つかりません"
RANGE = ("start_line", "start_utf16", "end_line", "end_utf16")


def diagnostics(w: Workspace) -> DataFrame:
    """A warning for each link that does not resolve."""
    message = F.lit(None).cast("string")
    for status, text in MESSAGES.items():
        shown = F.format_string(text, "n_candidates") if "%d" in text else F.lit(text)
        message = F.when(F.col("status") == status, shown).otherwise(message)
    return w.statuses.withColumn("message", message).filter("message is not null").select(F.col("from_path").alias("path"), "ordinal", *RANGE, "status", F.lit("warning").alias("severity"), "message")


def all_diagnostics(w: Workspace, paths: DataFrame | None = None) -> DataFrame:
    """Warnings of links and of glossary notes, of all notes or of those in ``paths`` (path)."""
    links = diagnostics(w).select("path", *RANGE, "severity", "message")
    terms = glossary_diagnostics(w).select("path", *RANGE, "severity", "message")
    every = links.unionByName(terms)
    return every if paths is None else every.join(paths.select("path").distinct(), "path", "left_semi")


def glossary_diagnostics(w: Workspace) -> DataFrame:
    """A warning on the first line of every note whose term another note defines too."""
    twice = glossary.duplicates(w.terms).select(F.col("name").alias("twice"))
    own = w.terms.join(twice, F.col("name") == F.col("twice"), "left_semi").select("name", F.col("path").alias("p"))
    first = F.regexp_replace(F.substring_index("content", "\n", 1), r"\r$", "")
    return w.files.join(own, F.col("path") == F.col("p")).select("path", "name", F.lit(0).alias("start_line"), F.lit(0).alias("start_utf16"), F.lit(0).alias("end_line"), C.utf16_length(first).alias("end_utf16"), F.lit("warning").alias("severity"), F.format_string(DUPLICATE_TERM, "name").alias("message"))


def reference_counts(refs: DataFrame) -> DataFrame:
    """How many of ``refs`` name each (file, sym_path)."""
    return refs.filter("ref_kind = 'code'").groupBy("file", "sym_path").agg(F.count("*").alias("n_refs"))


def code_lens(w: Workspace, file: str | None = None) -> DataFrame:
    """Symbols with references, and how many; those without are left out.

    A name that several symbols have resolves to none. For one file, that file alone is parsed, and only
    references to it are counted.
    """
    symbols, refs = (w.named, w.references) if file is None else (documents.symbols(w.files.filter(F.col("path") == file)), w.references.filter(F.col("file") == file))
    alone = symbols.groupBy("file", "sym_path").agg(F.count("*").alias("n"), F.first("qualified").alias("qualified"), F.first("name_line").alias("name_line"), F.first("name_utf16").alias("name_utf16")).filter("n = 1")
    return alone.join(reference_counts(refs), ["file", "sym_path"]).select("file", "qualified", F.col("name_line").alias("line"), F.col("name_utf16").alias("character"), "n_refs")


def symbol_info(w: Workspace, symbol_id: int | None = None) -> DataFrame:
    symbols = w.symbols if symbol_id is None else w.symbols.filter(F.col("symbol_id") == symbol_id)
    return symbols.select("symbol_id", "file", F.col("name_line").alias("line"), F.col("name_utf16").alias("character"))


def node_targets(w: Workspace, ids: DataFrame) -> DataFrame:
    """id, file, line and character that a node of the graph leads to, for each of ``ids`` (id); terms lead nowhere."""
    asked = ids.select("id").distinct().withColumn("n", graph.node_id(F.col("id")))
    zero = F.lit(0)
    notes = asked.filter("n.path is not null").join(w.docs.select("path"), F.col("n.path") == F.col("path"), "left_semi").select("id", F.col("n.path").alias("file"), zero.alias("line"), zero.alias("character"))
    code = asked.filter("n.symbol_id is not null").join(symbol_info(w), F.col("n.symbol_id") == F.col("symbol_id")).select("id", "file", "line", "character")
    return notes.unionByName(code)


def doc_hover(w: Workspace) -> DataFrame:
    """A note's hover: its path in bold, and its headings, each once, in order."""
    heads = w.sections.groupBy("path", "heading").agg(F.min("ordinal").alias("ordinal")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "heading"))).alias("heads"))
    lines = F.array_join(F.transform("heads", lambda h: F.concat(F.lit("- "), h["heading"])), "\n")
    named = F.concat(F.lit("**"), w.docs["path"], F.lit("**"))
    return w.docs.join(heads, "path", "left").select("path", F.when(F.col("heads").isNull(), named).otherwise(F.concat(named, F.lit("\n\n"), lines)).alias("hover"))


def code_hover(w: Workspace, symbols: DataFrame | None = None) -> DataFrame:
    return (w.symbols if symbols is None else symbols).select("symbol_id", F.format_string("**%s** `%s`\n\n`%s`", C.kind_word(F.col("kind")), "qualified", "file").alias("hover"))


def document_links(w: Workspace, root: str | None = None) -> DataFrame:
    """Every link of a note with the file it leads to (null if none), and every mention with its term's note.

    Ranges are in UTF-16 units. With ``root``, a folder's URI, ``target_uri`` is the target's.
    """
    w.parsed  # noqa: B018 - written first
    symbols = w.cited.select(F.col("symbol_id").alias("sid"), F.col("file").alias("sym_file"))
    real = w.resolved.join(symbols, F.col("symbol_id") == F.col("sid"), "left").select(F.col("from_path").alias("path"), *RANGE, F.coalesce("doc_path", "sym_file").alias("target"), F.lit(None).cast("string").alias("tooltip"))
    first = w.terms.groupBy("name").agg(F.min("path").alias("target"))
    terms = w.mentions.join(first, "name").select("path", *RANGE, "target", F.col("name").alias("tooltip"))
    every = real.unionByName(terms)
    return every if root is None else every.withColumn("target_uri", C.path_to_uri(F.col("target"), root))


def holds(line: int | Column, character: int | Column) -> Column:
    """Whether a range holds a place in UTF-16 units: only its first line counts, its end is outside."""
    character = F.lit(character) if isinstance(character, int) else character
    return (F.col("start_line") == line) & (F.col("start_utf16") <= character) & (character < F.col("end_utf16"))


#: A place in a note: path, line, and character in UTF-16 units.
PLACE = ("path", "line", "character")


def places(spark: SparkSession, *at: tuple[str, int, int]) -> DataFrame:
    return spark.createDataFrame(list(at), "path string, line int, character int")


def links_at(w: Workspace, at: DataFrame) -> DataFrame:
    """For each place of ``at`` (columns PLACE) the first link there, resolved; none for other places."""
    asked = at.select(*(F.col(c).alias(f"at_{c}") for c in PLACE)).distinct()
    hits = w.resolved.join(asked, (F.col("from_path") == F.col("at_path")) & (F.col("start_line") == F.col("at_line")), "inner").filter(holds(F.col("at_line"), F.col("at_character")))
    row = F.struct(*w.resolved.columns)
    first = hits.groupBy("at_path", "at_line", "at_character").agg(F.min_by(row, "ordinal").alias("row"))
    return first.select("at_path", "at_line", "at_character", "row.*")


def definitions_at(w: Workspace, at: DataFrame, root: str | None = None) -> DataFrame:
    """PLACE and the file and range that the link there leads to; a note's range is its first place."""
    named = w.cited.select(F.col("symbol_id").alias("sid"), F.col("file").alias("sym_file"), *(F.col(c) for c in ("name_line", "name_utf16", "name_end_line", "name_end_utf16")))
    every = links_at(w, at).join(named, F.col("symbol_id") == F.col("sid"), "left")
    zero = F.lit(0)
    found = every.select(
        *(F.col(f"at_{c}").alias(c) for c in PLACE), F.coalesce("doc_path", "sym_file").alias("file"),
        *(F.coalesce(a, zero).alias(b) for a, b in zip(("name_line", "name_utf16", "name_end_line", "name_end_utf16"), ("to_line", "to_utf16", "to_end_line", "to_end_utf16"), strict=True)),
    ).filter("file is not null")
    return found if root is None else found.withColumn("uri", C.path_to_uri(F.col("file"), root))


def hovers_at(w: Workspace, at: DataFrame) -> DataFrame:
    """PLACE, hover, and the range it is of: the link there or, if there is none, the first term there."""
    w.parsed  # noqa: B018 - written first
    hits = links_at(w, at)
    docs = doc_hover(w).select(F.col("path").alias("p"), F.col("hover").alias("doc_text"))
    code = code_hover(w, w.cited).select(F.col("symbol_id").alias("sid"), F.col("hover").alias("code_text"))
    text = F.when(F.col("status") == "DocHeadingDangling", F.concat(F.lit(STALE_HEADING + "\n\n"), "doc_text")).otherwise(F.coalesce("doc_text", "code_text"))
    mine = [F.col(f"at_{c}").alias(c) for c in PLACE]
    of_link = hits.join(docs, F.col("doc_path") == F.col("p"), "left").join(code, F.col("symbol_id") == F.col("sid"), "left").select(*mine, text.alias("hover"), *RANGE)
    asked = at.select(*(F.col(c).alias(f"at_{c}") for c in PLACE)).distinct()
    free = asked.join(hits.select(*(f"at_{c}" for c in PLACE)), [f"at_{c}" for c in PLACE], "left_anti")
    said = w.mentions.join(free, (F.col("path") == F.col("at_path")) & (F.col("start_line") == F.col("at_line"))).filter(holds(F.col("at_line"), F.col("at_character")))
    first = said.groupBy("at_path", "at_line", "at_character").agg(F.min_by(F.struct("name", *RANGE), F.struct("start_utf16", "name")).alias("m")).select(*mine, "m.*")
    terms = w.terms.groupBy("name").agg(F.min_by("definition", "path").alias("definition"))
    of_term = first.join(terms, "name").select(*PLACE, F.format_string("**%s**\n\n%s", "name", "definition").alias("hover"), *RANGE)
    return of_link.filter("hover is not null").unionByName(of_term)


def goto_definition(w: Workspace, path: str, line: int, character: int) -> DataFrame:
    """file, line and character that the link at one place leads to."""
    return definitions_at(w, places(w.files.sparkSession, (path, line, character))).select("file", F.col("to_line").alias("line"), F.col("to_utf16").alias("character"))


def hover(w: Workspace, path: str, line: int, character: int) -> DataFrame:
    """The hover at one place."""
    return hovers_at(w, places(w.files.sparkSession, (path, line, character))).select("hover")


def completion_items(w: Workspace) -> DataFrame:
    """Notes by path, notes by unique stem, and symbols; what a chosen one inserts."""
    item = lambda df, label, kind, detail: df.select(label.alias("label"), kind.alias("kind"), detail.alias("detail"), F.concat(label, F.lit("]]")).alias("new_text"))
    none = F.lit(None).cast("string")
    docs = item(w.docs, F.col("path"), F.lit("FILE"), none)
    stems = item(resolve.stem_index(w.docs).filter("path is not null"), F.col("stem"), F.lit("FILE"), F.col("path"))
    symbols = item(w.found, C.symbol_label(F.col("file"), F.col("sym_path")), C.completion_class(F.col("kind")), none)
    return docs.unionByName(stems).unionByName(symbols)


def line_of(content: Column, line: Column) -> Column:
    """A line of a text by its number, without its end; empty past the last one."""
    return F.regexp_replace(F.coalesce(F.get(F.split(content, "\n"), line), F.lit("")), "\r$", "")


def completions_at(files: DataFrame, at: DataFrame) -> DataFrame:
    """PLACE and ``replace_from``, the UTF-16 column where the text to be replaced begins, for places after an open ``[[``.

    Every item of :func:`completion_items` is offered there, and none elsewhere.
    """
    asked = at.select(*PLACE).distinct()
    line = line_of(F.col("content"), F.col("line"))
    before = F.substring(line, F.lit(1), C.utf16_to_offset(line, F.col("character")))
    return files.select("path", "content").join(asked, "path").select(*PLACE, completion_range(before).alias("replace_from")).filter("replace_from is not null")


def completion_range(before_cursor: Column) -> Column:
    """The UTF-16 column after the last open ``[[`` of the text before the cursor; null if none is open."""
    tail = F.substring_index(before_cursor, "[[", -1)
    opened = before_cursor.contains("[[") & ~tail.contains("]]")
    return F.when(opened, C.utf16_length(before_cursor) - C.utf16_length(tail))
