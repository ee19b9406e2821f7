"""The registered queries: each operator of the engine over the workspace derived from the fixtures."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import columns as C
from graphloom.operators import documents, glossary, graph, lookup, resolve
from graphloom.operators.scratch import materialize, root_of
from graphloom.plans import derived
from graphloom.sources import changes, workspace
from graphloom.streaming import reindex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def over_workspace(f: Callable[[graph.Workspace], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(graph.index(derived.files(spark, sf_dir)))
    return f


def over_files(f: Callable[[DataFrame], DataFrame]):
    """For queries that need no symbols: nothing is numbered or written."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(derived.files(spark, sf_dir))
    return f


@over_files
def scan_files_by_ext(files):
    return files.groupBy(C.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


@over_files
def glossary_notes(files):
    return glossary.terms(files)


@over_files
def extract_links(files):
    return documents.references(documents.notes(files)).select("from_path", "ordinal", "raw")


@over_files
def parse_references(files):
    refs = documents.references(documents.notes(files))
    return refs.select("from_path", "ordinal", "ref_kind", "target_kind", "target", "heading", "file", F.when(F.col("sym_path").isNotNull(), F.array_join("sym_path", "::")).alias("qualified"))


@over_files
def extract_headings(files):
    return documents.sections(documents.notes(files))


@over_files
def doc_target_edges(files):
    parsed = documents.notes(files)
    found = resolve.doc_targets(documents.references(parsed), documents.docs(files)).filter("doc_path is not null")
    return found.groupBy("from_path", F.col("doc_path").alias("to_path")).agg(F.count("*").alias("n_links"))


@over_files
def stem_index(files):
    return resolve.stem_index(documents.docs(files))


@over_files
def duplicate_terms(files):
    return glossary.duplicates(glossary.terms(files))


@over_files
def symbol_table(files):
    return documents.numbered(materialize(documents.sources(files), "sources")).select("symbol_id", "file", "qualified", "kind", "name_line", "name_char")


@over_files
def term_mentions(files):
    return glossary.mentions(files, glossary.terms(files)).groupBy("path", "name").agg(F.count("*").alias("n_mentions"))


@over_files
def mention_edges(files):
    return glossary.mentions(files, glossary.terms(files)).select("path", "name").distinct()


@over_files
def positions_utf16(files):
    return documents.references(documents.notes(files)).select("from_path", "ordinal", "start_line", "start_char", "start_utf16", "end_line", "end_char", "end_utf16")


@over_files
def rust_symbols_full(files):
    return documents.symbols(files.filter(C.extension(F.col("path")) == "rs")).withColumn("sym_path", F.array_join("sym_path", "/"))


@over_files
def c_symbols_full(files):
    return documents.symbols(files.filter(C.extension(F.col("path")).isin("c", "h"))).withColumn("sym_path", F.array_join("sym_path", "/"))


@over_workspace
def resolve_links(w):
    return w.resolved.select("from_path", "ordinal", "raw", "status", "doc_path", "symbol_id")


@over_workspace
def resolution_summary(w):
    return w.statuses.groupBy("status").agg(F.count("*").alias("n_links"))


@over_workspace
def resolve_code_refs(w):
    code = w.resolved.filter("ref_kind = 'code'")
    return code.select("from_path", "file", F.array_join("sym_path", "::").alias("qualified"), "status", "n_candidates", "symbol_id")


@over_workspace
def code_ref_counters(w):
    return resolve.counters(w.statuses)


@over_workspace
def graph_nodes(w):
    return w.nodes


@over_workspace
def graph_edges(w):
    return w.edges.select("kind", F.col("from").alias("from_id"), F.col("to").alias("to_id"))


@over_workspace
def graph_without_sections(w):
    nodes, edges = graph.without_sections(w.nodes, w.edges)
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


@over_workspace
def graph_stats(w):
    return w.stats()


@over_workspace
def graph_json(w):
    return graph.json_parts(w.nodes, w.edges, scratch=w.scratch)


@over_workspace
def diagnostics(w):
    return lookup.diagnostics(w).select("path", "ordinal", "status", "message")


@over_workspace
def glossary_diagnostics(w):
    return lookup.glossary_diagnostics(w).select("path", "name", "end_utf16", "message")


@over_workspace
def code_lens_counts(w):
    return lookup.code_lens(w)


@over_workspace
def symbol_info(w):
    return lookup.symbol_info(w)


@over_workspace
def doc_hover_headings(w):
    return lookup.doc_hover(w)


@over_workspace
def code_hover(w):
    return lookup.code_hover(w)


@over_workspace
def completion_items(w):
    return lookup.completion_items(w)


@over_workspace
def document_links(w):
    return lookup.document_links(w).groupBy("path", "target", "tooltip").agg(F.count("*").alias("n"))


@over_workspace
def display_filter(w):
    _, edges = graph.shown(w.nodes, w.edges, node_kinds=("doc", "symbol"), edge_kinds=("links", "references", "contains"))
    return edges.select("kind", F.col("from").alias("from_id"), F.col("to").alias("to_id"))


@over_workspace
def index_sizes(w):
    return w.sizes()


@over_workspace
def code_lens_of_a_file(w):
    return lookup.code_lens(w, "src/p7.rs")


@over_files
def uris_of_paths(files):
    uri = C.path_to_uri(F.col("path"), derived.ROOT_URI)
    return files.select("path", uri.alias("uri"), C.uri_to_path(uri, derived.ROOT_URI).alias("back"))


@over_workspace
def link_ranges(w):
    return lookup.document_links(w, derived.ROOT_URI).filter("tooltip is null").drop("tooltip")


@over_workspace
def node_ids(w):
    return w.nodes.select(graph.node_id(F.col("id")).alias("n")).select("n.*")


def at_places(f: Callable[[graph.Workspace, DataFrame], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(graph.index(derived.files(spark, sf_dir)), derived.places(spark, sf_dir))
    return f


@at_places
def hovers(w, places):
    return lookup.hovers_at(w, places).select("path", "line", "character", "hover", "start_utf16", "end_utf16")


@at_places
def definitions(w, places):
    return lookup.definitions_at(w, places, derived.ROOT_URI)


@at_places
def completions(w, places):
    return lookup.completions_at(w.files, places)


@over_workspace
def node_targets(w):
    return lookup.node_targets(w, w.nodes)


def folder_changes(spark, sf_dir):
    old, new = (derived.select(spark, sf_dir, q) for q in derived.LISTINGS)
    return changes.difference(new, old)


def refreshed_diagnostics(spark, sf_dir):
    """A whole index, then a version made from what open buffers changed: warnings of the open notes."""
    files, buffers = derived.files(spark, sf_dir), derived.buffers(spark, sf_dir)
    out = f"{root_of(spark)}/refreshed-{uuid.uuid4().hex}"
    reindex.rebuild(files, out)
    reindex.refresh(workspace.buffers_over(files, buffers), buffers.select("path"), out, diagnosed=buffers.select("path"))
    return reindex.published(spark, out)["diagnostics"]


def open_buffer_diagnostics(spark, sf_dir):
    buffers = derived.buffers(spark, sf_dir)
    return lookup.all_diagnostics(graph.index(workspace.buffers_over(derived.files(spark, sf_dir), buffers)), buffers)


def debounce_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("root"), "ts")
    bursts = reindex.bursts(events, gap="1 hour")
    return bursts.groupBy(F.col("root").alias("user_id")).agg(F.count("*").alias("n_bursts"), F.sum("n_events").alias("n_events"))


def latest_buffers(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return reindex.latest(turns, "conv_id", F.struct("turn", "text")).select("conv_id", "turn", "role", "text")


QUERIES |= {"folder_changes": folder_changes, "refreshed_diagnostics": refreshed_diagnostics, "open_buffer_diagnostics": open_buffer_diagnostics, "debounce_sessions": debounce_sessions, "latest_buffers": latest_buffers}
