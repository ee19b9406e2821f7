"""The typed property graph: nodes and edges as tables, their JSON, and views of them."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions import columns as C
from graphloom.operators import documents, glossary, resolve
from graphloom.operators.scratch import Scratch, materialize, running

NODE_KINDS = ("doc", "section", "symbol", "term")
EDGE_KINDS = ("links", "references", "mentions", "contains")


class Workspace:
    """Everything the index knows, as DataFrames, each computed when it is first asked for.

    Notes are parsed in one pass that finds headings, links and mentions (or the first two alone, where no mentions
    are asked for), and sources in another; what they give is written, as are resolved references, and all
    that follows reads it until ``close``.
    Statuses ask only how many symbols a link names, so they parse just the sources that links name and number
    nothing. Paths of files are unique.
    """

    def __init__(self, files: DataFrame):
        self.files = files
        self.scratch = Scratch()

    def close(self) -> None:
        """Delete the tables that were written: what was asked for here can no longer be read."""
        self.scratch.close()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self.scratch)

    @cached_property
    def docs(self) -> DataFrame:
        return documents.docs(self.files)

    @cached_property
    def terms(self) -> DataFrame:
        return glossary.terms(self.files)

    @cached_property
    def parsed(self) -> DataFrame:
        since = len(self.scratch.made)
        notes = self._keep(glossary.annotated(self.files, self.terms, self.scratch), "notes")
        self.scratch.drop(since, len(self.scratch.made) - 1)
        return notes

    @cached_property
    def _unannotated(self) -> DataFrame:
        return self._keep(documents.notes(self.files).drop("mentions"), "links")

    @property
    def noted(self) -> DataFrame:
        """Notes with headings and links. What needs mentions as well asks for ``parsed`` first, so that notes are read once."""
        return self.parsed if "parsed" in self.__dict__ else self._unannotated

    @property
    def sections(self) -> DataFrame:
        return documents.sections(self.noted)

    @property
    def references(self) -> DataFrame:
        return documents.references(self.noted)

    @cached_property
    def mentions(self) -> DataFrame:
        return glossary.said(self.parsed)

    @cached_property
    def sources(self) -> DataFrame:
        return self._keep(documents.sources(self.files), "sources")

    @property
    def found(self) -> DataFrame:
        """Symbols without ids."""
        return documents.unfolded(self.sources)

    @cached_property
    def _firsts(self) -> DataFrame:
        return documents.firsts(self.sources, self.scratch)

    @cached_property
    def symbols(self) -> DataFrame:
        return documents.counted(self.sources, self._firsts)

    @cached_property
    def _asked(self) -> DataFrame:
        return self.references.filter("file is not null").select(F.col("file").alias("asked")).distinct()

    @cached_property
    def cited(self) -> DataFrame:
        """Those of ``symbols`` whose file a link names: all that a reference can lead to."""
        # In a table, so that a few files are known to be few and the sources stay where they are.
        first = self._keep(self._firsts.join(self._asked, F.col("of") == F.col("asked"), "left_semi"), "cited")
        return documents.counted(self.sources, first)

    @cached_property
    def named(self) -> DataFrame:
        """Symbols, without ids, of the sources that a link names; other sources are not parsed for this."""
        asked = self._asked
        if "sources" in self.__dict__:
            return documents.unfolded(self.sources.join(asked, F.col("file") == F.col("asked"), "left_semi"))
        return documents.unfolded(self._keep(documents.sources(self.files.join(asked, F.col("path") == F.col("asked"), "left_semi")), "named-sources"))

    @cached_property
    def resolved(self) -> DataFrame:
        """References with what they resolve to, by id."""
        return self._keep(resolve.resolve(self.references, self.docs, self.sections, self.cited), "resolved")

    @cached_property
    def statuses(self) -> DataFrame:
        """References with their status, the note they lead to, and how many symbols they name."""
        if "resolved" in self.__dict__:
            return self.resolved
        return self._keep(resolve.resolve(self.references, self.docs, self.sections, self.named), "statuses")

    @property
    def nodes(self) -> DataFrame:
        """id, kind, label. Nodes are told apart by what they are, not by their id, which is not escaped."""
        self.parsed  # noqa: B018 - written first
        symbols = self.symbols.select(F.concat(F.lit("symbol:"), F.col("symbol_id").cast("string")).alias("id"), F.lit("symbol").alias("kind"), C.symbol_label(F.col("file"), F.col("sym_path")).alias("label"))
        docs = self.docs.select(F.concat(F.lit("doc:"), "path").alias("id"), F.lit("doc").alias("kind"), F.col("path").alias("label"))
        heads = self.sections.select("path", "heading").distinct().select(F.concat(F.lit("section:"), "path", F.lit("#"), "heading").alias("id"), F.lit("section").alias("kind"), F.col("heading").alias("label"))
        names = self.mentions.select("name").distinct().select(F.concat(F.lit("term:"), "name").alias("id"), F.lit("term").alias("kind"), F.col("name").alias("label"))
        return symbols.unionByName(docs).unionByName(heads).unionByName(names)

    @property
    def edges(self) -> DataFrame:
        """kind, from, to. One for each occurrence; mentions once for each note and term."""
        self.parsed  # noqa: B018 - written first
        doc = lambda c: F.concat(F.lit("doc:"), F.col(c))
        edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("from"), b.alias("to"))
        contains = edge(self.sections, "contains", doc("path"), F.concat(F.lit("section:"), "path", F.lit("#"), "heading"))
        links = edge(self.resolved.filter("doc_path is not null"), "links", doc("from_path"), doc("doc_path"))
        code = edge(self.resolved.filter("status = 'CodeResolved'"), "references", doc("from_path"), F.concat(F.lit("symbol:"), F.col("symbol_id").cast("string")))
        said = edge(self.mentions.select("path", "name").distinct(), "mentions", doc("path"), F.concat(F.lit("term:"), "name"))
        return contains.unionByName(links).unionByName(code).unionByName(said)

    def sizes(self) -> DataFrame:
        """How many of each thing the index holds: what, n; 0 says it is empty."""
        self.parsed  # noqa: B018 - written first
        tables = {"docs": self.docs, "sections": self.sections, "symbols": self.found, "references": self.references, "terms": self.terms, "mentions": self.mentions}
        counts = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in tables.items()]
        return reduce(DataFrame.unionByName, counts)

    def stats(self) -> DataFrame:
        nodes, edges = (x.agg(F.count("*").alias(n)) for x, n in ((self.nodes, "node_count"), (self.edges, "edge_count")))
        return nodes.crossJoin(edges).crossJoin(resolve.counters(self.statuses))  # three rows of one


def index(files: DataFrame) -> Workspace:
    """The workspace of ``files`` (path, content)."""
    return Workspace(files)


def node_id(column: Column) -> Column:
    """A node's id taken apart: kind, path (of a doc or section), heading, symbol_id, name (of a term); null if it is none.

    Headings may hold #, so a section's path ends at the first one after .md, or the first at all.
    """
    kind, rest = F.substring_index(column, ":", 1), F.regexp_extract(column, "(?s)^[a-z]+:(.*)$", 1)
    section = F.regexp_extract(rest, r"(?s)^(.*?\.md|[^#]*)#(.*)$", 1)
    heading = F.regexp_extract(rest, r"(?s)^(.*?\.md|[^#]*)#(.*)$", 2)
    none = F.lit(None)
    parts = F.struct(
        kind.alias("kind"),
        F.when(kind == "doc", rest).when(kind == "section", section).otherwise(none).alias("path"),
        F.when(kind == "section", heading).otherwise(none).alias("heading"),
        F.when(kind == "symbol", rest.try_cast("long")).otherwise(none).alias("symbol_id"),
        F.when(kind == "term", rest).otherwise(none).alias("name"),
    )
    return F.when(column.contains(":") & kind.isin(*NODE_KINDS), parts)


def without_sections(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.filter("kind <> 'section'"), edges.filter("kind <> 'contains'")


def write_json(nodes: DataFrame, edges: DataFrame, path: str, include_sections: bool = False) -> str:
    """The graph as JSON lines below ``path``, one node or edge each: for graphs of any size."""
    if not include_sections:
        nodes, edges = without_sections(nodes, edges)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    return path


def json_parts(nodes: DataFrame, edges: DataFrame, include_sections: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The graph as one JSON document in parts: ordinal, ``at`` (characters before it) and text.

    A part is a node or an edge with the brackets and commas before it, in the order of ids and ends; the last one
    closes the document. Parts are numbered by prefix sums, so no task holds more than its share.
    """
    if not include_sections:
        nodes, edges = without_sections(nodes, edges)
    own = nodes.select(F.lit(1).alias("group"), F.col("id").alias("x"), F.col("kind").alias("y"), F.col("label").alias("z"), F.to_json(F.struct("id", "kind", "label")).alias("json"))
    between = edges.select(F.lit(3).alias("group"), F.col("kind").alias("x"), F.col("from").alias("y"), F.col("to").alias("z"), F.to_json(F.struct("kind", "from", "to")).alias("json"))
    marks = nodes.sparkSession.createDataFrame([(0, '{"nodes":['), (2, '],"edges":['), (4, "]}")], "group int, json string")
    empty = F.lit("")
    every = own.unionByName(between).unionByName(marks.select("group", empty.alias("x"), empty.alias("y"), empty.alias("z"), "json"))
    table = materialize(every, "json-parts", scratch)
    counted = running(table, ["group", "x", "y", "z"], {"ordinal": "1", "chars": "length(json)"}, scratch)
    sizes = table.agg(F.count_if(F.col("group") == 1).alias("n_nodes"), F.count_if(F.col("group") == 3).alias("n_edges"))
    nodes_before = F.least(F.col("n_nodes"), F.greatest(F.lit(0), F.col("ordinal") - 1))
    edges_before = F.least(F.col("n_edges"), F.greatest(F.lit(0), F.col("ordinal") - 2 - F.col("n_nodes")))
    commas = F.greatest(F.lit(0), nodes_before - 1) + F.greatest(F.lit(0), edges_before - 1)
    leads = (F.col("group") % 2 == 0) | (F.col("ordinal") == 1) | (F.col("ordinal") == F.col("n_nodes") + 2)
    text = F.when(leads, F.col("json")).otherwise(F.concat(F.lit(","), "json"))
    return counted.crossJoin(F.broadcast(sizes)).select("ordinal", (F.col("chars") + commas).alias("at"), text.alias("text"))  # one row of sizes


def write_document(nodes: DataFrame, edges: DataFrame, path: str, include_sections: bool = False, scratch: Scratch | None = None) -> str:
    """The JSON document as text files below ``path``, one part a line: put together in the order of their names they are it."""
    parts = json_parts(nodes, edges, include_sections, scratch)
    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts.repartitionByRange(width, "ordinal").sortWithinPartitions("ordinal").select("text").write.mode("overwrite").text(path)
    return path


#: Rows of a graph that to_json takes (about 200 MB of JSON in one row).
MOST_JSON = 2_000_000


def to_json(nodes: DataFrame, edges: DataFrame, include_sections: bool = False) -> DataFrame:
    """The graph as one JSON document, for viewers, of ``MOST_JSON`` nodes and edges at most; see :func:`write_json`."""
    if not include_sections:
        nodes, edges = without_sections(nodes, edges)
    nodes, edges = materialize(nodes, "json-nodes"), materialize(edges, "json-edges")
    if nodes.count() + edges.count() > MOST_JSON:
        raise ValueError(f"a graph of more than {MOST_JSON} nodes and edges: use write_json")
    own = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "kind", "label"))).alias("nodes"))
    links = edges.agg(F.array_sort(F.collect_list(F.struct("kind", "from", "to"))).alias("edges"))
    return own.crossJoin(links).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def shown(nodes: DataFrame, edges: DataFrame, node_kinds=("doc", "symbol", "term"), edge_kinds=("links", "references", "mentions")) -> tuple[DataFrame, DataFrame]:
    """What a view shows: nodes of the kinds, and edges of the kinds between nodes that are shown."""
    own = nodes.filter(F.col("kind").isin(*node_kinds))
    ids = own.select(F.col("id").alias("shown")).distinct()
    between = edges.filter(F.col("kind").isin(*edge_kinds)).join(ids, F.col("from") == F.col("shown"), "left_semi").join(ids, F.col("to") == F.col("shown"), "left_semi")
    return own, between


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "id string, kind string, label string"), spark.createDataFrame([], "kind string, `from` string, `to` string")
