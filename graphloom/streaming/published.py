"""An index that is published in versions, built whole or from the version before and what changed.

A version is a folder of tables: what was parsed (notes, sources, terms, references with their status) and
what clients read (nodes, edges, diagnostics). It counts once its row stands in ``versions``, so readers see
the old index or the new one, whole. :func:`refresh` parses changed files alone and resolves again the references
that a change can reach: those of changed notes, and those that name a changed note by path or stem, a
heading of one, or a changed source. Only when the glossary's names change are all notes matched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from graphloom.operators import documents, glossary, graph, lookup, resolve
from graphloom.operators.scratch import Scratch, delete, materialize
from graphloom.sources import changes, workspace

#: What clients read, and what the next version is made of.
TABLES = ("nodes", "edges", "diagnostics")
BASE = ("hashes", "parsed", "sources", "terms", "docs", "statuses")
SAID = "node_count long, edge_count long, code_refs_resolved long, code_refs_unresolved long, version string, through long"
#: Versions whose tables are kept, for those who still read them.
KEPT = 3


def versions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SAID).parquet(f"{out}/versions")


def last(spark: SparkSession, out: str) -> Row | None:
    """The row of the last version below ``out``; None if there is none."""
    if not changes.exists(spark, f"{out}/versions"):
        return None
    return versions(spark, out).orderBy(F.desc("version")).first()


def published(spark: SparkSession, out: str, version: str | None = None, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of the latest version below ``out``, or of the one named."""
    version = version or last(spark, out).version
    return {name: spark.read.parquet(f"{out}/{version}/{name}") for name in names}


def hashes(files: DataFrame) -> DataFrame:
    """path and content hash of each file that is indexed."""
    content = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
    return files.select("path", content.alias("hash"))


def _publish(w: graph.Workspace, base: dict[str, DataFrame], out: str, diagnosed: DataFrame | None, through: int) -> Row:
    """Write a version: its number follows the last one's, and its row comes last."""
    spark = w.files.sparkSession
    known = last(spark, out)
    number = int(known.version) + 1 if known else 1
    while changes.exists(spark, f"{out}/{number:020d}"):  # of a build that was cut short, or goes on
        number += 1
    version = f"{number:020d}"
    tables = base | {"nodes": w.nodes, "edges": w.edges, "diagnostics": lookup.all_diagnostics(w, diagnosed)}
    for name, table in tables.items():
        table.write.parquet(f"{out}/{version}/{name}")
    said = w.stats().withColumn("version", F.lit(version)).withColumn("through", F.lit(through).cast("long"))
    said.coalesce(1).write.mode("append").parquet(f"{out}/versions")
    prune(spark, out)
    return versions(spark, out).filter(F.col("version") == version).first()


def prune(spark: SparkSession, out: str, keep: int = KEPT) -> None:
    """Delete the tables of all but the last ``keep`` versions."""
    for r in versions(spark, out).select("version").distinct().orderBy(F.desc("version")).limit(keep + 8).collect()[keep:]:
        delete(spark, f"{out}/{r.version}")


def _base(w: graph.Workspace, known: DataFrame) -> dict[str, DataFrame]:
    return {"hashes": known, "parsed": w.parsed, "sources": w.sources, "terms": w.terms, "docs": w.docs, "statuses": w.statuses}


def rebuild(files: DataFrame, out: str, open_buffers: DataFrame | None = None, through: int = 0) -> Row:
    """Index ``files`` anew and publish it below ``out``: nodes, edges, and diagnostics of the open notes.

    ``open_buffers`` (path, text) stand in for what is on disk, and only their notes are diagnosed, as
    a client shows warnings for open ones; without it all are. ``through`` is the look at the folder that ``files`` has.
    Returns the version's row, which :func:`reindex.notices` streams to clients.
    """
    if open_buffers is not None:
        files = workspace.buffers_over(files, open_buffers)
    w = graph.index(files)
    try:
        w.sources, w.statuses  # noqa: B018 - written first, statuses from all sources
        return _publish(w, _base(w, hashes(files)), out, None if open_buffers is None else open_buffers.select("path"), through)
    finally:
        w.close()


def _named(refs: DataFrame, docs: DataFrame, sources: DataFrame, notes: DataFrame) -> DataFrame:
    """Those of ``refs`` (of untouched notes) that may resolve otherwise now.

    ``docs`` (path, stem) are the notes that came or went, ``notes`` (path) those that were edited, and
    ``sources`` (file) the sources that came, went or were edited.
    """
    keys = docs.select(F.col("path").alias("key"), F.lit("path").alias("as")).unionByName(docs.select(F.col("stem").alias("key"), F.lit("name").alias("as"))).distinct()
    by_name = refs.join(keys, (resolve.filled("target") == F.col("key")) & (F.col("target_kind") == F.col("as")), "left_semi")
    by_heading = refs.filter("heading is not null").join(notes.select(F.col("path").alias("key")), F.col("doc_path") == F.col("key"), "left_semi")
    by_code = refs.join(sources.select(F.col("file").alias("key")), resolve.filled("file") == F.col("key"), "left_semi")
    return by_name.unionByName(by_heading).unionByName(by_code).select("from_path", "ordinal").distinct()


def refresh(files: DataFrame, touched: DataFrame, out: str, through: int = 0, diagnosed: DataFrame | None = None) -> Row:
    """The next version below ``out``, from the last one and the files whose paths are in ``touched`` (path).

    ``files`` (path, content) is the workspace as it is now, with open buffers in it if there are any. Of it only touched
    files are read, by a filter on path; one that is not in it any more is deleted. Files whose content is what it
    was are let be. ``diagnosed`` (path) limits the diagnostics to open notes.
    """
    spark = files.sparkSession
    scratch = Scratch()
    keep = lambda df, name: materialize(df, name, scratch)
    was = published(spark, out, names=BASE)
    try:
        asked = keep(touched.select("path").distinct(), "touched")
        few = asked.limit(PUSHED + 1).collect()  # bounded
        own = files.filter(F.col("path").isin([r.path for r in few])) if len(few) <= PUSHED else files
        now = keep(own.join(asked, "path", "left_semi"), "touched-files")
        old = was["hashes"].join(asked, "path", "left_semi")
        new = hashes(now)
        both = old.withColumnRenamed("hash", "before").join(new, "path", "full").filter(~F.col("before").eqNullSafe(F.col("hash")))
        changed = keep(both.select("path", F.col("before").isNotNull().alias("was"), F.col("hash").isNotNull().alias("is")), "changed")
        edited = now.join(changed.filter("is"), "path", "left_semi")
        gone = changed.select("path")
        rest = lambda name, key="path": was[name].join(gone.select(F.col("path").alias("gone")), F.col(key) == F.col("gone"), "left_anti")

        w = graph.Workspace(files)
        w.scratch = scratch
        parts = w.__dict__
        parts["terms"] = keep(rest("terms").unionByName(glossary.terms(edited)), "terms")
        parts["docs"] = keep(rest("docs").unionByName(documents.docs(edited)), "docs")
        parts["sources"] = keep(rest("sources", "file").unionByName(documents.sources(edited)), "sources")
        names, before = glossary.unique(w.terms), glossary.unique(was["terms"])
        if names.exceptAll(before).isEmpty() and before.exceptAll(names).isEmpty():
            parts["parsed"] = keep(rest("parsed").unionByName(glossary.annotated(edited, w.terms, scratch)), "parsed")
        else:
            parts["parsed"] = keep(glossary.annotated(files, w.terms, scratch), "parsed")

        notes = changed.join(w.docs.select("path").unionByName(was["docs"].select("path")).distinct(), "path", "left_semi")
        moved = notes.filter("was <> is").join(w.docs.unionByName(was["docs"]).distinct(), "path")
        kinds = documents.C.of_kind(changed, *documents.RANKS).select(F.col("path").alias("file"))
        before_refs = rest("statuses", "from_path")
        reached = keep(_named(before_refs, moved, kinds, notes.filter("was and is").select("path")), "reached")
        same = [before_refs["from_path"] == reached["from_path"], before_refs["ordinal"] == reached["ordinal"]]
        untouched = before_refs.join(reached, same, "left_anti")
        asks = [c for c in was["statuses"].columns if c not in ("status", "doc_path", "n_candidates", "symbol_id", "candidates")]
        again = before_refs.join(reached, same, "left_semi").select(*asks)
        mine = documents.references(w.parsed.join(edited.select("path"), "path", "left_semi")).select(*asks)
        refs = keep(again.unionByName(mine), "asked-again")
        files_named = refs.filter("file is not null").select(F.col("file").alias("asked")).distinct()
        symbols = documents.unfolded(w.sources.join(files_named, F.col("file") == F.col("asked"), "left_semi"))
        resolved = resolve.resolve(refs, w.docs, w.sections, symbols)
        columns = [*asks, "status", "doc_path", "n_candidates"]
        parts["statuses"] = keep(untouched.select(*columns).unionByName(resolved.select(*columns)), "statuses")
        parts["resolved"] = keep(resolve.with_ids(w.statuses, w.symbols), "resolved")
        known = rest("hashes").unionByName(new.join(changed, "path", "left_semi"))
        return _publish(w, _base(w, known) | {"statuses": w.statuses}, out, diagnosed, through)
    finally:
        scratch.close()


#: Paths that are asked for by name, which a source can read without listing.
PUSHED = 2_000
