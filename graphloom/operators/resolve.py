"""References joined to what they name: resolved, ambiguous or dangling, never silently one of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stem_index(docs: DataFrame) -> DataFrame:
    """stem, path (null if several notes have the stem) and how many there are."""
    return docs.groupBy("stem").agg(F.count("*").alias("n_docs"), F.min("path").alias("one")).select("stem", F.when(F.col("n_docs") == 1, F.col("one")).alias("path"), "n_docs")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """How many symbols each (file, sym_path) names, and their ids in order if symbols are numbered."""
    own = [F.array_sort(F.collect_list("symbol_id")).alias("candidates")] if "symbol_id" in symbols.columns else []
    return symbols.groupBy("file", "sym_path").agg(F.count("*").alias("n_candidates"), *own)


def filled(name: str) -> Column:
    """A key that is null for many references: fillers match nothing (no key holds a line break) and spread the rows."""
    spread = F.pmod(F.xxhash64("from_path", "ordinal"), F.lit(4096)).cast("string")
    return F.coalesce(F.col(name), F.concat(F.lit("\n"), spread))


def doc_targets(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """``refs`` with doc_path and n_docs: how many notes the target names. Headings play no part."""
    by_path = docs.select(F.col("path").alias("t"), F.col("path").alias("p"), F.lit(1).cast("long").alias("n"), F.lit("path").alias("k"))
    by_name = stem_index(docs).select(F.col("stem").alias("t"), F.col("path").alias("p"), F.col("n_docs").alias("n"), F.lit("name").alias("k"))
    # Paths and stems in one lookup table of unique keys, so that one join serves both kinds.
    index = by_path.unionByName(by_name)
    return refs.join(index, (filled("target") == F.col("t")) & (F.col("target_kind") == F.col("k")), "left").withColumnsRenamed({"p": "doc_path", "n": "n_docs"}).drop("t", "k")


def resolve(refs: DataFrame, docs: DataFrame, sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` with status (one of seven), doc_path and n_candidates; with symbol_id and candidates if symbols are numbered."""
    heads = sections.select(F.col("path").alias("sp"), F.col("heading").alias("sh")).distinct()
    ids = symbol_index(symbols).select(F.col("file").alias("sf"), F.col("sym_path").alias("ss"), "n_candidates", *(["candidates"] if "symbol_id" in symbols.columns else []))
    placed = doc_targets(refs, docs)
    headed = placed.join(heads, (F.col("doc_path") == F.col("sp")) & (filled("heading") == F.col("sh")), "left")
    every = headed.join(ids, (filled("file") == F.col("sf")) & (F.col("sym_path") == F.col("ss")), "left")
    every = every.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0).cast("long")))
    found = F.col("n_candidates")
    code = F.when(found == 1, "CodeResolved").when(found > 1, "CodeAmbiguous").otherwise("CodeDangling")
    stale = F.col("heading").isNotNull() & F.col("sp").isNull()
    doc = (
        F.when(F.col("n_docs").isNull(), "DocDangling")
        .when(F.col("doc_path").isNull(), "DocAmbiguous")
        .when(stale, "DocHeadingDangling")
        .otherwise("DocResolved")
    )
    status = F.when(F.col("ref_kind") == "code", code).otherwise(doc)
    told = every.withColumn("status", status).drop("sp", "sh", "sf", "ss", "n_docs")
    return told.withColumn("symbol_id", F.when(found == 1, F.get("candidates", F.lit(0)))) if "candidates" in told.columns else told


def counters(resolved: DataFrame) -> DataFrame:
    """Code references that resolve, and those that do not; ambiguous ones count as unresolved."""
    code = F.col("ref_kind") == "code"
    good = F.col("status") == "CodeResolved"
    return resolved.agg(F.count_if(good).alias("code_refs_resolved"), F.count_if(code & ~good).alias("code_refs_unresolved"))


def with_ids(statuses: DataFrame, symbols: DataFrame) -> DataFrame:
    """References that have a status, with candidates and symbol_id of numbered symbols."""
    ids = symbol_index(symbols).select(F.col("file").alias("sf"), F.col("sym_path").alias("ss"), "candidates")
    code = (F.col("n_candidates") > 0) & (filled("file") == F.col("sf")) & (F.col("sym_path") == F.col("ss"))
    told = statuses.join(ids, code, "left").drop("sf", "ss")
    return told.withColumn("symbol_id", F.when(F.col("n_candidates") == 1, F.get("candidates", F.lit(0))))
