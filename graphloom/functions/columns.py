"""Scalar semantics of references, paths and positions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRIM = r"(?U)^\s+|\s+$"
FRONTMATTER = r"(?s)\A---[\r]*\n(?:.*?\n)??---[\r]*(?:\n|\z)"
#: What an unresolved reference asks for; one row type for notes and code.
REFERENCE = ("ref_kind", "target_kind", "target", "heading", "file", "sym_path")


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's own trim knows U+0020 only)."""
    return F.regexp_replace(c, TRIM, "")


def normalize_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def of_kind(files: DataFrame, *extensions: str) -> DataFrame:
    """Files of the extensions; by the column ``ext`` where there is one, which sources can filter by."""
    kind = F.col("ext") if "ext" in files.columns else extension(F.col("path"))
    return files.filter(kind.isin(*extensions) if len(extensions) > 1 else kind == extensions[0])


def is_glossary_note(path: Column) -> Column:
    return F.substring_index(path, "/", 1).eqNullSafe(F.lit("glossary")) & path.contains("/")


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def excerpt(text: Column) -> Column:
    """The first line of the body that is not blank, without leading # and white space."""
    lines = F.transform(F.split(strip_frontmatter(text), r"\r?\n"), lambda x: trim(F.regexp_replace(trim(x), "^#+", "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def parse_reference(raw: Column) -> Column:
    """The struct of REFERENCE: ``file@scope::name``, or a note's path or stem with #heading.

    The first @ decides before any #. A target with / or ending in .md is a path, else a name.
    """
    inner = trim(raw)
    at, mark = F.split(inner, "@", 2), F.split(inner, "#", 2)
    code = inner.contains("@")
    scopes = F.filter(F.transform(F.split(F.get(at, F.lit(1)), "::"), trim), lambda x: x != "")
    target = trim(F.get(mark, F.lit(0)))
    by_path = target.contains("/") | target.endswith(".md")
    none = F.lit(None)
    return F.struct(
        F.when(code, "code").otherwise("doc").alias("ref_kind"),
        F.when(~code, F.when(by_path, "path").otherwise("name")).alias("target_kind"),
        F.when(~code, F.when(by_path, normalize_path(target)).otherwise(target)).alias("target"),
        F.when(~code & inner.contains("#"), trim(F.get(mark, F.lit(1)))).otherwise(none).alias("heading"),
        F.when(code, normalize_path(trim(F.get(at, F.lit(0))))).alias("file"),
        F.when(code, scopes).alias("sym_path"),
    )


def symbol_label(file: Column, sym_path: Column) -> Column:
    return F.concat(file, F.lit("@"), F.array_join(sym_path, "::"))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def kind_word(kind: Column) -> Column:
    """A symbol kind as hovers show it."""
    out = kind
    # Words that differ from the kind's name.
    for name, word in (("function", "fn"), ("method", "fn"), ("variable", "var"), ("macro", "macro!"), ("module", "mod")):
        out = F.when(kind == name, word).otherwise(out)
    return out


def completion_class(kind: Column) -> Column:
    """The class of completion item for a symbol kind."""
    # Completion classes of the editor protocol.
    classes = {"function": "FUNCTION", "method": "FUNCTION", "struct": "CLASS", "enum": "CLASS", "trait": "CLASS", "type": "CLASS", "const": "CONSTANT", "static": "CONSTANT", "field": "FIELD", "variant": "ENUM_MEMBER", "variable": "VARIABLE", "macro": "KEYWORD", "module": "MODULE"}
    out = F.lit("TEXT")
    for name, word in classes.items():
        out = F.when(kind == name, word).otherwise(out)
    return out


def utf16_to_offset(line: Column, units: Column) -> Column:
    """How many code points of a line its first ``units`` UTF-16 units hold; the line's length at most."""
    wide = lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1)
    step = lambda acc, c: F.struct((acc["u"] + wide(c)).alias("u"), (acc["n"] + F.when(acc["u"] < units, 1).otherwise(0)).alias("n"))
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("u"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def uri_to_path(uri: Column, root: str) -> Column:
    """The path below ``root`` (a file URI) that a file URI names; null outside it."""
    root = root.rstrip("/") + "/"
    below = F.substring(uri, len(root) + 1, 1 << 30)
    return F.when(uri.startswith(root), F.try_url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))))


def path_to_uri(path: Column, root: str) -> Column:
    encoded = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(root.rstrip("/") + "/"), encoded)
