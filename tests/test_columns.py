"""Column expressions on single values."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (" src/a.rs@ A :: b ::", ("code", None, None, None, "src/a.rs", ["A", "b"])),
        ("a\\b.rs@x", ("code", None, None, None, "a/b.rs", ["x"])),
        ("a.md#h@x", ("code", None, None, None, "a.md#h", ["x"])),
        ("f@", ("code", None, None, None, "f", [])),
        ("docs/a.md # 見出し ", ("doc", "path", "docs/a.md", "見出し", None, None)),
        ("　note\t", ("doc", "name", "note", None, None, None)),
        ("docs\\spec", ("doc", "name", "docs\\spec", None, None, None)),
        ("docs\\spec.md", ("doc", "path", "docs/spec.md", None, None, None)),
        ("a#b#c", ("doc", "name", "a", "b#c", None, None)),
        ("#h", ("doc", "name", "", "h", None, None)),
        ("a.md#", ("doc", "path", "a.md", "", None, None)),
    ],
)
def test_references(spark, raw, want):
    assert tuple(one(spark, C.parse_reference(F.lit(raw)))) == want


@pytest.mark.parametrize(("path", "stem", "ext"), [("x/a.b.md", "a.b", "md"), ("a", "a", ""), (".md", ".md", ""), ("d.x/n", "n", ""), ("x/A.MD", "A", "MD")])
def test_paths(spark, path, stem, ext):
    assert one(spark, C.file_stem(F.lit(path))) == stem and one(spark, C.extension(F.lit(path))) == ext


@pytest.mark.parametrize(("path", "want"), [("glossary/a.md", True), ("glossary/s/a.md", True), ("x/glossary/a.md", False), ("glossary.md", False)])
def test_glossary_notes(spark, path, want):
    assert one(spark, C.is_glossary_note(F.lit(path))) is want


@pytest.mark.parametrize(("text", "want"), [("---\na: b\n---\n\n## Head\nx", "Head"), ("\n  \nfirst\n", "first"), ("", ""), ("#\n# A", "A")])
def test_excerpts(spark, text, want):
    assert one(spark, C.excerpt(F.lit(text))) == want


def test_positions(spark):
    assert one(spark, C.utf16_length(F.lit("a😀状"))) == 4
    assert [one(spark, C.utf16_to_offset(F.lit("a😀状"), F.lit(n))) for n in (0, 1, 3, 4, 9)] == [0, 1, 2, 3, 3]


def test_uris(spark):
    assert one(spark, C.uri_to_path(F.lit("file:///w/a%20b+c/%C3%BC.md"), "file:///w")) == "a b+c/ü.md"
    assert one(spark, C.uri_to_path(F.lit("file:///other/a.md"), "file:///w/")) is None
    assert one(spark, C.path_to_uri(F.lit("a b/ü.md"), "file:///w")) == "file:///w/a%20b/%C3%BC.md"
