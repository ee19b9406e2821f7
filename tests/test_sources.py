"""Folders as tables: filters that reach the source, stores, listings."""

import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from graphloom.operators import graph, lookup
from graphloom.sources import workspace
from graphloom.sources.workspace import ArrowStore, LocalStore, WorkspaceReader

FILES = {"a.md": "A", "x/b.md": "B", "x/y/c.rs": "struct C;", "x/yy/d.md": "D", "w/e.c": "int e;", "w/target/no.md": "", ".git/no.md": "", "x/.hid.h": "", "x/n.txt": "", "glossary/T.md": "T"}
KEPT = {p for p in FILES if "no" not in p and not p.endswith(".txt")}


@pytest.fixture
def folder(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def reader(root, *filters, folders=256, contents=True):
    r = WorkspaceReader(str(root), workspace.EXTENSIONS, 1 << 20, folders, contents)
    return r, list(r.pushFilters(list(filters)))


def paths(r):
    return {row[0] for share in r.partitions() for row in r.read(share)}


@pytest.mark.parametrize("folders", [1, 3, 256])
@pytest.mark.parametrize(
    ("filters", "keep"),
    [
        ([], lambda p: True),
        ([EqualTo(("ext",), "md")], lambda p: p.endswith(".md")),
        ([In(("ext",), ("rs", "c"))], lambda p: p.endswith((".rs", ".c"))),
        ([StringStartsWith(("path",), "x/y")], lambda p: p.startswith("x/y")),
        ([StringStartsWith(("path",), "x/")], lambda p: p.startswith("x/")),
        ([StringStartsWith(("path",), "glossary/"), EqualTo(("ext",), "md")], lambda p: p.startswith("glossary/")),
        ([EqualTo(("path",), "x/y/c.rs")], lambda p: p == "x/y/c.rs"),
        ([In(("path",), ("a.md", "gone.md", "w/target/no.md", "x", "x/../a.md")), StringStartsWith(("path",), "a")], lambda p: p == "a.md"),
        ([EqualTo(("ext",), "md"), EqualTo(("ext",), "rs")], lambda p: False),
    ],
)
def test_filters_of_the_source(folder, filters, keep, folders):
    r, rest = reader(folder, *filters, folders=folders)
    assert rest == [] and paths(r) == {p for p in KEPT if keep(p)}


def test_other_filters_are_left_to_spark(folder):
    r, rest = reader(folder, GreaterThan(("path",), "b"), EqualTo(("content",), "A"))
    assert len(rest) == 2 and paths(r) == KEPT


def test_a_file_by_its_path_is_read_without_listing(folder, monkeypatch):
    monkeypatch.setattr(LocalStore, "list", lambda *a: pytest.fail("listed"))
    r, _ = reader(folder, EqualTo(("path",), "x/y/c.rs"))
    assert [row for s in r.partitions() for row in r.read(s)] == [("x/y/c.rs", "rs", "struct C;")]


@pytest.mark.parametrize("form", ["{}", "file://{}"])
def test_spark_pushes_filters(spark, folder, form):
    root = form.format(folder)
    files = workspace.read(spark, root)
    assert {r.path for r in files.collect()} == KEPT
    assert {r.path for r in files.filter("ext = 'md' and path like 'x/%'").collect()} == {"x/b.md", "x/yy/d.md"}
    one = files.filter(F.col("path") == "x/y/c.rs")
    os.chmod(folder / "w", 0)
    assert [tuple(r) for r in one.collect()] == [("x/y/c.rs", "rs", "struct C;")]
    os.chmod(folder / "w", 0o755)
    plan = one._jdf.queryExecution().optimizedPlan().toString() + one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(path" not in plan.replace("#", "") or "PushedFilters" in plan or "workspace" in plan


def test_a_code_lens_reads_one_source(spark, folder):
    (folder / "a.md").write_text("[[x/y/c.rs@C]]")
    w = graph.index(workspace.read(spark, str(folder)))
    assert lookup.code_lens(w, "x/y/c.rs").collect() == [("x/y/c.rs", "C", 0, 7, 1)]


def test_listing(spark, folder):
    rows = {r.path: r for r in workspace.listing(spark, str(folder)).collect()}
    assert set(rows) == KEPT and all(r.size == len(FILES[p]) and r.modified == os.stat(folder / p).st_mtime_ns for p, r in rows.items())


def test_stores_agree(folder):
    made = fs._MockFileSystem()
    for path, text in FILES.items():
        made.create_dir(os.path.dirname(f"top/{path}"), recursive=True)
        with made.open_output_stream(f"top/{path}") as f:
            f.write(text.encode())
    for at in (ArrowStore(made, "top"), ArrowStore(fs.LocalFileSystem(), str(folder)), LocalStore(str(folder))):
        assert {p for p, _, _ in workspace.walk(at, "")} == KEPT
        assert workspace.content(at, "x/y/c.rs") == "struct C;" and workspace.content(at, "gone.md") == ""
        assert at.file("a.md")[1] == 1 and at.file("gone.md") is None and at.file("x") is None


def test_links_are_not_followed(folder):
    os.symlink(folder / "x", folder / "link")
    os.symlink(folder / "a.md", folder / "l.md")
    r, _ = reader(folder)
    assert paths(r) == KEPT
    r, _ = reader(folder, EqualTo(("path",), "l.md"))
    assert paths(r) == set()
