"""Whole workspaces: folders read, indexed, looked up."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import commands, documents, graph, lookup, resolve
from graphloom.sources import workspace

RUST = "struct A;\nimpl A {\n    fn go(&self) {}\n}\n"


def index(spark, files):
    return graph.index(spark.createDataFrame(list(files.items()), "path string, content string"))


def statuses(w):
    return {r.raw: r.status for r in w.resolved.collect()}


def edges(w, kind):
    return sorted((r["from"], r["to"]) for r in w.edges.filter(F.col("kind") == kind).collect())


def test_folder_source(spark, tmp_path):
    for path, data in {"a.md": b"# x", "b/.hid.rs": b"", "b/_u.c": b"\xff\xfe", "target/no.md": b"", "x/node_modules/n.md": b"", ".git/c.md": b"", "d e/%20.h": "ü".encode(), "n.txt": b"", "UP.MD": b"", "md": b""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    rows = {r.path: (r.ext, r.content) for r in workspace.read(spark, str(tmp_path), shareBytes="5000").collect()}
    assert rows == {"a.md": ("md", "# x"), "b/.hid.rs": ("rs", ""), "b/_u.c": ("c", ""), "d e/%20.h": ("h", "ü")}


def test_resolution(spark):
    w = index(spark, {
        "src/a.rs": RUST + "impl Clone for A { fn twice() {} }\nimpl A { fn twice() {} }\n",
        "doc.md": "# H\n[[src/a.rs@A::go]] [[src/a.rs@A::no]] [[src/a.rs@A::twice]] [[x/one.md]] [[one]] [[two]] [[none]] [[x/one.md#Top]] [[x/one.md#Gone]] [[one#]] [[#h]] [[src/a.rs@]] [[x\\one.md]] [[doc]]",
        "x/one.md": "# Top\n# Top\n", "x/two.md": "", "y/two.md": "",
    })
    assert statuses(w) == {
        "src/a.rs@A::go": "CodeResolved", "src/a.rs@A::no": "CodeDangling", "src/a.rs@A::twice": "CodeAmbiguous", "x/one.md": "DocResolved", "one": "DocResolved", "two": "DocAmbiguous", "none": "DocDangling",
        "x/one.md#Top": "DocResolved", "x/one.md#Gone": "DocHeadingDangling", "one#": "DocHeadingDangling", "#h": "DocDangling", "src/a.rs@": "CodeDangling", "x\\one.md": "DocResolved", "doc": "DocResolved",
    }
    assert resolve.counters(w.resolved).first()[:] == (1, 3)
    assert len(edges(w, "links")) == 7 and len(edges(w, "references")) == 1
    assert edges(w, "contains").count(("doc:x/one.md", "section:x/one.md#Top")) == 2
    assert w.nodes.filter("kind = 'section' and label = 'Top'").count() == 1
    ids = {r.id for r in w.nodes.collect()}
    assert all(r["from"] in ids and r["to"] in ids for r in w.edges.collect())
    assert lookup.diagnostics(w).count() == 8


def test_glossary_graph(spark):
    w = index(spark, {"glossary/Bus.md": "# What a bus is\n", "glossary/sub/Bus.md": "x", "glossary/Own.md": "Own", "a.md": "Bus and Bus", "b.md": "Bus"})
    assert edges(w, "mentions") == [("doc:a.md", "term:Bus"), ("doc:b.md", "term:Bus")]
    assert {r.definition for r in w.terms.filter("name = 'Bus'").collect()} == {"What a bus is", "x"}
    assert w.nodes.filter("kind = 'term'").count() == 1
    assert sorted(r.path for r in lookup.glossary_diagnostics(w).collect()) == ["glossary/Bus.md", "glossary/sub/Bus.md"]


def test_json_and_views(spark):
    w = index(spark, {"a.md": "# H\n[[b]]", "b.md": ""})
    whole, less = (json.loads(graph.to_json(w.nodes, w.edges, s).first()[0]) for s in (True, False))
    assert {"id": "doc:a.md", "kind": "doc", "label": "a.md"} in whole["nodes"] and len(whole["nodes"]) == 3
    assert less["edges"] == [{"kind": "links", "from": "doc:a.md", "to": "doc:b.md"}] and len(less["nodes"]) == 2
    assert graph.shown(w.nodes, w.edges, ("section",), ("contains",))[1].count() == 0


def test_lookups(spark):
    w = index(spark, {"src/a.rs": RUST, "a.md": "😀 [[src/a.rs@A::go]] Term\n[[b#Gone]] [[none]]", "b.md": "# H\n", "glossary/Term.md": "A word."})
    at = lambda line, col: [r[0] for r in lookup.hover(w, "a.md", line, col).collect()]
    assert lookup.goto_definition(w, "a.md", 0, 3).collect() == [("src/a.rs", 2, 7)]
    assert lookup.goto_definition(w, "a.md", 0, 2).collect() == []
    assert at(0, 5) == ["**fn** `A::go`\n\n`src/a.rs`"]
    assert at(1, 1)[0].endswith("**b.md**\n\n- H") and at(1, 1)[0].startswith(lookup.STALE_HEADING)
    assert at(1, 13) == [] and at(0, 24) == ["**Term**\n\nA word."]
    assert lookup.code_lens(w, "src/a.rs").collect() == [("src/a.rs", "A::go", 2, 7, 1)]
    assert {r.label for r in lookup.completion_items(w).collect()} >= {"a.md", "b", "src/a.rs@A", "src/a.rs@A::go"}
    spots = spark.createDataFrame([("x [[a",), ("[[a]] b",), ("none",), ("😀[[",)], "t string").select(lookup.completion_range(F.col("t")))
    assert [r[0] for r in spots.collect()] == [4, None, None, 4]


def test_symbol_ids_are_dense_and_ordered(spark):
    files = spark.createDataFrame([("z.rs", RUST), ("a.h", "int x;"), ("b.c", "int y;"), ("a.rs", RUST)], "path string, content string").repartition(4)
    rows = documents.numbered(documents.sources(files)).orderBy("symbol_id").collect()
    assert [(r.symbol_id, r.file, r.qualified) for r in rows] == [(0, "a.rs", "A"), (1, "a.rs", "A::go"), (2, "z.rs", "A"), (3, "z.rs", "A::go"), (4, "b.c", "y"), (5, "a.h", "x")]


def test_empty_workspace(spark):
    w = graph.index(spark.createDataFrame([], "path string, content string"))
    assert w.stats().first()[:] == (0, 0, 0, 0)
    assert json.loads(graph.to_json(w.nodes, w.edges).first()[0]) == {"nodes": [], "edges": []}


@pytest.mark.parametrize("name", ["resolution_summary", "graph_stats", "debounce_sessions"])
def test_queries_run(spark, sf, name):
    from graphloom.plans.registry import QUERIES

    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("folders", ["1", "2", "99"])
def test_folders_are_dealt_out(spark, tmp_path, folders):
    want = set()
    for path in ("a.md", "x/b.md", "x/y/c.rs", "x/y/z/d.md", "w/e.c", "w/target/no.md", "v/.git/no.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
        want |= {path} if "no" not in path else set()
    rows = workspace.read(spark, str(tmp_path), folders=folders).collect()
    assert {r.path for r in rows} == want and all(r.content == r.path for r in rows) and len(rows) == len(want)


def test_places_are_in_utf16_units(spark):
    w = index(spark, {"a.md": "😀 Term here", "glossary/Term.md": "A word.", "b.md": "😀😀 [[a]] [[a]]"})
    at = lookup.places(spark, ("a.md", 0, 2), ("a.md", 0, 3), ("a.md", 0, 6), ("a.md", 0, 7), ("b.md", 0, 4), ("b.md", 0, 5), ("b.md", 0, 9), ("b.md", 0, 10), ("b.md", 0, 11))
    found = {(r.path, r.character): (r.hover[:8], r.start_utf16, r.end_utf16) for r in lookup.hovers_at(w, at).collect()}
    term, note = ("**Term**", 3, 7), ("**a.md**", 5, 10)
    assert found == {("a.md", 3): term, ("a.md", 6): term, ("b.md", 5): note, ("b.md", 9): note, ("b.md", 11): ("**a.md**", 11, 16)}
    links = {(r.path, r.start_utf16, r.target_uri) for r in lookup.document_links(w, "file:///r").collect()}
    assert links == {("a.md", 3, "file:///r/glossary/Term.md"), ("b.md", 5, "file:///r/a.md"), ("b.md", 11, "file:///r/a.md")}
    assert lookup.definitions_at(w, at).count() == 3


def test_code_definitions_have_the_range_of_the_name(spark):
    w = index(spark, {"a.rs": "/* 😀 */ struct Äb;", "n.md": "[[a.rs@Äb]]"})
    row = lookup.definitions_at(w, lookup.places(spark, ("n.md", 0, 1)), "file:///r").first()
    assert (row.uri, row.to_line, row.to_utf16, row.to_end_line, row.to_end_utf16) == ("file:///r/a.rs", 0, 16, 0, 18)


def test_completions_at_places(spark):
    files = spark.createDataFrame([("a.md", "x\r\n😀 [[ab]] [[c"), ("b.md", None)], "path string, content string")
    at = lookup.places(spark, ("a.md", 0, 1), ("a.md", 1, 4), ("a.md", 1, 5), ("a.md", 1, 7), ("a.md", 1, 9), ("a.md", 1, 13), ("a.md", 1, 99), ("a.md", 7, 0), ("b.md", 0, 0), ("none.md", 0, 0))
    assert {(r.line, r.character): r.replace_from for r in lookup.completions_at(files, at).collect()} == {(1, 5): 5, (1, 7): 5, (1, 13): 12, (1, 99): 12}


def test_commands(spark):
    w = index(spark, {"a.rs": RUST, "a.md": "# H"})
    assert commands.run(w, "symbolInfo", [1]).collect() == [(1, "a.rs", 2, 7)] and commands.run(w, "symbolInfo", [9]).count() == 0
    assert len(json.loads(commands.run(w, "graph", [True]).first()[0])["nodes"]) == 4 and len(json.loads(commands.run(w, "graph").first()[0])["nodes"]) == 3
    parts = commands.run(w, "graphParts", [True]).orderBy("ordinal").collect()
    assert json.loads("".join(p.text for p in parts)) == json.loads(commands.run(w, "graph", [True]).first()[0])
    with pytest.raises(commands.UnknownCommand):
        commands.run(w, "other")
    for wrong in (None, ["x"], [True]):
        with pytest.raises(ValueError):
            commands.run(w, "symbolInfo", wrong)


def test_node_ids(spark):
    ids = ["doc:a b.md", "section:x/a.md#H # 1", "section:a#b#c", "symbol:12", "symbol:x", "term:T:t", "other:x", "doc", None]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select(graph.node_id(F.col("id")).alias("n"))
    assert [tuple(r.n) if r.n else None for r in rows.collect()] == [("doc", "a b.md", None, None, None), ("section", "x/a.md", "H # 1", None, None), ("section", "a", "b#c", None, None), ("symbol", None, None, 12, None), ("symbol", None, None, None, None), ("term", None, None, None, "T:t"), None, None, None]


def test_json_lines_and_limits(spark, tmp_path, monkeypatch):
    w = index(spark, {"a.md": "# H\n[[b]]", "b.md": ""})
    path = graph.write_json(w.nodes, w.edges, str(tmp_path / "g"), include_sections=True)
    assert spark.read.json(f"{path}/nodes").count() == 3 and spark.read.json(f"{path}/edges").count() == 2
    monkeypatch.setattr(graph, "MOST_JSON", 2)
    with pytest.raises(ValueError):
        graph.to_json(w.nodes, w.edges)


def test_terms_and_buffers(spark):
    files = spark.createDataFrame([("a.md", "old"), ("b.md", "kept")], "path string, content string")
    over = workspace.buffers_over(files, spark.createDataFrame([("a.md", ""), ("new.md", "x")], "path string, text string"))
    assert sorted(tuple(r) for r in over.collect()) == [("a.md", ""), ("b.md", "kept")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# H\n[[b]]")
    assert cli.main(["index", str(tmp_path)]) == 0
    out = capsys.readouterr()
    assert {n["id"] for n in json.loads(out.out)["nodes"]} == {"doc:a.md", "section:a.md#H"} and out.err.startswith("2 nodes, 1 edges")
    assert cli.main([]) == 2
