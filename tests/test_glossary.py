"""Glossaries of any size: shards find what one automaton finds."""

import random

import pytest

from graphloom.functions import markdown
from graphloom.functions.terms import Matcher
from graphloom.operators import documents, glossary, graph, lookup


def said(df):
    return sorted(tuple(r) for r in glossary.said(df).collect())


def workspace(seed, n_terms=120, n_notes=40):
    r = random.Random(seed)
    words = ["bus", "bus stop", "bus stop sign", "stop", "sign", "用語", "用", "語", "語集", "LIN", "x_y", "a.b", "é", "éa"] + [f"t{k}" for k in range(n_terms)] + [f"t{k} t{k + 1}" for k in range(0, n_terms, 3)]
    files = {f"glossary/{w}.md": f"# About {w}\n\n{r.choice(words)} and {w}\n" for w in words}
    files |= {f"glossary/sub/{w}.md": f"{w} again" for w in r.sample(words, 15)}
    for k in range(n_notes):
        parts = [r.choice(["", "`", "[[", "]]", "`", "\n", "\n\n", " ", "😀"]) + r.choice(words) + r.choice([" ", "", ".", "バス"]) for _ in range(60)]
        files[f"n{k}.md"] = ("---\nbus: stop\n---\n" if k % 3 == 0 else "") + "".join(parts)
    files["empty.md"] = ""
    return files


def plain(files):
    """Mentions by trying every term, longest first, at every place."""
    own = {}
    for path in sorted(p for p in files if p.startswith("glossary/")):
        own.setdefault(path.rsplit("/", 1)[1][:-3], path)
    order = sorted(own, key=lambda n: -len(n.encode()))
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
    out = []
    for path, text in files.items():
        note = markdown.read(text)
        shut = {i for a, b in note.code + note.brackets for i in range(a, b)}
        at = note.body
        while at < len(text):
            hit = None
            for n in order if at not in shut else ():
                end = at + len(n)
                if text.startswith(n, at) and not (n.isascii() and (at and text[at - 1] in word or end < len(text) and text[end] in word)):
                    hit = n
                    break
            if hit and own[hit] != path:
                out.append((path, hit, at))
            at += len(hit) if hit else 1
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_shards_equal_one_automaton_and_brute_force(spark, shards):
    files = workspace(shards)
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    own = glossary.unique(glossary.terms(df))
    whole = documents.notes(df, Matcher([(k, r.name, r.path) for k, r in enumerate(own.collect())]))
    cut = glossary.sharded(df, own, shards)
    assert said(cut) == said(whole)
    places = []
    for r in glossary.said(cut).collect():
        lines = markdown.Lines(files[r.path])
        places.append((r.path, r.name, lines.starts[r.start_line] + r.start_char))
    assert sorted(places) == plain(files)
    rest = [c for c in cut.columns if c != "mentions"]
    assert sorted(map(str, cut.select(rest).collect())) == sorted(map(str, whole.select(rest).collect()))


def test_size_decides_and_nothing_is_refused(spark, monkeypatch):
    files = spark.createDataFrame(list(workspace(9, 400, 5).items()), "path string, content string")
    terms = glossary.terms(files)
    sent = said(glossary.annotated(files, terms))
    called = []
    real = glossary.sharded
    monkeypatch.setattr(glossary, "sharded", lambda *a: called.append(a[2]) or real(*a))
    assert said(glossary.annotated(files, terms, broadcast_bytes=100, shard_bytes=2000)) == sent and called and called[0] > 5
    assert said(glossary.annotated(files, terms)) == sent and len(called) == 1


def test_no_terms(spark):
    files = spark.createDataFrame([("a.md", "text"), ("glossary/.md", "no name")], "path string, content string")
    assert said(glossary.annotated(files, glossary.terms(files).filter("false"))) == []
    assert said(glossary.sharded(files, glossary.unique(glossary.terms(files)).filter("false"), 3)) == []


def test_statuses_need_no_ids_and_few_sources(spark):
    files = {"a.md": "[[s.rs@A]] [[s.rs@B]] [[s.rs@C]] [[n]]", "s.rs": "struct A;\nstruct B;\nmod B {}\n", "other.rs": "struct Z;"}
    w = graph.index(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert {r.raw: (r.status, r.n_candidates) for r in w.statuses.collect()} == {"s.rs@A": ("CodeResolved", 1), "s.rs@B": ("CodeAmbiguous", 2), "s.rs@C": ("CodeDangling", 0), "n": ("DocDangling", 0)}
    assert "symbols" not in w.__dict__ and {r.file for r in w.named.collect()} == {"s.rs"}
    assert {(r.raw, r.status) for r in w.resolved.collect()} == {(r.raw, r.status) for r in w.statuses.collect()}
    assert lookup.code_lens(w).collect() == lookup.code_lens(w, "s.rs").collect() == [("s.rs", "A", 0, 7, 1)]


def test_json_in_parts_is_the_document(spark, tmp_path):
    import json

    rows = {f"d{k}.md": f"# H{k}\n# H{k}\n[[d{k + 1}]] [[d{k + 1}]] \"quoted\"" for k in range(30)}
    for files in ({}, {"a.md": ""}, rows):
        w = graph.index(spark.createDataFrame(list(files.items()), "path string, content string"))
        for include in (True, False):
            parts = graph.json_parts(w.nodes, w.edges, include, w.scratch).orderBy("ordinal").collect()
            text = "".join(p.text for p in parts)
            assert [p.ordinal for p in parts] == list(range(len(parts))) and all(text[p.at :].startswith(p.text) for p in parts)
            assert json.loads(text) == json.loads(graph.to_json(w.nodes, w.edges, include).first()[0])
        path = graph.write_document(w.nodes, w.edges, str(tmp_path / f"g{len(files)}"), True, w.scratch)
        written = "".join(p.read_text() for p in sorted((tmp_path / f"g{len(files)}").glob("part-*")))
        assert json.loads(written)["nodes"] == json.loads(graph.to_json(w.nodes, w.edges, True).first()[0])["nodes"]
        w.close()
        assert not w.scratch.made


def test_closing_deletes_what_was_written(spark):
    import os

    w = graph.index(spark.createDataFrame([("a.md", "[[b]]"), ("s.rs", "fn a() {}")], "path string, content string"))
    w.stats().collect()
    made = [p for _, p in w.scratch.made]
    assert made and all(os.path.isdir(p) for p in made)
    w.close()
    assert not any(os.path.exists(p) for p in made)


def test_contents_are_not_moved_for_each_shard(spark):
    files = spark.createDataFrame(list(workspace(3, 50, 5).items()), "path string, content string")
    own = glossary.materialize(glossary.unique(glossary.terms(files)), "own")
    plan = glossary.sharded(files, own, 30)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "content" not in plan


def test_a_sieve_loses_no_term(monkeypatch):
    from graphloom.functions import terms

    monkeypatch.setattr(terms, "PIECE", 50)  # texts are cut, and short ones put together
    files = workspace(5)
    names = sorted({p.rsplit("/", 1)[1][:-3] for p in files if p.startswith("glossary/")})
    table = terms.np.zeros(64, terms.U)
    at, bits = terms.marks(terms.name_hashes(names), len(table))
    terms.np.bitwise_or.at(table, at, bits)
    shapes = {(-1 if n.isascii() else [c.isascii() for c in n].index(False), len(n)) for n in names}
    texts = [*files.values(), "", "bus", "x" * 49 + " bus stop sign", "用" * 120]
    bodies = [markdown.body_start(t) for t in texts]
    matcher = Matcher([(k, n, "") for k, n in enumerate(names)])
    for text, body, found in zip(texts, bodies, terms.Sieve(table, list(shapes)).places(texts, bodies), strict=True):
        assert {(a, n) for a, _, n, _ in matcher.hits(text, body)} <= set(found) and found == sorted(found)
        assert all(body <= a and a + n <= len(text) for a, n in found)


def test_links_are_read_without_the_glossary(spark):
    files = {"a.md": "[[b]] T [[s.rs@A]]", "b.md": "", "s.rs": "struct A;", "t.rs": "struct B;\nstruct C;", "glossary/T.md": "x"}
    w = graph.index(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert lookup.diagnostics(w).count() == 0 and "parsed" not in w.__dict__
    assert {(r.raw, r.symbol_id) for r in w.resolved.collect()} == {("b", None), ("s.rs@A", 0)}
    assert {r.file for r in w.cited.collect()} == {"s.rs"} and w.symbols.count() == 3
    assert w.edges.filter("kind = 'mentions'").count() == 1 and w.noted is w.parsed
