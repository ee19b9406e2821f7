"""Live reindexing: changes of a folder, the trailing edge of a burst, and versions made from what changed."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.sources import changes, workspace
from graphloom.streaming import published, reindex

TRIGGER = "root string, n long"


@pytest.fixture(autouse=True)
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def until(seen, seconds=60):
    end = time.time() + seconds
    while not seen() and time.time() < end:
        time.sleep(0.2)
    return seen()


def test_one_trigger_fires_once_and_nothing_is_left(spark, tmp_path):
    source, told = tmp_path / "in", []
    spark.createDataFrame([("r", 1), ("r", 2), ("s", 1)], TRIGGER).coalesce(1).write.parquet(str(source))

    def keep(batch, _):
        told.extend((r.root, r.n_events) for r in batch.collect())

    stream = reindex.debounced(spark.readStream.schema(TRIGGER).parquet(str(source)))
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        assert until(lambda: len(told) >= 2) and sorted(told) == [("r", 2), ("s", 1)]
        spark.createDataFrame([("r", 3)], TRIGGER).coalesce(1).write.mode("append").parquet(str(source))
        assert until(lambda: len(told) >= 3)
        at = query.lastProgress.batchId
        assert until(lambda: query.lastProgress.batchId > at + 2)  # quiet goes on, and nothing more is told
        assert sorted(told) == [("r", 1), ("r", 2), ("s", 1)]
        assert query.lastProgress.stateOperators[0].numRowsTotal == 0
    finally:
        query.stop()


def test_a_later_trigger_puts_it_off(spark, tmp_path):
    source, told = tmp_path / "in", []
    write = lambda n: spark.createDataFrame([("r", n)], TRIGGER).coalesce(1).write.mode("append").parquet(str(source))
    write(0)
    stream = reindex.debounced(spark.readStream.schema(TRIGGER).parquet(str(source)), gap_ms=6_000)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: told.extend((r.n_events, r.fires_at) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        for n in (1, 2):
            time.sleep(2)
            write(n)
        last = time.time() * 1000
        assert until(lambda: told) and told[0][0] == 3 and told[0][1] >= last + 5_000
    finally:
        query.stop()


def test_closed_buffers_end(spark, tmp_path):
    schema, source, last = "uri string, seq long, action string, text string", tmp_path / "in", {}
    write = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(source))
    write(("a", 1, "open", "x"), ("b", 1, "open", "y"))
    stream = reindex.buffer_stream(spark.readStream.schema(schema).parquet(str(source)), keep_closed_ms=15_000)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: last.update({r.uri: (r.seq, r.text, r.open) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        assert until(lambda: len(last) == 2)
        write(("a", 5, "close", None))
        assert until(lambda: last["a"] == (5, None, False))
        write(("a", 4, "change", "late"), ("b", 2, "change", "z"))
        assert until(lambda: last["b"] == (2, "z", True)) and last["a"] == (5, None, False)
        assert until(lambda: query.lastProgress.stateOperators[0].numRowsTotal == 1)  # b alone, once a's number has lived its time
    finally:
        query.stop()


def put(folder, path, text):
    (folder / path).parent.mkdir(parents=True, exist_ok=True)
    (folder / path).write_text(text)


def test_looks_find_edits_moves_and_deletions(spark, tmp_path):
    folder, state = tmp_path / "w", str(tmp_path / "state")
    for p in ("a.md", "b/c.rs", "b/d.md", "target/no.md"):
        put(folder, p, p)
    said = lambda df: sorted((r.path, r.change) for r in df.collect())
    assert changes.last_look(spark, state) == 0
    assert said(changes.look(spark, str(folder), state)) == [("a.md", "made"), ("b/c.rs", "made"), ("b/d.md", "made")]
    assert said(changes.look(spark, str(folder), state)) == []
    put(folder, "a.md", "edited")
    (folder / "b/c.rs").rename(folder / "e.rs")
    assert said(changes.look(spark, str(folder), state)) == [("a.md", "edited"), ("b/c.rs", "deleted"), ("e.rs", "made")]
    (folder / "b/d.md").unlink()
    (folder / "b").rmdir()
    assert said(changes.look(spark, str(folder), state)) == [("b/d.md", "deleted")]
    assert changes.last_look(spark, state) == 4 and said(changes.since(spark, state, 2)) == [("a.md", "edited"), ("b/c.rs", "deleted"), ("b/d.md", "deleted"), ("e.rs", "made")]
    stream = changes.stream(spark, state).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("seen").count() == 7


def told(tables):
    return {n: sorted(tuple(map(str, r)) for r in t.select(sorted(t.columns)).collect()) for n, t in tables.items()}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


RUST = ["struct A;\nimpl A {\n    fn go(&self) {}\n}\n", "struct A;\nstruct A;\n", "fn go() {}\n", ""]


def edit(r, files):
    """A random change of a few files."""
    after = dict(files)
    for _ in range(r.randrange(1, 4)):
        kind = r.choice(["note", "note", "source", "delete", "move", "term", "shift"])
        notes = [p for p in after if p.endswith(".md") and not p.startswith("glossary/")]
        if kind == "note":
            links = " ".join(r.choice(["[[n1]]", "[[n2#H]]", "[[x/n3.md#Top]]", "[[s1.rs@A::go]]", "[[s2.rs@A]]", "[[gone]]", "Bus", "bus stop", "[[n4]]"]) for _ in range(5))
            after[r.choice([*notes, "n1.md", "x/n1.md", "n4.md"])] = f"# {r.choice(['H', 'Top', 'Other'])}\n{links}\n"
        elif kind == "source":
            after[r.choice(["s1.rs", "s2.rs", "s3.c"])] = r.choice(RUST)
        elif kind == "delete" and len(after) > 3:
            del after[r.choice(sorted(after))]
        elif kind == "move" and notes:
            after["x/" + r.choice("abc") + ".md"] = after.pop(r.choice(notes))
        elif kind == "term":
            name = f"glossary/{r.choice(['Bus', 'bus stop', 'H'])}.md"
            after.pop(name, None) if name in after and r.random() < 0.5 else after.update({name: r.choice(["# Def\n", "Bus again\n"])})
        elif kind == "shift" and "s1.rs" in after:
            after["s1.rs"] = "\n\n\n" + after["s1.rs"]
    return after


def test_refreshed_equals_rebuilt(spark, tmp_path):
    r = random.Random(8)
    files = {"n1.md": "# H\n[[s1.rs@A::go]] [[n2]] Bus\n", "n2.md": "# H\n[[n1#H]] [[x/n3.md]]\n", "x/n3.md": "# Top\n[[s2.rs@A]] [[s1.rs@A]]", "s1.rs": RUST[0], "s2.rs": RUST[1], "glossary/Bus.md": "# A bus\n"}
    out = str(tmp_path / "live")
    reindex.rebuild(frame(spark, files), out)
    for k in range(3):
        after = edit(r, files)
        touched = sorted(p for p in {*files, *after} if files.get(p) != after.get(p)) + ["n2.md", "never.md"]  # one is only touched
        said = reindex.refresh(frame(spark, after), spark.createDataFrame([(p,) for p in touched], "path string"), out)
        whole = str(tmp_path / f"whole{k}")
        want = reindex.rebuild(frame(spark, after), whole)
        assert tuple(said)[:4] == tuple(want)[:4], (k, files, after)
        assert told(reindex.published(spark, out)) == told(reindex.published(spark, whole)), (k, files, after)
        assert told(published.published(spark, out, names=("hashes", "terms", "docs"))) == told(published.published(spark, whole, names=("hashes", "terms", "docs")))
        files = after
    kept = [p.name for p in (tmp_path / "live").iterdir() if p.name.isdigit()]
    assert len(kept) == published.KEPT and reindex.versions(spark, out).count() == 4


def test_a_refresh_reads_only_what_was_touched(spark, tmp_path):
    files = {"a.md": "# A\n[[b]] [[s.rs@A]]", "b.md": "# B\nold", "s.rs": "struct A;", "glossary/T.md": "x"}
    out = str(tmp_path / "out")
    reindex.rebuild(frame(spark, files), out)
    for p, text in {"b.md": "# B\n[[a]] T", "s.rs": "\n\nstruct A;", "c.md": "[[b]]"}.items():
        after = files | {p: text}
        guarded = frame(spark, after).withColumn("content", F.when(F.col("path") == p, F.col("content")).otherwise(F.raise_error(F.lit("read what was not touched"))))
        reindex.refresh(guarded, spark.createDataFrame([(p,)], "path string"), out)
        files = after
    want = str(tmp_path / "want")
    reindex.rebuild(frame(spark, files), want)
    assert told(reindex.published(spark, out)) == told(reindex.published(spark, want))


def test_a_folder_is_followed(spark, tmp_path):
    folder, state, out = tmp_path / "w", str(tmp_path / "state"), str(tmp_path / "out")
    put(folder, "a.md", "# A\n[[b]]")
    changes.look(spark, str(folder), state)
    query = reindex.follow(spark, str(folder), state, out).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        assert until(lambda: published.last(spark, out) is not None and published.last(spark, out).edge_count == 1, 90)
        put(folder, "b.md", "# B\n")
        changes.look(spark, str(folder), state)
        assert until(lambda: published.last(spark, out).edge_count == 3, 90)  # two sections and a link
    finally:
        query.stop()
    want = str(tmp_path / "want")
    reindex.rebuild(workspace.read(spark, str(folder)), want)
    assert told(reindex.published(spark, out)) == told(reindex.published(spark, want))
    seen = reindex.notices(spark, out).writeStream.format("memory").queryName("notices").option("checkpointLocation", str(tmp_path / "n")).trigger(availableNow=True).start()
    seen.awaitTermination(60)
    assert spark.table("notices").count() == 2


def test_watching_looks_on_its_own(spark, tmp_path):
    folder, state = tmp_path / "w", str(tmp_path / "state")
    put(folder, "a.md", "x")
    query = changes.watch(spark, str(folder), state).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        assert until(lambda: changes.last_look(spark, state) >= 1)
        put(folder, "b.md", "y")
        assert until(lambda: any(r.path == "b.md" for r in changes.since(spark, state, 1).collect()))
    finally:
        query.stop()
