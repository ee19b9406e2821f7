"""Debounce and buffers, batch and streaming."""

from pyspark.sql import functions as F

from graphloom.streaming import reindex


def test_bursts(spark):
    rows = spark.createDataFrame([("r", 0.0), ("r", 0.2), ("r", 0.4), ("r", 1.0), ("s", 0.1)], "root string, t double").select("root", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    assert sorted((r.root, r.n_events) for r in reindex.bursts(rows).collect()) == [("r", 1), ("r", 3), ("s", 1)]


def test_buffers(spark):
    rows = [("a", 1, "open", "x"), ("a", 2, "change", "y"), ("b", 3, "open", "z"), ("b", 4, "close", None)]
    changes = spark.createDataFrame(rows, "uri string, seq long, action string, text string")
    assert reindex.buffers(changes).collect() == [("a", 2, "y")]


def test_reindex_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("r", 0.0), ("r", 0.1), ("r", 100.0), ("s", 200.0)], "root string, t double").select("root", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts")).coalesce(1).write.parquet(str(source))
    seen = []
    stream = spark.readStream.schema("root string, ts timestamp").parquet(str(source))
    reindex.reindex_stream(stream, seen.extend).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert set(seen) == {"r"}


def test_buffer_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "open", "x"), ("a", 2, "change", "y"), ("b", 1, "open", "z"), ("b", 2, "close", None)], "uri string, seq long, action string, text string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("uri string, seq long, action string, text string").parquet(str(source))
    query = reindex.buffer_stream(stream).writeStream.outputMode("update").format("memory").queryName("buffers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("buffers").collect()) == [("a", 2, "y", True), ("b", 2, None, False)]


def changes_of(rows, spark):
    return spark.createDataFrame(rows, "uri string, seq long, action string, text string")


def test_late_changes_do_not_reopen(spark, tmp_path):
    """One micro-batch for each file, with rows that come late: the stream ends where the batch form does."""
    parts = [
        [("a", 5, "open", "five"), ("b", 1, "open", "b1"), ("c", 9, "close", None)],
        [("a", 6, "close", None), ("b", 3, "change", "b3")],
        [("a", 4, "change", "late"), ("b", 2, "change", "late too"), ("c", 8, "open", "late as well")],
        [("b", 4, "close", None), ("d", 1, "open", "d1"), ("b", 5, "open", "again")],
    ]
    source, schema = tmp_path / "in", "uri string, seq long, action string, text string"
    for rows in parts:
        changes_of(rows, spark).coalesce(1).write.mode("append").parquet(str(source))
        last = {}
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))

        def keep(batch, _):
            last.update({r.uri: r for r in batch.collect()})  # noqa: B023

        reindex.buffer_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        for uri, r in last.items():
            want = [x for x in reindex.buffers(spark.read.schema(schema).parquet(str(source))).collect() if x.uri == uri]
            assert (r.open, r.text) == ((True, want[0].text) if want else (False, None))
    assert sorted(tuple(r) for r in reindex.buffers(spark.read.schema(schema).parquet(str(source))).collect()) == [("b", 5, "again"), ("d", 1, "d1")]


def test_rebuild_and_publish(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "[[b]] [[none]]"), ("b.md", "# H")], "path string, content string")
    out = str(tmp_path / "index")
    first = reindex.rebuild(files, out)
    assert first.node_count == 2 + 1 and first.edge_count == 2
    assert [r.path for r in reindex.published(spark, out)["diagnostics"].collect()] == ["a.md"]
    buffers = spark.createDataFrame([("b.md", "# H\n[[nowhere]]")], "path string, text string")
    second = reindex.rebuild(files, out, buffers)
    now, before = reindex.published(spark, out), reindex.published(spark, out, first.version)
    assert [(r.path, r.start_line) for r in now["diagnostics"].collect()] == [("b.md", 1)]
    assert second.version > first.version and before["diagnostics"].first().path == "a.md" and now["nodes"].count() == 3


def test_a_burst_rebuilds_its_root(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("r", 0.0), ("r", 0.1), ("s", 200.0)], "root string, t double").select("root", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts")).coalesce(1).write.parquet(str(source))
    files = spark.createDataFrame([("a.md", "# A")], "path string, content string")
    told = []
    stream = spark.readStream.schema("root string, ts timestamp").parquet(str(source))
    reindex.reindex_stream(stream, lambda roots: told.extend((r, reindex.rebuild(files, f"{out}/{r}").node_count) for r in roots)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    assert told == [("r", 2)] and reindex.published(spark, f"{out}/r")["nodes"].count() == 2
