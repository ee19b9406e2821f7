"""The pipeline against the same stages by brute force."""

import pytest

import corpus_pipeline
from graphloom.llm import mixing

from tests.llm import helpers as H
from tests.llm.test_operators import token_rows


def by_hand(rows, items, spark):
    kept = []
    for r in rows:
        n, _, _, _, repeated, covered, longest = H.repetition(r["text"])
        if not (n < 50 or 100 * repeated > 50 * n) and 100 * covered <= 30 * n and longest <= 100:
            kept.append(r)
    classes = {d: c for d, _, c in H.jaccard_classes([(r["doc_id"], r["text"]) for r in kept], 80, 5)}
    kept = [r for r in kept if classes[r["doc_id"]] == r["doc_id"]]
    kept = [r for r in kept if not H.contamination(r["text"], items)[-1]]
    drawn = mixing.mix(spark.createDataFrame(kept)).select("doc_id", "text").collect()
    return token_rows(sorted((r.doc_id, r.text) for r in drawn))


def test_pipeline_equals_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 6000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame = spark.createDataFrame(docs).select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.common.materialize(stage(spark, frame, sf), f"test-{name}")
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(tuple, frame.collect())) == sorted(by_hand(docs, items, spark))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_free", "mixed", "token_files"]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = H.odd_documents(spark)
    out = stage(spark, docs, sf)
    assert out.count() >= 0
    if k < 4:
        assert out.columns == docs.columns
    empty = stage(spark, docs.limit(0), sf)
    assert empty.count() == 0


def test_one_of_repeated_rows_stays(spark, sf):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (3, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted((tuple(r) for r in out), key=str) == [(1, "a b c d e f"), (3, None), (None, "x")]


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, sf):
    item = " ".join(spark.read.parquet(f"{sf}/benchmark.parquet").filter("item_id is not null").first().text.split())
    rows = [(None, item), (None, "clean and without an id"), (None, None), (7, f"before {item}"), (7, "clean of the same id"), (8, "clean")]
    out = corpus_pipeline.benchmark_free(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, out), key=str) == sorted((rows[k] for k in (1, 2, 4, 5)), key=str)


def test_one_row_of_each_class_stays(spark, sf):
    copy = "one two three four five six"
    rows = [(5, "a b"), (5, "same id, other text"), (1, "p q r s t"), (1, copy), (2, copy), (None, copy), (3, "p q r s t"), (None, "no id, no copy"), (None, "no id"), (None, "no id"), (4, ""), (4, "")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(5, "a b"), (5, "same id, other text"), (1, "p q r s t"), (1, copy), (None, "no id, no copy"), (None, "no id"), (4, "")], key=str)


@pytest.mark.parametrize("k", range(4))
def test_columns_of_any_name_keep_their_values(spark, sf, k):
    _, stage = corpus_pipeline.STAGES[k]
    names = ["__th", "__d", "__h", "__hit", "__times", "__u", "__rate", "copy", "rate", "shuffle_key", "th", "hit", "kept", "c0", "n_words", "sid"]
    text = "clean words that stand here alone " + " ".join(f"w{j}" for j in range(60))
    rows = [(i, f"{text} row {i} " + " ".join(f"v{i}x{j}" for j in range(60)), "s", *(f"{n}-{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "Text string", "source string", *(f"`{n}` string" for n in names)]))
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    found = {tuple(r) for r in out.collect()}
    assert found and found <= set(rows) and (k == 3 or found == set(rows))
