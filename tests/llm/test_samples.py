"""Training samples where a third of the rows lack an id and a third share one."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, langid, pii, secrets


@pytest.fixture(scope="module")
def rows(spark):
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long")
    text = F.concat(F.lit("mail me at a"), F.col("id").cast("string"), F.lit("@b.org about the other things we said "), F.sha2(F.col("id").cast("string"), 256))
    return common.materialize(spark.range(30_000).select(ids.alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang")), "sample-rows")


def kinds(df):
    """Of rows without an id, with the shared one, and with their own."""
    r = df.select(F.count_if(F.col("doc_id").isNull()), F.count_if(F.col("doc_id") == 7), F.count_if(F.col("doc_id") != 7)).first()
    return tuple(r)


def test_all_kinds_of_rows_are_drawn(rows):
    none, shared, own = kinds(common.sample(rows, 900, "doc_id", "text"))
    assert none + shared + own == 900 and min(none, shared, own) > 200


def test_copies_count_once(spark, rows):
    hot = rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("n")
    drawn = common.sample(rows.unionByName(hot), 500, "doc_id", "text")
    assert drawn.count() == drawn.distinct().count() <= 500 and drawn.count() > 200


def test_languages_bring_a_bounded_number_of_rows(spark, rows, monkeypatch):
    brought = []
    real = type(rows).toLocalIterator
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda self, *a: brought.append(self.count()) or real(self, *a))
    hot = rows.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("n")
    found = langid.train(rows.unionByName(hot), langid.Settings(sample_rows=100))
    assert set(found) == {"en", "de"} and brought and 100 < brought[0] <= 200


def test_others_train_on_all_kinds(spark, rows):
    assert secrets.samples(rows, secrets.Settings(sample_rows=50, random_strings=10)).filter("not random").count() > 0
    usable = rows.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    assert min(kinds(common.sample(usable, pii.Settings().sample_rows, "doc_id", "text"))) > 100
