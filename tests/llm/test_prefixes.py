"""Token counts of prefixes against the library, which codes every prefix anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, prefixes, registry
from graphloom.llm.tokens import tokenizer_file

from tests.llm import helpers as H

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "'s", "1", "22", "!", "é", "用", "😀", "\x1c", "\x85", "　", "<|endoftext|>", "<|end", "ing", "aaa", "'ll", " 've", "\r\n", "ß", "١", "՘", "\U00010942"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_file(prefixes.TOKENIZER))
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def counts(text):
    return np.cumsum(np.frombuffer(prefixes.counter(prefixes.TOKENIZER).steps(text), "<i2"), dtype=np.int64).tolist()


def test_every_prefix(library):
    r = random.Random(11)
    for _ in range(1500):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(1, 14)))
        assert counts(text) == [library(text[:k]) for k in range(1, len(text) + 1)], repr(text)


@pytest.mark.parametrize("text", [" " * 700 + "x", "\n" * 300, "a" * 999, "ab" * 500, "0123456789" * 90, "用" * 400, "😀🙂" * 200, "!?" * 400, " \t\n" * 200 + "'s"])
def test_long_runs(library, text):
    assert counts(text) == [library(text[:k]) for k in range(1, len(text) + 1)]


def test_random_letters(library):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    found = counts(text)
    assert all(found[k - 1] == library(text[:k]) for k in (1, 2, 77, 5000, 99_999, 200_000))


def test_texts_of_the_table(spark, sf, library):
    docs = common.table(spark, sf, "documents")
    want = sorted((d.doc_id, len((d.text or "").encode()), library(d.text or "")) for d in docs.collect())
    got = registry.op11_prefix_counts(spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    texts = {d.doc_id: d.text or "" for d in docs.collect()}
    for r in got:
        assert r.over_limit == (r.n_tokens > 1024) and r.fit_tokens <= 1024 and library(texts[r.doc_id][: r.fit_chars]) == r.fit_tokens
        assert r.over_limit or r.fit_chars == len(texts[r.doc_id])
    long = [r for r in got if r.over_limit][:5]
    assert all(library(texts[r.doc_id][:k]) > 1024 for r in long for k in range(r.fit_chars + 1, min(len(texts[r.doc_id]), r.fit_chars + 40)))


def test_odd_rows(spark, library):
    docs = H.odd_documents(spark)
    got = prefixes.prefixes(docs)
    rows = docs.select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=str) == sorted(((d.doc_id, len((d.text or "").encode()), library(d.text or "")) for d in rows), key=str)
    assert prefixes.cuts(prefixes.prefixes(docs.limit(0)), 5).count() == 0
    assert all(r.fit_chars == 0 and r.fit_tokens == 0 for r in prefixes.cuts(got, 0).filter("n_tokens > 0").collect())


def test_questions(spark, library):
    docs = spark.createDataFrame([(1, "It's a long text, isn't it? 用 😀 end"), (2, None), (3, "<|endoftext|> x")], "doc_id long, text string")
    counted = common.materialize(prefixes.prefixes(docs), "counted")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    asked = spark.createDataFrame([(d, k) for d in (1, 2, 3, 4) for k in (-1, 0, 1, 5, 9, 20, 99)] + [(1, None)], "doc_id long, chars long")
    got = {(r.doc_id, r.chars): r.n_tokens for r in prefixes.counts_at(counted, asked).collect()}
    assert got == {(d, k): None if k is None else library(texts[d][: max(0, k)]) for d, k in [tuple(r) for r in asked.collect()] if d in texts}
    for budget in (0, 1, 4, 100):
        cut = {r.doc_id: r.text for r in prefixes.truncated(docs, counted, budget).collect()}
        for d, text in texts.items():
            assert (cut[d] or "") == max((text[:k] for k in range(len(text) + 1) if library(text[:k]) <= budget), key=len)


def test_a_very_long_text(spark):
    text = "z9é" * 1_000_000
    row = prefixes.prefixes(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_bytes", "n_tokens", F.length("steps").alias("n")).first()
    assert row.n_bytes == 4_000_000 and row.n == 6_000_000 and row.n_tokens > 1_000_000
