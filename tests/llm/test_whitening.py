"""Whitening against fractions, term by term."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, registry, whitening


def plain(vectors, components=4):
    """n, sums, exact covariance, eigenvalues and vectors of whole vectors."""
    fit = sorted({tuple(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    rows = [[Fraction(v[k]) - Fraction(sums[k], n) for k in range(d)] for v in fit]
    cov = [[sum(r[i] * r[j] for r in rows) / n for j in range(d)] for i in range(d)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    return n, sums, cov, values[::-1][:components], axes[:, ::-1][:, :components]


def scaled(v):
    return [math.floor(float(c) * 256) for c in v]


def test_digits_and_products():
    r = random.Random(2)
    for bits in (3, 19, 20, 21, 40, 60, 90):
        y = np.array([[r.randrange(-(1 << bits), (1 << bits) + 1) for _ in range(3)] for _ in range(50)], object if bits > 60 else np.int64)
        back = sum(np.vectorize(int, otypes=[object])(d) << whitening.BITS * k for k, d in enumerate(whitening.digits(y)))
        assert (back == y.astype(object)).all() and all(np.abs(d).max() <= 1 << whitening.BITS - 1 for d in whitening.digits(y))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.gram(y).tolist() == want
        assert whitening.squares(y) == [sum(int(c) ** 2 for c in row) for row in y]


def test_blocks_are_exact():
    y = np.full((2 * whitening.BLOCK_ROWS + 5, 2), (1 << 40) - 1, np.int64)
    assert whitening.gram(y)[0, 1] == len(y) * ((1 << 40) - 1) ** 2


def test_the_table(spark, sf):
    rows = common.table(spark, sf, "embeddings").collect()
    x = {r.vec_id: scaled(r.embedding) for r in rows}
    n, sums, cov, values, axes = plain(x.values())
    got = registry.op12_digit_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and got.count() == 4 * len(rows)
    trace = sum(cov[k][k] for k in range(len(cov)))
    sign = {}
    for r in got.collect():
        y = [n * c - s for c, s in zip(x[r.vec_id], sums, strict=True)]
        k = r.component - 1
        assert r.n == n and r.deviation == sum(c * c for c in y)
        assert abs(r.explained - values[k] / float(trace)) < 1e-9 and r.identity_error < 1e-9
        want = float(np.array([float(Fraction(c, n)) for c in y]) @ axes[:, k] / math.sqrt(values[k]))
        sign.setdefault(k, 1 if want * r.whitened > 0 else -1)
        assert abs(want - sign[k] * r.whitened) < 1e-7


def test_odd_rows(spark):
    good = [(1, [0.5, -0.25]), (2, [0.001, 1.0]), (3, [-0.0, 3.0]), (3, [-0.0, 3.0]), (None, [2.0, 0.1])]
    bad = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0]), (11, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame([(*r, "clash", 1) for r in good + bad], "vec_id long, embedding array<float>, x string, component int")
    got = whitening.whiten(rows).collect()
    assert len(got) == 2 * len(good) and {r.n for r in got} == {4}
    x = [scaled(v) for _, v in good]
    n, sums, *_ = plain(x)
    for (doc, _), v in zip(good, x, strict=True):
        assert {int(r.deviation) for r in got if r.vec_id == doc} == {sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))}
    assert whitening.whiten(rows.limit(0)).count() == 0 and whitening.whiten(rows.filter("vec_id >= 5 and vec_id < 10")).count() == 0


def test_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.n == 1 and r.deviation == 0 for r in one)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and max(r.identity_error for r in line) < 1e-9


@pytest.mark.parametrize("size", [1e6, 1e15, 1e30])
def test_large_entries_stay_exact(spark, size):
    r = random.Random(4)
    rows = [(k, [r.uniform(-size, size) for _ in range(3)]) for k in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert dict(got.dtypes)["deviation"] == "decimal(38,0)"
    top = (1 << 63) - 1
    x = [[max(-top - 1, min(top, c)) for c in scaled(v)] for _, v in rows]
    n, sums, *_ = plain(x)
    want = {k: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in enumerate(x)}
    for r in got.collect():
        assert (r.deviation is None and want[r.vec_id] >= 10**38) or int(r.deviation) == want[r.vec_id]


def test_merging_in_levels(spark, sf, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = common.table(spark, sf, "embeddings").select(whitening.whole("embedding").alias("x")).distinct().repartition(9)
    made = whitening.fit(x)
    n, sums, _, values, _ = plain([r.x for r in x.select(F.col("x")).collect()])
    assert (made.n, made.sums) == (n, sums) and np.allclose(made.values, values)
