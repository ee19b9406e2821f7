"""Embedding whitening on exact sums: covariances by digit-slice matrix products.

An entry c of a vector becomes the whole number x = floor(256 c). Sums over whole numbers do not depend on
how rows are dealt out, if they are exact: with n distinct vectors and sums S, the centred rows
y = n x - S are whole numbers too, and their products are taken on slices. Each y is cut into digits of
20 bits, kept as float64; products of digit matrices of up to 4096 rows stay below 2^53, so BLAS gives
them without rounding; they are put together as big integers, and blocks and tasks are merged by adding.
Only the merged matrix, divided by n^3, is rounded, and its eigenvectors are the components.

Rows whose vector is null, or holds a null, an infinite or no number, are left out, and so are vectors of
another length than most distinct ones have (of lengths that as many have, the longest stays). The fit counts each
distinct x once; every remaining row, repeated or without an id, is whitened. Entries beyond a long
count as its ends. A component without variance has no whitened values (null), and without any variance
``explained`` is null too. An empty table gives no rows. Columns but the vector and id are ignored.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

SCALE = 256
BITS = 20
BLOCK_ROWS = 1 << 12  # BLOCK_ROWS digit products, below 2^40 each, are exact in float64
#: Partial sums that are merged by one task, and at most so many on the driver.
FAN_IN = 32
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as float64 arrays d with y = sum of d[k] * 2^(BITS k), each digit's size at most 2^(BITS-1)."""
    out, half, base = [], 1 << BITS - 1, 1 << BITS
    while True:
        low = (y + half) % base - half
        out.append(low.astype(np.float64))
        y = (y - low) >> BITS
        if not y.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """The exact matrix of sums of products of the columns of ``y``, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK_ROWS):
        slices = digits(y[at : at + BLOCK_ROWS])
        for i, a in enumerate(slices):
            for j, b in enumerate(slices[: i + 1]):
                part = (a.T @ b).astype(np.int64).astype(object) << BITS * (i + j)
                total += part if i == j else part + part.T
    return total


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    out = [0] * len(y)
    slices = digits(y)
    for i, a in enumerate(slices):
        for j, b in enumerate(slices[: i + 1]):
            part = np.einsum("rc,rc->r", a, b).astype(np.int64).tolist()  # below 2^53 for up to 2^15 columns
            by = BITS * (i + j) + (i != j)
            out = [s + (p << by) for s, p in zip(out, part, strict=True)]
    return out


def centred(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """n x - S, in 64 bits where they hold it; ``most`` is the largest size of an entry."""
    if 2 * n * most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _batches(width: int, batches):
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch.column("x"), width)


def _merged(df: DataFrame, start, add):
    """One value from partial ones (a pickled value a row): merged by tasks, FAN_IN to one, until few are left."""

    def run(batches):
        total = start()
        for batch in batches:
            for part in batch.column("part"):
                total = add(total, pickle.loads(part.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    parts = common.materialize(df, "partial-sums")
    tasks, df = parts.count(), parts
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        df = df.repartition(tasks).mapInArrow(run, "part binary")
    total = start()
    for r in df.collect():  # FAN_IN rows at most, of a bounded size each
        total = add(total, pickle.loads(r.part))
    return total


def _reduced(fit: DataFrame, width: int, start, step, add):
    """``step`` over the matrices of each task of ``fit``, and ``add`` over tasks."""

    def run(batches):
        total = start()
        for x in _batches(width, batches):
            total = step(total, x)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    return _merged(fit.select("x").mapInArrow(run, "part binary"), start, add)


def whole(vector: str) -> Column:
    """The whole numbers of a vector column; null for a vector that is left out."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    doubles = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & ~F.exists(doubles, bad)
    return F.when(good, F.transform(doubles, lambda c: F.floor(c * SCALE)))


@dataclass(frozen=True)
class Whitener:
    """n, the sums, the largest entry, eigenvalues in falling order, their unit vectors as columns, and the trace."""

    n: int
    sums: list[int]
    most: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def apply(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of centred ones; nan in components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (y.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)
        z[:, self.values <= 0] = np.nan
        return z


def eigen(total: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, vectors and trace of the exact matrix over n^3, each entry rounded once."""
    d = len(total)
    v = np.array([[total[i, j] / n**3 for j in range(d)] for i in range(d)])  # whole by whole: rounded correctly
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = float(Fraction(sum(total[i, i] for i in range(d)), n**3))
    flat = d * np.finfo(float).eps * max(values[0], 0.0) if d else 0.0
    return np.where(values > flat, values, 0.0), vectors, trace


def _add_moments(a, b):
    """Number, mean and centred products of two sets of rows together."""
    if a[0] == 0 or b[0] == 0:
        return b if a[0] == 0 else a
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, components: int = 4) -> Whitener | None:
    """The whitener of the distinct vectors in the column ``x`` (longs of one length); None if there are none."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    width = first.d
    zero = lambda: (0, [0] * width, 0)

    def count(total, x):
        low = (x & 0xFFFFFFFF).sum(0).tolist()
        high = (x >> 32).sum(0).tolist()
        sums = [s + a + (b << 32) for s, a, b in zip(total[1], low, high, strict=True)]
        return total[0] + len(x), sums, max(total[2], int(x.max()), -int(x.min()))

    add = lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)], max(a[2], b[2]))
    n, sums, most = _reduced(vectors, width, zero, count, add)
    total = _reduced(vectors, width, lambda: np.zeros((width, width), object), lambda t, x: t + gram(centred(x, n, sums, most)), lambda a, b: a + b)
    values, axes, trace = eigen(total, n, components)
    made = Whitener(n, sums, most, values, axes, trace)
    live = np.flatnonzero(values > 0)
    k = len(live)
    if not k:
        return made

    def moments(total, x):
        z = made.apply(centred(x, n, sums, most))[:, live]
        mean = z.mean(0)
        return _add_moments(total, (len(z), mean, (z - mean).T @ (z - mean)))

    count_z, _, products = _reduced(vectors, width, lambda: (0, np.zeros(k), np.zeros((k, k))), moments, _add_moments)
    error = float(np.abs(products / count_z - np.eye(k)).max())
    return Whitener(n, sums, most, values, axes, trace, error)


def _whiten(w: Whitener):
    k, width = len(w.values), len(w.sums)
    share = [float(v / w.trace) if w.trace > 0 else None for v in w.values]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(at, BLOCK_ROWS)
                y = centred(_matrix(rows.column("x"), width), w.n, w.sums, w.most)
                m, z = len(y), w.apply(y).ravel()
                ids = rows.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array([str(s) for s in squares(y)]).take(pa.array(np.repeat(np.arange(m), k)))
                arrays = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), deviation,
                    pa.array(z, mask=np.isnan(z)), pa.array(share * m, pa.float64()), pa.array([w.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """WHITENED: a row for each remaining row of ``embeddings`` (vec_id and the vector) and component.

    Distinct vectors are found by one shuffle, combined before it, and written to the shared folder; the
    fit reads them three times. Rows are whitened where they are read.
    """
    spark = embeddings.sparkSession
    rows = common.to_python(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole(vector).alias("x")).filter("x is not null and size(x) > 0"))
    every = common.materialize(rows.select("x").distinct(), "distinct-vectors")
    length = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).agg(F.max(F.struct("m", "d")).alias("top")).first().top
    made = fit(every.filter(F.size("x") == length.d), components) if length else None
    if made is None:
        return spark.createDataFrame([], WHITENED)
    text = WHITENED.replace("decimal(38,0)", "string")
    found = rows.filter(F.size("x") == len(made.sums)).mapInArrow(_whiten(made), text)
    return found.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
