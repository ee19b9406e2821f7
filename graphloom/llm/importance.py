"""Quality classifier by importance resampling with hashed n-gram models.

Words and word pairs of a text are hashed to ``buckets``. Target text (good labelled documents) and
raw text (all documents) each give a smoothed bucket distribution. A document's log weight is the sum
over its n-grams of log(target / raw), the log ratio of the two models' likelihoods, divided by
``temperature``. With a Gumbel number hashed from (seed, doc_id) added, the ``keep_share`` of rows with
the largest keys is a sample without replacement in proportion to the weights. Whole texts of hundreds
of words have log ratios far apart, so at temperature 1 chance decides near the cut only;
:func:`effective_rows` says how many rows of equal weight the weights are worth.

A text without words has weight 0. Rows with the key of the last one kept are kept too (rows that
repeat a doc_id and text tie). A null doc_id hashes as such. Without target documents all weights are
0. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .words import U, Words, chunks, grams, mix


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    temperature: float = 1.0
    smoothing: float = 1.0
    keep_share: float = 0.8
    seed: int = 7
    #: Bound on the labelled documents that the target model is fitted on, drawn by id hash.
    target_rows: int = 100_000


def text_buckets(texts: list[str | None], buckets: int):
    """The bucket of each word and word pair, and the number of the text of each."""
    w = Words(texts, lower=True)
    h, owner = w.word_hashes(), w.owner()
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    where = np.concatenate([h, grams(h, 2)[pair]]) if len(pair) else h
    return (mix(where) % U(buckets)).astype(np.int64), np.concatenate([owner, owner[pair]])


def _counts(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.array(batch.column("good").to_pylist(), bool)
            for start, part in chunks(batch.column("text").to_pylist()):
                b, owner = text_buckets(part, buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[good[start + owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(raw[seen], pa.int64()), pa.array(target[seen], pa.int64())], ["bucket", "raw", "target"])

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """log(target / raw) for each bucket. ``labels`` has doc_id, quality and toxic."""
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
    ids = common.sample(good.filter("good and doc_id is not null").select("doc_id"), settings.target_rows, "doc_id").select(F.col("doc_id").alias("id"), F.lit(True).alias("good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = marked.mapInArrow(_counts(settings.buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # a row for each bucket at most
    raw, target = np.zeros(settings.buckets), np.zeros(settings.buckets)
    raw[found.bucket.to_numpy(np.int64)], target[found.bucket.to_numpy(np.int64)] = found.raw, found.target
    if not target.sum():
        return np.zeros(settings.buckets)
    share = lambda c: (c + settings.smoothing) / (c.sum() + settings.smoothing * len(c))
    return np.log(share(target)) - np.log(share(raw))


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = (mix(ids.astype(np.int64).view(U) * U(2) + U(1) + mix(np.full(len(ids), seed, U))) >> U(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def ordered_bits(keys: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles, from 0 on and below 2**63 or so."""
    bits = (keys + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits)


def _score(model: np.ndarray, settings: Settings):
    def run(batches):
        for batch in batches:
            weights = []
            for _, part in chunks(batch.column("text").to_pylist()):
                b, owner = text_buckets(part, settings.buckets)
                weights.append(np.bincount(owner, weights=model[b], minlength=len(part)) / settings.temperature)
            weight = np.concatenate(weights) if weights else np.zeros(0)
            ids = batch.column("doc_id")
            numbers = np.array(ids.fill_null(-(1 << 62)).to_pylist(), np.int64)
            key = weight + gumbel(numbers, settings.seed)
            yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(key), pa.array(ordered_bits(key))], ["doc_id", "log_weight", "key", "bits"])

    return run


def cut(scored: DataFrame, most: int) -> int:
    """The ``most``-th largest of ``bits``: counts by leading bits narrow it down, 16 at a time."""
    above, low, high = 0, -(1 << 63), (1 << 63) - 1
    for shift in (48, 32, 16, 0):
        inside = scored.filter(F.col("bits").between(low, high))
        counts = inside.groupBy(F.shiftright("bits", shift).alias("p")).agg(F.count("*").alias("n")).collect()  # 65,536 at most
        for p, n in sorted(((r.p, r.n) for r in counts), reverse=True):
            if above + n >= most:
                low, high = p << shift, (p << shift) + (1 << shift) - 1
                break
            above += n
    return low


def effective_rows(scored: DataFrame) -> float:
    """(sum of weights)**2 / sum of squared weights, of rows with log_weight."""
    top = scored.agg(F.coalesce(F.max("log_weight"), F.lit(0.0))).first()[0]
    w = F.exp(F.col("log_weight") - top)
    return scored.agg(F.coalesce(F.sum(w) * F.sum(w) / F.sum(w * w), F.lit(0.0))).first()[0]


def resample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, log_weight, key and kept for every row of ``docs`` (doc_id, text)."""
    rows = common.to_python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scored = common.materialize(rows.mapInArrow(_score(fit(rows, labels, settings), settings), "doc_id long, log_weight double, key double, bits long"), "importance")
    most = int(np.ceil(scored.count() * settings.keep_share))
    least = cut(scored, most) if most else 0
    return scored.select("doc_id", "log_weight", "key", (F.col("bits") >= least).alias("kept"))
