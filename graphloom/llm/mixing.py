"""Mix sources to target weights by Poisson replication.

A source of weight w, of all weights' sum W, should make up w/W of the output rows. Its documents
repeat at the mean rate ``w/W * size * rows / rows of the source``. How often one document repeats
is a Poisson number: a uniform number hashed from (seed, doc_id) is looked up in the inverse of the
distribution function. Copies are exploded and the whole table is shuffled by a hash of
(seed, doc_id, copy).

Without weights all sources weigh the same. Sources without a weight, or with 0, vanish; a null
source is a source of its own. A null doc_id hashes like the empty string; rows that share a doc_id
draw the same number. The documents' columns are passed on; added are ``copy`` (from 0), ``rate`` and
``shuffle_key``, to which columns of those names give way. Names that begin with __ are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

ADDED = ("copy", "rate", "shuffle_key")
SEED = "mix-1"
#: Rates of sources are broadcast while they take so many bytes at most; beyond, they are joined by a shuffle.
MOST_BROADCAST = 32_000_000
#: Hexadecimal digits of a hash that make a uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def distribution(rate: Column) -> Column:
    """Values of the Poisson distribution function at 0, 1, ... until nothing is left to a double."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.exp(-rate)
    grow = lambda acc, k: F.struct(
        (acc["term"] * rate / k).alias("term"),
        (acc["sum"] + acc["term"] * rate / k).alias("sum"),
        F.concat(acc["all"], F.array(acc["sum"] + acc["term"] * rate / k)).alias("all"),
    )
    return F.aggregate(steps, F.struct(start.alias("term"), start.alias("sum"), F.array(start).alias("all")), grow, lambda acc: acc["all"])


#: Above this exp(-rate) is not exact enough; a larger rate is a whole part plus a Poisson part.
MOST_RATE = 600.0


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0) -> DataFrame:
    """source, rate, whole and cdf for each source; ``weights`` has source and weight."""
    own = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        own = own.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        own = own.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("weight", F.coalesce(F.greatest("weight", F.lit(0.0)), F.lit(0.0)))
    totals = own.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()  # one row
    rows, all_weights = float(totals.rows or 0), float(totals.weights or 0)
    rate = F.col("weight") * F.lit(size * rows) / (F.lit(all_weights) * F.col("n")) if all_weights else F.lit(0.0)
    whole = F.when(F.col("rate") > MOST_RATE, F.floor(F.col("rate") - MOST_RATE)).otherwise(F.lit(0)).cast("int")
    return own.select("source", rate.alias("rate")).withColumn("whole", whole).withColumn("cdf", distribution(F.col("rate") - F.col("whole")))


def mix(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """Documents as often as drawn, in shuffled order; ``size`` is the output's rows over the input's.

    The shuffle key is a hash, so its leading digits deal rows evenly to partitions in order: bounds
    need no sampling of the rows, which would compute them twice.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    own = [F.col(f"`{c}`") for c in docs.columns]
    table = rates(docs, weights, size).select(*(F.col(c).alias(f"__{c}") for c in ("source", "rate", "whole", "cdf")))
    size_of = F.coalesce(F.octet_length(F.col("__source").cast("string")), F.lit(0)) + 8 * F.size("__cdf") + 64
    few = table.agg(F.coalesce(F.sum(size_of), F.lit(0))).first()[0] <= MOST_BROADCAST
    joined = docs.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("__source")))
    numbered = joined.withColumn("__u", uniform(F.lit(seed), F.col("doc_id")))
    times = F.col("__whole") + F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    drawn = numbered.select(*own, "__rate", times.alias("__times")).filter("__times > 0")
    copies = drawn.select(*own, "__rate", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__copy").cast("string")).cast("binary"))
    keyed = copies.select(*own, F.col("__copy").cast("long").alias("copy"), F.col("__rate").alias("rate"), key.alias("shuffle_key"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    place = F.floor(lead * width / (1 << 32)).cast("int")
    return keyed.repartitionById(width, place).sortWithinPartitions("shuffle_key")


#: The query's rows in DuckDB: 200 terms hold any rate of up to 60.
SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM terms WHERE k < 200
),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)} AS u FROM documents),
drawn AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, terms.rate, count(*) AS times
  FROM u JOIN terms ON u.source IS NOT DISTINCT FROM terms.source AND terms.cdf <= u.u
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, c AS copy, rate,
       md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || c) AS shuffle_key
FROM (SELECT *, unnest(range(times)) AS c FROM drawn)
"""
