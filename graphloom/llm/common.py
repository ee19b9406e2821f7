"""What the training-data operators share: table access and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker. Spark's default of 64 MB is held several times over,
#: by the JVM and by Python, for each core.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BATCH = "67108864b"


def to_python(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends rows to Python in small batches from here on, unless it had set a size.

    Spark reads the size when the result is computed, so it cannot be set back here.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session on one machine may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Shuffle files of what is written meanwhile go once it is written, not when their plans are collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Scratch tables of this process that were not deleted, oldest first.
MADE: list[str] = []


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with shuffles_deleted(spark):
        writer.parquet(path)
    MADE.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in MADE:
            MADE.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing still to be computed reads."""
    for df in frames:
        delete(df.sparkSession, [df.scratch])


def clear(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch tables made since MADE had ``since`` entries, once results are written elsewhere."""
    spared = {df.scratch for df in but}
    delete(spark, [p for p in MADE[since:] if p not in spared])


SALTS = 64


def lookup(rows: DataFrame, key: str, table: DataFrame, by: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique by ``key``) so that a hot key's rows go to many tasks.

    Rows are salted by a hash of the column ``by``; the table's rows are first joined to the pairs of key
    and salt that occur, at most SALTS of a key. ``rows`` is read twice, so it should be a table.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    known = salted.select(key, "__salt").distinct().join(table, key)
    return salted.join(known, [key, "__salt"], "left").drop("__salt")


def uniform(*columns: str) -> Column:
    """A number from 0 to 1 by the hash of the columns."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)


def sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, those with the least hash of the columns ``by``, which should tell rows apart; copies count once.

    A first cut by hash leaves few more than that, so no task or partition hands on ``rows`` of its own. An id
    alone does not tell rows apart: a third of them may lack one or share one, and would all pass or all go.
    """
    count = df.count()
    cut = df if count <= rows else df.filter(uniform(*by) <= 1.2 * rows / count + 1e-6)
    return cut.dropDuplicates([*by]).orderBy(uniform(*by), *by).limit(rows)
