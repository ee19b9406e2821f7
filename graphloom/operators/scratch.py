"""Tables written to the shared checkpoint folder, where a plan must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root_of(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session on one machine may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables that one owner writes and, once nothing reads them, deletes."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table: written once, and its shuffle files deleted then."""
        spark = df.sparkSession
        path = f"{root_of(spark)}/{name}-{uuid.uuid4().hex}"
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        self.made.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, since: int, before: int) -> None:
        """Delete the tables from number ``since`` to ``before``, which nothing still to be computed reads."""
        for made in self.made[since:before]:
            delete(*made)
        del self.made[since:before]

    def close(self) -> None:
        """Delete the tables: DataFrames that read them are of no use afterwards."""
        while self.made:
            delete(*self.made.pop())


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a batch that goes to a Python worker: Spark's default of 64 MB is held several times over, for each core.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends rows to Python in small batches from here on, unless it had set a size."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """``df`` as a table of ``scratch``, or one that stays until the shared folder is cleared."""
    return (scratch or Scratch()).keep(df, name)


def _sums(names: tuple[str, ...]) -> Callable:
    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                own = batch.column(f"of_{name}").to_numpy(zero_copy_only=False).astype("int64")
                ends = own.cumsum() + at[name]
                batch = batch.append_column(name, pa.array(ends - own, pa.int64()))
                at[name] = int(ends[-1]) if len(own) else at[name]
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32()))

    return run


def running(df: DataFrame, keys: list[str], sums: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name: SQL of a number): its sum over all rows before, by ``keys``.

    Rows are range-sorted, so that sums run inside partitions; a row for each partition gives what stands before
    it. ``df`` is read twice, once for the ranges, so it should be a table or cheap.
    """
    spark = df.sparkSession
    weighed = df.select("*", *(F.expr(x).cast("long").alias(f"of_{n}") for n, x in sums.items()))
    dealt = weighed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    schema = weighed.schema
    for name in sums:
        schema = schema.add(name, "long")
    placed = materialize(dealt.mapInArrow(_sums(tuple(sums)), schema.add("part", "integer")), "running", scratch)
    base, starts = [0] * len(sums), []
    for r in sorted(placed.groupBy("part").agg(*(F.sum(f"of_{n}") for n in sums)).collect()):  # a row for each partition
        starts.append((r[0], *base))
        base = [b + n for b, n in zip(base, r[1:], strict=True)]
    before = spark.createDataFrame(starts, "part int, " + ", ".join(f"base_{n} long" for n in sums))
    out = placed.join(F.broadcast(before), "part")
    return out.select(*df.columns, *((F.col(n) + F.col(f"base_{n}")).alias(n) for n in sums))
