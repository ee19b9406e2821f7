"""Changes to a folder as a stream: who was edited, made or deleted since the last look.

Each look lists the folder in tasks and is joined with the listing before, by path: a file whose time or size
differs was edited, one of either side alone was made or deleted, so a moved file is both and a deleted folder is all
its files. Listings and changes are tables in a state folder, numbered; a number counts once it stands in
``looks``, so a look that is cut short is done again. Streams read the table of changes as it grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from graphloom.operators.scratch import delete
from graphloom.sources import workspace

CHANGES = "root string, ts timestamp, path string, change string, look long"
LOOKS = "look long, root string, ts timestamp, n_changes long"
LISTED = "path string, modified long, size long"
#: Listings that are kept.
KEPT = 2


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def last_look(spark: SparkSession, state: str) -> int:
    """The number of the last whole look; 0 before the first."""
    if not exists(spark, f"{state}/looks"):
        return 0
    return spark.read.schema(LOOKS).parquet(f"{state}/looks").agg(F.coalesce(F.max("look"), F.lit(0))).first()[0]


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """path and change (made, edited, deleted) between two listings (path, modified, size), of unique paths."""
    before = old.select(F.col("path").alias("was"), F.col("modified").alias("m"), F.col("size").alias("s"))
    edited = (F.col("modified") != F.col("m")) | (F.col("size") != F.col("s"))
    kind = F.when(F.col("was").isNull(), "made").when(F.col("path").isNull(), "deleted").when(edited, "edited")
    both = new.join(before, F.col("path") == F.col("was"), "full").withColumn("change", kind)
    return both.filter("change is not null").select(F.coalesce("path", "was").alias("path"), "change")


def look(spark: SparkSession, root: str, state: str, **options: str) -> DataFrame:
    """CHANGES of ``root`` since the last look below ``state``; all its files at first. Only one looker at a time."""
    before = last_look(spark, state)
    number = before + 1
    now = f"{state}/listings/{number:012d}"
    workspace.listing(spark, root, **options).select("path", "modified", "size").write.mode("overwrite").parquet(now)
    new = spark.read.schema(LISTED).parquet(now)
    old = spark.read.schema(LISTED).parquet(f"{state}/listings/{before:012d}") if before else new.limit(0)
    found = difference(new, old).select(F.lit(root).alias("root"), F.current_timestamp().alias("ts"), "path", "change", F.lit(number).cast("long").alias("look"))
    own = f"{state}/changes/batch={number}"
    found.write.mode("overwrite").parquet(own)
    out = spark.read.schema(CHANGES).parquet(own)
    done = out.agg(F.count("*").alias("n_changes")).select(F.lit(number).cast("long").alias("look"), F.lit(root).alias("root"), F.current_timestamp().alias("ts"), "n_changes")
    done.coalesce(1).write.mode("append").parquet(f"{state}/looks")
    if number > KEPT:
        delete(spark, f"{state}/listings/{number - KEPT:012d}")
    return out


def since(spark: SparkSession, state: str, look_before: int) -> DataFrame:
    """CHANGES of all whole looks after ``look_before``."""
    last = last_look(spark, state)
    if not last:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(f"{state}/changes").select(*(c.split()[0] for c in CHANGES.split(", "))).filter(F.col("look").between(look_before + 1, last))


def watch(spark: SparkSession, root: str, state: str, every: str = "1 second", **options: str) -> DataStreamWriter:
    """A query that looks at ``root`` on every trigger; start it once for each state folder."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def one(_batch: DataFrame, _number: int) -> None:
        look(spark, root, state, **options)

    return ticks.writeStream.foreachBatch(one).trigger(processingTime=every)


def stream(spark: SparkSession, state: str) -> DataFrame:
    """CHANGES as a stream. The state folder must have been looked at once."""
    rows = spark.readStream.schema(CHANGES).parquet(f"{state}/changes")
    return rows.select(*(c.split()[0] for c in CHANGES.split(", ")))
