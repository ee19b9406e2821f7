"""Changes to a workspace: debounced reindexing, published versions, and the state of open buffers; batch and streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from graphloom.sources import changes, workspace
from graphloom.streaming import published as store
from graphloom.streaming.published import TABLES, published, rebuild, refresh, versions

__all__ = ["TABLES", "buffer_stream", "buffers", "bursts", "debounced", "follow", "latest", "notices", "published", "rebuild", "refresh", "reindex_live", "reindex_stream", "versions"]

#: Triggers closer than this are one burst, and make one reindex after the last.
DEBOUNCE = "300 milliseconds"
DEBOUNCE_MS = 300
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bursts(triggers: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """root, first, fires_at and n_events of each burst of ``triggers`` (root, ts).

    Works on streams too; give those a watermark on ts.
    """
    window = F.session_window("ts", gap)
    return triggers.groupBy("root", window).agg(F.count("*").alias("n_events")).select("root", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("fires_at"), "n_events")


def reindex_stream(triggers: DataFrame, rebuild: Callable[[list], None], gap: str = DEBOUNCE, late: str = "1 second") -> DataStreamWriter:
    """Calls ``rebuild`` with the roots whose bursts have ended by their own time, once for each micro-batch.

    A burst ends when a later trigger moves the watermark, so this is for recorded triggers, which are
    replayed; :func:`reindex_live` fires by the clock.
    """

    def batch(ended: DataFrame, _: int) -> None:
        roots = [r.root for r in ended.select("root").distinct().collect()]
        if roots:
            rebuild(roots)

    return bursts(triggers.withWatermark("ts", late), gap).writeStream.outputMode("append").foreachBatch(batch)


def _with_rocks(df: DataFrame) -> DataFrame:
    """Timers and lifetimes need the RocksDB state store, which keeps state on disk: set unless the session chose another."""
    conf = df.sparkSession.conf
    if "HDFSBackedStateStoreProvider" in conf.get(_PROVIDER, "HDFSBackedStateStoreProvider"):
        conf.set(_PROVIDER, _ROCKS)
    return df


class _Debounce(StatefulProcessor):
    """Each trigger puts the root's timer off; when it runs out the burst is told once, and nothing is left of it."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "n_events long, fires_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, fires_at = self.burst.get() if self.burst.exists() else (0, None)
        if fires_at is not None:
            self.handle.deleteTimer(fires_at)
        fires_at = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.handle.registerTimer(fires_at)
        self.burst.update((n + sum(1 for _ in rows), fires_at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, fires_at = self.burst.get()
        self.burst.clear()
        yield Row(root=key[0], n_events=n, fires_at=fires_at)

    def close(self) -> None:
        pass


def debounced(triggers: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """root, n_events and fires_at (milliseconds) of each burst of a stream of triggers (root), once it has been quiet for the gap.

    By the clock: the last burst fires without another trigger. Start the query with a processing-time trigger,
    which goes on without data.
    """
    rows = _with_rocks(triggers).select("root")
    return rows.groupBy("root").transformWithState(_Debounce(gap_ms), "root string, n_events long, fires_at long", "Update", "ProcessingTime")


def reindex_live(triggers: DataFrame, rebuild: Callable[[list], None], gap_ms: int = DEBOUNCE_MS, every: str = "100 milliseconds") -> DataStreamWriter:
    """Calls ``rebuild`` with the roots that have been quiet for the gap after their last trigger."""

    def batch(ended: DataFrame, _: int) -> None:
        roots = [r.root for r in ended.select("root").distinct().collect()]
        if roots:
            rebuild(roots)

    return debounced(triggers, gap_ms).writeStream.outputMode("update").foreachBatch(batch).trigger(processingTime=every)


def follow(spark: SparkSession, root: str, state: str, out: str, gap_ms: int = DEBOUNCE_MS, every: str = "100 milliseconds") -> DataStreamWriter:
    """Keeps the index below ``out`` up to date with the folder ``root``, whose changes :func:`changes.watch` writes below ``state``.

    Each burst refreshes what changed since the published version; the first builds the whole.
    """

    def batch(_roots: list) -> None:
        last = changes.last_look(spark, state)
        known = store.last(spark, out)
        files = workspace.read(spark, root)
        if known is None:
            rebuild(files, out, through=last)
            return
        touched = changes.since(spark, state, known.through).select("path").distinct()
        if not touched.isEmpty():
            refresh(files, touched, out, through=last)

    return reindex_live(changes.stream(spark, state), batch, gap_ms, every)


def notices(spark: SparkSession, out: str) -> DataFrame:
    """A stream for clients: a row (version, node_count, edge_count, ...) whenever a version is published below ``out``."""
    return spark.readStream.schema(store.SAID).parquet(f"{out}/versions")


def latest(versions: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key with the largest ``order``."""
    row = F.struct(*versions.columns)
    return versions.groupBy(key).agg(F.max_by(row, order).alias("row")).select("row.*")


def buffers(changes: DataFrame) -> DataFrame:
    """Open buffers after ``changes`` (uri, seq, action, text): the last change wins, closing removes."""
    return latest(changes, "uri", F.col("seq")).filter("action <> 'close'").select("uri", "seq", "text")


class _Buffers(StatefulProcessor):
    """The last change of a buffer wins, whenever it arrives. An open buffer's text is kept; of a closed
    one its last number is, for a time if one is given, so that late changes do not open it again."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "seq long, text string")
        self.closed = handle.getValueState("closed", "seq long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was_open, was_closed = self.open.exists(), self.closed.exists()
        seq, text = self.open.get() if was_open else (self.closed.get()[0] if was_closed else -1, None)
        is_open, before = was_open, seq
        for row in sorted(rows, key=lambda r: r.seq):
            if row.seq >= seq:
                seq, is_open = row.seq, row.action != "close"
                text = row.text if is_open else None
        if is_open:
            self.open.update((seq, text))
            if was_closed:
                self.closed.clear()
        elif seq > before or was_open or not was_closed:
            self.closed.update((seq,))
            if was_open:
                self.open.clear()
        yield Row(uri=key[0], seq=seq, text=text, open=is_open)

    def close(self) -> None:
        pass


#: How long a live stream should keep a closed buffer's last number.
KEEP_CLOSED_MS = 3_600_000


def buffer_stream(changes: DataFrame, keep_closed_ms: int | None = None) -> DataFrame:
    """The state of each buffer that a micro-batch of ``changes`` touches: uri, seq, text, open.

    With ``keep_closed_ms`` nothing is left of a buffer once it has been closed for so long, and a change that
    comes later than that opens it anew: for live streams, with a processing-time trigger, as lifetimes go by the
    clock. Without it the number of a closed one stays, and a stream of recorded changes ends with them.
    """
    rows = _with_rocks(changes).select("uri", F.col("seq").cast("long").alias("seq"), "action", "text")
    return rows.groupBy("uri").transformWithState(_Buffers(keep_closed_ms), "uri string, seq long, text string, open boolean", "Update", "None" if keep_closed_ms is None else "ProcessingTime")
