"""Structured Streaming forms of the operators.

Event time and a watermark decide what is late. Rows inside the watermark are merged into the right
block; older ones are dropped by the stateful operator and counted (:class:`LateRows`).
"""

from __future__ import annotations

import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from dayweave.functions.text import canonical_activity
from dayweave.operators.search import StoredIndex, change_index, load_index
from dayweave.session import ensure_checkpoint_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_rows(
    spark: SparkSession, path: str, schema: T.StructType, event_time: str, delay: str = "10 minutes", *, glob: str | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet rows arriving in a folder, with a watermark; the intake per trigger is bounded.

    ``glob`` names files of the folder or folders in it, whose files are then read.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(f"{path.rstrip('/')}/{glob}" if glob else path)
    return rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def flush(stream: DataFrame, *, path: str | None = None) -> DataFrame:
    """Consume everything available, append it to a parquet table and return the table.

    A later call with the same path continues after the rows already consumed.
    """
    spark = stream.sparkSession
    target = path or _folder(spark)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{target}/data").option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


def flush_updates(stream: DataFrame, merge: Callable[[DataFrame, int], None], *, path: str | None = None) -> None:
    """Consume everything available in update mode, handing each batch to ``merge``."""
    target = path or _folder(stream.sparkSession)
    writer = stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start().awaitTermination()


class LateRows(StreamingQueryListener):
    """Counts the rows every query dropped because they were older than the watermark, from its first batch on.

    A query itself keeps only its newest progress reports, so the count is added up as they arrive.
    """

    def __init__(self) -> None:
        self.by_query: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.by_query[str(event.progress.id)] += sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch_late_rows(spark: SparkSession) -> LateRows:
    """Start counting late rows of all queries of the session."""
    watch = LateRows()
    spark.streams.addListener(watch)
    return watch


def late_rows(query, watch: LateRows) -> int:
    """Rows a query dropped since ``watch`` began, its restarts included."""
    return watch.by_query[str(query.id)]


def closed_blocks(obs: DataFrame, gap: str = "60 seconds", keys: tuple[str, ...] = ("recording_id",), event_time: str = "at") -> DataFrame:
    """Gap blocks that can no longer grow, emitted once the watermark has passed them."""
    return (
        obs.groupBy(*keys, F.session_window(event_time, gap).alias("w"))
        .agg(F.min(event_time).alias("from_at"), F.max(event_time).alias("to_at"), F.count("*").alias("observation_count"))
        .drop("w")
    )


class _OpenBlock(StatefulProcessor):
    """The blocks of a key that rows inside the watermark can still change, and its latest block."""

    def __init__(self, gap: float, idle: float):
        self.gap, self.idle = gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getValueState("blocks", "from_ts array<double>, to_ts array<double>, n array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(zip(*self.blocks.get())) if self.blocks.exists() else []
        before = dict((b[0], b) for b in known)
        blocks = list(known)
        for ts in sorted(x for pdf in rows for x in pdf["timestamp"].tolist()):
            near = [b for b in blocks if b[0] - self.gap <= ts <= b[1] + self.gap]
            whole = (min([ts, *(b[0] for b in near)]), max([ts, *(b[1] for b in near)]), 1 + sum(b[2] for b in near))
            blocks = [b for b in blocks if b not in near] + [whole]
        blocks.sort()
        now = dict((b[0], b) for b in blocks)
        latest = blocks[-1][0]
        out = [(key[0], start, None, 0, False) for start in before if start not in now]
        was_latest = known[-1][0] if known else None
        for start, end, n in blocks:
            if before.get(start) != (start, end, n) or (start == was_latest) != (start == latest):
                out.append((key[0], start, end, n, start == latest))
        # Blocks that no row inside the watermark can reach any more are done, but for the latest.
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        kept = [b for b in blocks if b[1] + self.gap >= passed or b[0] == latest]
        self.blocks.update(tuple(list(x) for x in zip(*kept)))
        self.handle.registerTimer(int((blocks[-1][1] + self.idle) * 1000))
        yield pd.DataFrame(out, columns=["recording_id", "from_ts", "to_ts", "observation_count", "is_open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        if self.blocks.exists() and max(self.blocks.get()[1]) + self.idle <= passed:
            self.blocks.clear()
        yield pd.DataFrame([], columns=["recording_id", "from_ts", "to_ts", "observation_count", "is_open"])

    def close(self) -> None:
        pass


def open_blocks(obs: DataFrame, gap: float = 60.0, *, event_time: str = "at", idle: float = 30 * 86400.0) -> DataFrame:
    """Every change of the blocks per recording; a block is named by recording and start.

    A row inside the watermark of ``event_time`` reaches the block it belongs to, also one that is no longer
    the latest; where it moves a start or joins two blocks, the former name is reported once more with a
    count of zero. Older rows are dropped and counted (:class:`LateRows`). ``is_open`` marks the latest
    block. A recording without rows for ``idle`` seconds of event time leaves the state. Needs the RocksDB
    state store (see :func:`use_keyed_state`).
    """
    kind = obs.schema["recording_id"].dataType.simpleString()
    schema = f"recording_id {kind}, from_ts double, to_ts double, observation_count bigint, is_open boolean"
    return obs.select("recording_id", "timestamp", event_time).groupBy("recording_id").transformWithStateInPandas(
        _OpenBlock(gap, idle), schema, outputMode="Update", timeMode="EventTime"
    )


class _CaptureGuard(StatefulProcessor):
    """Near-duplicate drop and churn throttle of one display, in time order.

    Rows wait until the watermark has passed them, when nothing earlier can come any more.
    """

    COLUMNS = ["display_id", "id", "timestamp", "phash"]

    def __init__(self, kind: str, threshold: int, window: float, limit: int, interval: float, idle: float):
        self.kind, self.idle = kind, idle
        self.rule = threshold, window, limit, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"timestamp double, id {self.kind}, phash bigint")
        self.last = handle.getValueState("last", "seen bigint, kept bigint, held_at double, changes array<double>, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [r for pdf in rows for r in zip(pdf["timestamp"].tolist(), pdf["id"].tolist(), pdf["phash"].tolist())]
        self.waiting.appendList(arrived)
        # Once the watermark passes the first of them; that call sets the next timer.
        self.handle.registerTimer(_milliseconds(min(arrived)[0]))
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if _milliseconds(r[0]) <= passed]
        left = rows[len(ready) :]
        out = self._released(ready, key) if ready else []
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(_milliseconds(left[0][0]))
        elif self.last.exists():
            end = _milliseconds(self.last.get()[4] + self.idle)
            if end <= passed:
                self.last.clear()
            elif ready:
                self.handle.registerTimer(end)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def _released(self, rows: list[tuple], key) -> list[tuple]:
        threshold, window, limit, interval = self.rule
        state = self.last.get() if self.last.exists() else (None, None, None, [], None)
        seen, kept, held_at, changes = state[0], state[1], state[2], deque(state[3])
        apart = lambda a, b: ((int(a) ^ int(b)) & 0xFFFFFFFFFFFFFFFF).bit_count()
        out = []
        for ts, frame, phash in rows:
            if seen is not None and apart(phash, seen) > threshold:
                changes.append(ts)
            seen = phash
            # Times rise, so those out of the window are the first ones.
            while changes and ts - changes[0] > window:
                changes.popleft()
            throttled = len(changes) > limit
            if not throttled:
                held_at = None
            if kept is not None and apart(phash, kept) <= threshold:
                continue
            if throttled:
                if held_at is not None and ts - held_at < interval:
                    continue
                held_at = ts
            kept = phash
            out.append((key[0], frame, ts, phash))
        self.last.update((seen, kept, held_at, list(changes), rows[-1][0]))
        return out

    def close(self) -> None:
        pass


def _milliseconds(seconds: float) -> int:
    """The first whole millisecond not before a time."""
    return -int(-seconds * 1000 // 1)


def capture_guard(
    frames: DataFrame, threshold: int = 4, window: float = 60.0, limit: int = 40, interval: float = 30.0, *, event_time: str = "at", idle: float = 30 * 86400.0
) -> DataFrame:
    """Kept frames per display; the batch form is ``operators.frames.throttle``.

    Frames may come out of order inside the watermark of ``event_time``: each waits until the watermark has
    passed it, then all that are ready go through in time order. Older ones are dropped and counted
    (:class:`LateRows`). A display without frames for ``idle`` seconds of event time leaves the state; its
    next frame is a first one. Needs the RocksDB state store (see :func:`use_keyed_state`).
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"display_id {kinds['display_id']}, id {kinds['id']}, timestamp double, phash bigint"
    return frames.select("display_id", "id", "timestamp", "phash", event_time).groupBy("display_id").transformWithStateInPandas(
        _CaptureGuard(kinds["id"], threshold, window, limit, interval, idle), schema, outputMode="Append", timeMode="EventTime"
    )


def use_keyed_state(spark: SparkSession) -> None:
    """State store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def fold_runs(starts: DataFrame, ends: DataFrame, longest: str = "1 day") -> DataFrame:
    """Run rows from start and end events; a run without an end within ``longest`` is unfinished."""
    done = ends.select(F.col("run_id").alias("end_id"), F.col("at").alias("completed_at"), "status", "duration_ms")
    within = F.expr(f"end_id = run_id AND completed_at >= started_at AND completed_at <= started_at + INTERVAL {longest}")
    begun = starts.select("run_id", F.col("at").alias("started_at"))
    joined = begun.join(done, within, "leftOuter")
    return joined.select("run_id", "started_at", "completed_at", F.coalesce("status", F.lit("running")).alias("status"), "duration_ms")


def unique_observations(obs: DataFrame, key: tuple[str, ...] = ("recording_id", "type", "at", "audio_source")) -> DataFrame:
    """First row of every key inside the watermark."""
    return obs.dropDuplicatesWithinWatermark(list(key))


def activity_digest(obs: DataFrame, size: str = "1 hour", slide: str | None = None, event_time: str = "at") -> DataFrame:
    """Observations per window and canonical activity."""
    windowed = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    activity = canonical_activity(F.coalesce("activity_type", F.lit("other"))).alias("activity")
    counts = obs.groupBy(windowed.alias("w"), activity).agg(F.count("*").alias("observations"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "activity", "observations")


def app_digest(obs: DataFrame, size: str = "1 hour", slide: str | None = None, event_time: str = "at") -> DataFrame:
    """Observations per window and application; an application counts once per observation."""
    windowed = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    shown = obs.select(event_time, F.explode(F.array_distinct("apps")).alias("app")).where("app is not null")
    counts = shown.groupBy(windowed.alias("w"), "app").agg(F.count("*").alias("observations"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "app", "observations")


def index_batches(docs: DataFrame, path: str, *, stems: bool = True) -> None:
    """Keep a search index in step with a stream of changed documents.

    Every batch adds a run to the index, which merges runs of similar size. A repeated batch changes nothing.
    Of a document's rows in a batch the last by ``at`` counts; a null text removes it, an empty one does not.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by(F.struct("text"), "at").alias("last")).select("doc_id", "last.text").persist()
        try:
            change_index(load_index(batch.sparkSession, path), latest.where("text is not null"), latest.where("text is null"), stems=stems, batch=batch_id)
        finally:
            latest.unpersist()

    writer = docs.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """Current content of an index written by :func:`index_batches`."""
    return load_index(spark, path)
