"""Event-time windows, sessions and tracking over streams; batch frames work alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kerbside.operators.tracking import STATE, TRACKS, Tracks, frame_arrays


def with_event_time(df: DataFrame, column: str, late: str | None = None) -> DataFrame:
    """The column as a timestamp with zone, which watermarks need, and the watermark on streams."""
    made = df.withColumn(column, F.col(column).cast("timestamp"))
    return made.withWatermark(column, late) if late and df.isStreaming else made


def windowed_counts(df: DataFrame, time: str, keys: list[str], value: str, length: str, slide: str | None = None) -> DataFrame:
    """Count and sum per window and key; with ``slide`` windows overlap."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    made = df.groupBy(span.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return made.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    made = df.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return made.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *keys, "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; on a stream within the watermark, so that state stays bounded."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


class ClipTracker(StatefulProcessor):
    """The tracks of one clip: a row of typed state per live track, one for the clip, and a timer at the clip's end."""

    def __init__(self, clip: str, frame: str, order: str, time: str | None, idle_ms: int | None, dt: float, options: dict):
        self.clip, self.frame, self.order, self.time, self.idle_ms, self.dt, self.options = clip, frame, order, time, idle_ms, dt, options

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clip", "frames bigint, next_id bigint, last_ms bigint")
        self.live = handle.getMapState("tracks", "track_id bigint", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values([self.frame, self.order], kind="stable")
        frames, next_id, last_ms = self.clock.get() if self.clock.exists() else (0, 1, -1)
        before = {k[0]: tuple(v) for k, v in self.live.iterator()}
        tracks = Tracks(**self.options).restore(next_id, before)
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for lines in np.split(np.arange(len(pdf)), np.flatnonzero(columns[self.frame][1:] != columns[self.frame][:-1]) + 1):
            tracks.advance(*frame_arrays(columns, lines), frames * self.dt)
            frames += 1
        made = pd.DataFrame(tracks.columns())
        made.insert(0, self.clip, key[0])
        tracks.drop_evicted()
        after = tracks.rows()
        for gone in before.keys() - after.keys():
            self.live.removeKey((gone,))
        for k, row in after.items():
            self.live.updateValue((k,), row)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            last_ms = max(last_ms, int(pd.Timestamp(pdf[self.time].max()).timestamp() * 1000))
            self.handle.registerTimer(last_ms + self.idle_ms)
        self.clock.update((frames, tracks.next_id, last_ms))
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.clock.clear()
        self.live.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_stream(df: DataFrame, clip: str, frame: str, order: str, dt: float = 1.0, time: str | None = None, idle_ms: int | None = None, **options) -> DataFrame:
    """Tracks after each micro-batch: every live or just evicted track of the clips in it, in update mode.

    A clip's frames must come in order over the batches; a batch may hold
    several.  The state of a clip is a row per live track and its counters, so a
    batch writes what it changed.  With ``idle_ms`` and an event ``time`` (with a watermark) the state of a clip
    goes when the watermark is that far behind its last frame; without, it stays.
    Needs the RocksDB state store.
    """
    if (time is None) != (idle_ms is None):
        raise ValueError("an idle time needs the column of the event time, and the other way round")
    key_type = dict(df.dtypes)[clip]
    processor = ClipTracker(clip, frame, order, time, idle_ms, dt, options)
    return df.groupBy(clip).transformWithStateInPandas(processor, f"`{clip}` {key_type}, {TRACKS}", "Update", "None" if time is None else "EventTime")


def each_batch(stream: DataFrame, on_frame: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run a callback over every micro-batch; the checkpoint makes it resume after the last one done."""
    writer = stream.writeStream.foreachBatch(on_frame).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
