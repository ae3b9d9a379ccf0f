"""Tracks of streams: restarts, typed state and clips that end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import tracking
from kerbside.streaming import flows

SCHEMA = "clip string, frame int, n int, class_name string, x1 double, y1 double, x2 double, y2 double, distance_m double, ts timestamp"


def put(spark, rows, path) -> None:
    made = spark.createDataFrame([r[:9] + (r[9],) for r in rows], SCHEMA.replace("ts timestamp", "ts long"))
    made.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, seen: dict, idle_ms: int | None = None) -> None:
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    stream = stream if idle_ms is None else stream.withWatermark("ts", "1 second")
    made = flows.track_stream(stream, "clip", "frame", "n", time=None if idle_ms is None else "ts", idle_ms=idle_ms, max_misses=2)

    def keep(batch, number):
        for r in batch.collect():
            seen[r.clip, r.track_id] = r

    made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rng, rows = random.Random(1), []
    for f in range(24):
        for n in range(3):
            if rng.random() < 0.7:
                x = 100.0 * n + 3 * f
                rows.append(("a", f, n, "cone", x, 10.0, x + 40, 50.0, None if rng.random() < 0.2 else 30.0 - f, f))
        rows.append(("b", f, 9, "barrier", 5.0, 5.0, 60.0, 60.0, 10.0, f))
    seen: dict = {}
    for part in range(3):
        put(spark, [r for r in rows if r[1] // 8 == part], tmp_path / "in")
        run(spark, tmp_path, seen)
    flat = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long"))
    want = {(r.clip, r.track_id): r for r in tracking.track(flat, "clip", "frame", "n", max_misses=2).collect()}
    assert seen.keys() == want.keys()
    for k, r in want.items():
        assert (seen[k].hits, seen[k].misses, seen[k].evicted, seen[k].x1) == (r.hits, r.misses, r.evicted, r.x1)
        assert seen[k].range_rate == pytest.approx(r.range_rate)


def test_the_state_of_an_ended_clip_goes(spark, tmp_path):
    box = (10.0, 10.0, 50.0, 50.0, 5.0)
    seen: dict = {}
    put(spark, [("a", f, 0, "cone", *box, f) for f in range(1, 4)], tmp_path / "in")
    run(spark, tmp_path, seen, idle_ms=10_000)
    put(spark, [("b", 0, 0, "cone", *box, 100)], tmp_path / "in")
    run(spark, tmp_path, seen, idle_ms=10_000)
    put(spark, [("b", 1, 0, "cone", *box, 101)], tmp_path / "in")
    run(spark, tmp_path, seen, idle_ms=10_000)
    assert seen["a", 1].hits == 3 and seen["b", 1].hits == 2
    # the clip comes again: it starts anew, while b goes on
    put(spark, [("a", 7, 0, "cone", *box, 102), ("b", 2, 0, "cone", *box, 102)], tmp_path / "in")
    run(spark, tmp_path, seen, idle_ms=10_000)
    assert seen["a", 1].hits == 1 and seen["a", 1].age == 0 and seen["b", 1].hits == 3


def test_idle_needs_a_time(spark):
    with pytest.raises(ValueError):
        flows.track_stream(spark.createDataFrame([], SCHEMA), "clip", "frame", "n", idle_ms=5)
