"""Clips and index runs recovered from stems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.text import clip_parts
from kerbside.operators.scans import Ordered


def clip_frames(df: DataFrame, stem: str = "stem") -> DataFrame:
    """clip_key, frame_ms and stem of the stems that are clip frames."""
    made = df.select(F.col(stem).alias("stem"), clip_parts(F.col(stem)).alias("_c")).where("_c is not null")
    return made.select(F.concat_ws("/", "_c.city", "_c.video", "_c.seq").alias("clip_key"), F.col("_c.frame").alias("frame_ms"), "stem")


def clips(frames: DataFrame, least: int = 2) -> DataFrame:
    """Per clip its ordered stems and times, and their number; those with ``least`` frames."""
    made = frames.groupBy("clip_key").agg(F.array_sort(F.collect_list(F.struct("frame_ms", "stem"))).alias("_f"))
    return made.select(
        "clip_key", F.col("_f.stem").alias("stems"), F.col("_f.frame_ms").alias("frame_ids"), F.size("_f").alias("length")
    ).where(F.col("length") >= least)


def frame_intervals(frames: DataFrame, fps: float = 30.0, low: float = 0.005, high: float = 2.0) -> DataFrame:
    """Seconds between frames of each clip: the upper median of the positive steps, else 1/fps."""
    step = F.lead("frame_ms").over(Window.partitionBy("clip_key").orderBy("frame_ms", "stem")) - F.col("frame_ms")
    steps = frames.withColumn("_d", step)
    made = steps.groupBy("clip_key").agg(F.sort_array(F.collect_list(F.when(F.col("_d") > 0, F.col("_d")))).alias("_d"))
    middle = F.when(F.size("_d") > 0, F.get("_d", F.floor(F.size("_d") / 2).cast("int")) / 1000)
    return made.select("clip_key", F.when(middle.between(low, high), middle).otherwise(F.lit(1.0 / fps)).alias("interval_s"))


def load_clip(frames: DataFrame, clip_key: str, limit: int | None = None) -> DataFrame:
    rows = frames.where(F.col("clip_key") == clip_key).orderBy("frame_ms", "stem")
    return rows if limit is None else rows.limit(limit)


def segment_runs(df: DataFrame, prefix: str, idx: str, ties: Sequence[str] = (), max_gap: int = 10, max_run: int = 250) -> DataFrame:
    """Add ``island`` (from 0, a new one after a gap over ``max_gap``) and ``chunk`` (every ``max_run`` rows of an island).

    A prefix of any size is split over tasks (see ``scans``).
    """
    made = Ordered.of(df, [prefix], [idx, *ties]).running(lags={"_previous": F.col(idx)}, sums={"_n": F.lit(1)})
    made = made.with_columns({"_jump": F.when(F.col(idx) - F.col("_previous") > max_gap, 1).otherwise(0)})
    made = made.running(sums={"island": F.col("_jump")}, tops={"_start": F.when(F.col("_jump") == 1, F.col("_n")).otherwise(1)})
    place = F.col("_n") - F.col("_start")
    return made.done().withColumn("chunk", F.floor(place / F.lit(max_run)).cast("int")).drop("_jump", "_previous", "_n", "_start")


def embargo(df: DataFrame, segment: Sequence[str], idx: str, ties: Sequence[str] = (), tail: int = 8, longer_than: int = 16) -> DataFrame:
    """Add ``dropped``: the last ``tail`` rows of every segment of more than ``longer_than``."""
    one = F.lit(1)
    made = Ordered.of(df, segment, [idx, *ties]).running(sums={"_n": one}).running(sums={"_back": one}, back=True).done()
    return made.withColumn("dropped", (F.col("_n") + F.col("_back") - 1 > longer_than) & (F.col("_back") <= tail)).drop("_n", "_back")


def longest_first(made: DataFrame) -> DataFrame:
    """Clips with the most frames first, equals by key."""
    return made.orderBy(F.col("length").desc(), "clip_key")
