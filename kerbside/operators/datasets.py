"""Whole jobs over the operators: conversion, re-split, leakage check, robustness sweep."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import boxes
from kerbside.functions.hashing import fraction
from kerbside.functions.text import audit_key, clip_parts, group_key, run_parts
from kerbside.operators import annotations, evaluation, graph, pixels, sequences, splits
from kerbside.storage import cut


@dataclass(frozen=True)
class Dataset:
    """images: split, stem, new_width, new_height; labels: split, stem, line_no, cls, cx, cy, w, h; counts per split and class."""

    images: DataFrame
    labels: DataFrame
    counts: DataFrame


def convert(
    images: DataFrame, found: DataFrame, mapping: Mapping[str, str], classes: Sequence[str], max_side: int = 1280, least: float = 6.0, least_after: float = 2.0,
    aliases: Mapping[str, str] | None = None, keep_negatives: bool = True,
) -> Dataset:
    """A training set from a source's images (image_id, split, stem, width, height) and annotations (image_id, category, box, iscrowd).

    Crowds, categories without a class, and boxes under ``least`` pixels go;
    the rest shrinks with its image and is clipped to it, and boxes under
    ``least_after`` then go too.  Images without a box stay if ``keep_negatives``.
    """
    rows = annotations.drop_crowds(found)
    if aliases:
        rows = annotations.fold_aliases(rows, aliases, list(mapping), "category")
    rows = annotations.drop_small(annotations.map_categories(rows, mapping), least)
    sized = rows.join(images.select("image_id", "split", "stem", "width", "height"), "image_id")
    fitted = annotations.fit_to_side(sized, F.col("width"), F.col("height"), max_side, least_after)
    number = {name: i for i, name in enumerate(classes)}
    table = images.sparkSession.createDataFrame(list(number.items()), "class_name string, cls int")
    fitted = fitted.join(F.broadcast(table), "class_name")
    norm = boxes.to_normalised(boxes.columns(), F.col("new_width"), F.col("new_height"))
    labels = fitted.select("image_id", "split", "stem", "class_name", "cls", *[c.alias(n) for c, n in zip(norm, ("cx", "cy", "w", "h"), strict=True)])
    labels = annotations.numbered(labels, "line_no", ["cls", "cx", "cy", "w", "h"], ["image_id"])
    shrink = boxes.shrink_factor(F.col("width"), F.col("height"), max_side)
    side = lambda c: F.when(shrink < 1, F.bround(F.col(c) * shrink, 0)).otherwise(F.col(c)).cast("int")
    kept = images if keep_negatives else images.join(labels, "image_id", "left_semi")
    kept = kept.select("image_id", "split", "stem", side("width").alias("new_width"), side("height").alias("new_height"))
    return Dataset(kept.drop("image_id"), labels.drop("image_id", "class_name"), annotations.class_counts(kept, labels.select("image_id", "class_name"), "image_id", "split", "class_name"))


@dataclass(frozen=True)
class Resplit:
    """assignment: stem, source, grp, split; dropped: stems under embargo; summary per source."""

    assignment: DataFrame
    dropped: DataFrame
    summary: DataFrame


def resplit(frames: DataFrame, share: float = 0.27, seed: int = 0, code: str | None = None, within: int = 3) -> Resplit:
    """Split frames (stem and, under ``code``, an image hash) so that no group is in both parts.

    A clip is a group; numbered frames of one prefix are cut into runs, whose
    tails are dropped; anything else is a group by its stem.  Groups that hold
    near-duplicates (hashes ``within`` bits) merge, and groups go to val in a
    seeded order until a source's share is reached.
    """
    parsed = frames.select("stem", group_key(F.col("stem")).alias("_g"), run_parts(F.col("stem")).alias("_r"), clip_parts(F.col("stem")).isNotNull().alias("_clip"))
    # kept, as each frame's patterns are costly and every step below reads them, some more than once
    parsed = cut(parsed.select("stem", "_g.source", "_g.grp", "_r.prefix", "_r.idx", "_clip"))
    numbered = F.col("idx").isNotNull() & ~F.col("_clip")
    tails = sequences.segment_runs(parsed.where(numbered), "prefix", "idx", ["stem"])
    tails = sequences.embargo(cut(tails), ["prefix", "island", "chunk"], "idx", ["stem"])
    dropped = tails.where("dropped").select("stem")
    runs = tails.where("not dropped").select("stem", "source", F.concat_ws("/", "prefix", F.col("island").cast("string"), F.col("chunk").cast("string")).alias("grp"))
    members = parsed.where(~numbered).select("stem", "source", "grp").unionByName(runs)
    if code is not None:
        labels = graph.components(graph.band_pairs(frames, "stem", code, within=within))
        members = graph.merge_groups(members, labels, "stem", ["source", "grp"])
    members = cut(members)
    groups = members.groupBy("source", "grp").agg(F.count("*").alias("n"))
    filled = splits.greedy_fill(groups, "source", fraction(F.concat_ws("/", "source", "grp"), seed), "n", share, ["grp"])
    return Resplit(members.join(filled.select("source", "grp", "split"), ["source", "grp"]), dropped, splits.split_summary(filled, "source", "n"))


def leakage_check(frames: DataFrame, code: str | None = None, within: int = 3) -> DataFrame:
    """One row on frames (stem, split and, under ``code``, an image hash): duplicate_stems, shared groups, affected val
    frames and their percentage, near_pairs between the splits, and ``leaked``: whether there is any of these."""
    named = frames.withColumn("_group", audit_key(F.col("stem")))
    stems = splits.last_split_wins(frames).agg(F.count_if("duplicated").alias("duplicate_stems"))
    row = stems.crossJoin(splits.affected(named, "_group"))  # one row each
    if code is None:
        near = frames.sparkSession.createDataFrame([(0,)], "near_pairs bigint")
    else:
        pairs = graph.band_pairs(frames, "stem", code, within=within)
        of = frames.select("stem", "split").distinct()
        both = pairs.join(of.toDF("a", "_sa"), "a").join(of.toDF("b", "_sb"), "b")
        near = both.agg(F.count_if(F.col("_sa") != F.col("_sb")).alias("near_pairs"))
    row = row.crossJoin(near)
    return row.withColumn("leaked", (F.col("duplicate_stems") > 0) | (F.col("shared") > 0) | (F.col("near_pairs") > 0))


def robustness(images: DataFrame, truths: DataFrame, detect: Callable[[DataFrame], DataFrame], conditions: Mapping[str, Sequence[int]], metric: str = "map_50_95", seed: int = 0) -> DataFrame:
    """(condition, severity, metrics, retained) of a detector on clean and corrupted images (image_id, height, width, data).

    ``detect`` takes the images with their pixels changed and returns detections.
    ``retained`` is the share of the clean metric that is left, best first; the clean row has 1.
    """
    rows = None
    for name, level in [("clean", 0), *((n, s) for n, levels in conditions.items() for s in levels)]:
        seen = images if name == "clean" else images.withColumn("data", pixels.corrupted(F.col("height"), F.col("width"), F.col("data"), name, level, seed))
        scores = evaluation.summary(evaluation.average_precision(detect(seen), truths))
        scores = scores.select(F.lit(name).alias("condition"), F.lit(level).alias("severity"), "*")
        rows = scores if rows is None else rows.unionByName(scores)
    clean = rows.where("condition = 'clean'").select(F.col(metric).alias("_clean"))
    made = rows.crossJoin(clean)  # one row
    share = F.when(F.col("_clean") > 0, F.col(metric) / F.col("_clean")).otherwise(F.lit(0.0))
    return made.withColumn("retained", F.when(F.col("condition") == "clean", F.lit(1.0)).otherwise(share)).drop("_clean").orderBy(F.col("retained").desc(), "condition", "severity")
