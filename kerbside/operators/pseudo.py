"""Boxes of a teacher model as labels: mining frames that have annotations, and completing frames that lack a class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import boxes
from kerbside.operators import annotations, matching


def teacher_boxes(detections: DataFrame, class_id: int, least_score: float) -> DataFrame:
    """The teacher's detections of one class over a score; a null class or score is none."""
    return detections.where((F.col("class_id") == class_id) & (F.col("score") > least_score))


@dataclass(frozen=True)
class Pseudo:
    """labels: split, stem, cls, cx, cy, w, h, score (mined ones det_id too); statistics: one row, or one per split."""

    labels: DataFrame
    statistics: DataFrame


def _normalised(df: DataFrame, cls: int, *more: str) -> DataFrame:
    norm = boxes.to_normalised(boxes.columns(), F.col("width"), F.col("height"))
    return df.select("split", "stem", F.lit(cls).alias("cls"), *[c.alias(n) for c, n in zip(norm, ("cx", "cy", "w", "h"), strict=True)], "score", *more)


def mine(frames: DataFrame, detections: DataFrame, truths: DataFrame, class_id: int, cls: int, least_score: float = 0.35, least_iou: float = 0.35, least_side: float = 2.0) -> Pseudo:
    """Labels where teacher and annotation agree, of the frames that have an annotation.

    frames: split, stem (once each), width, height; detections: stem, det_id,
    class_id, score, box; truths: stem, truth_id, box.  Every detection that
    agrees gives the annotation's box, drawn by hand, so two that agree with the same one give it
    twice; it is clipped to the frame and dropped under ``least_side``.
    Statistics: examined frames, kept and rejected detections, rejected_pct.
    """
    examined = frames.join(truths.select("stem").distinct(), "stem", "left_semi")
    seen = teacher_boxes(detections, class_id, least_score).join(examined.select("stem"), "stem", "left_semi")
    agreed = matching.agreement_join(seen, truths, "stem", "det_id", "truth_id", least_iou)
    scored = agreed.join(seen.select("stem", "det_id", "score"), ["stem", "det_id"])
    counted = matching.mining_statistics(seen, agreed, "stem").drop("examined").crossJoin(examined.agg(F.count("*").alias("examined")))  # one row each
    return Pseudo(_normalised(_inside(scored, examined, least_side), cls, "det_id"), counted.select("examined", "kept", "rejected", "rejected_pct"))


def complete(frames: DataFrame, detections: DataFrame, class_id: int, cls: int, prefix: str = "", least_score: float = 0.55, least_side: float = 6.0) -> Pseudo:
    """Labels of the teacher alone, for the frames whose stem starts with ``prefix``.

    frames: split, stem (once each), width, height; detections: stem, class_id,
    score, box.  Boxes are clipped to their frame before their size is judged.
    Statistics per split: images_scanned, images_modified (with a detection that
    is sure enough, whatever its size) and boxes_added.
    """
    scanned = frames.where(F.col("stem").startswith(prefix))
    seen = teacher_boxes(detections, class_id, least_score)
    added = _normalised(_inside(seen, scanned, least_side), cls)
    touched = scanned.join(seen.select("stem").distinct(), "stem", "left_semi").groupBy("split").agg(F.count("*").alias("images_modified"))
    of = scanned.groupBy("split").agg(F.count("*").alias("images_scanned"))
    made = of.join(touched, "split", "left").join(added.groupBy("split").agg(F.count("*").alias("boxes_added")), "split", "left")
    return Pseudo(added, made.select("split", "images_scanned", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("images_modified", "boxes_added")]))


def _inside(found: DataFrame, frames: DataFrame, least_side: float) -> DataFrame:
    """The boxes clipped to their frames, of those that are large enough then."""
    placed = found.join(frames.select("split", "stem", "width", "height"), "stem")
    box = boxes.clipped(boxes.columns(), F.col("width"), F.col("height"))
    return annotations.drop_small(placed.withColumns(dict(zip(boxes.EDGES, box, strict=True))), least_side)
