"""Pairing of boxes: overlap joins, agreement, suppression, points in boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import boxes
from kerbside.operators.runs import map_run_batches


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], floor: float | None = None) -> DataFrame:
    """Pairs of the same keys with their ``iou``; columns of ``b`` get the prefix ``b_``.

    An equi-join, so never a product over frames.  With ``floor`` only pairs
    with at least that overlap, otherwise all pairs of a frame.
    """
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    on = [F.col(k) == F.col(f"b_{k}") for k in keys]
    pairs = a.join(right, on).withColumn("iou", boxes.iou(boxes.columns(), boxes.columns("b_")))
    return pairs if floor is None else pairs.where(F.col("iou") >= floor)


def agreement_join(detections: DataFrame, truths: DataFrame, frame: str, det_id: str, truth_id: str, least: float = 0.35) -> DataFrame:
    """Detections with the truth box they overlap most, if by ``least``; the first of equals.

    Returns frame, det_id, truth_id, iou and the truth's box.  Two detections
    may take the same truth.  A partial aggregate keeps the best per detection.
    """
    best = overlap_pairs(detections, truths, [frame]).groupBy(frame, det_id).agg(
        F.max(F.struct(F.col("iou"), (-F.col(f"b_{truth_id}")).alias("_first"), *[F.col(f"b_{e}") for e in boxes.EDGES])).alias("_m")
    )
    return best.where(F.col("_m.iou") >= least).select(
        frame, det_id, (-F.col("_m._first")).alias(truth_id), F.col("_m.iou").alias("iou"), *[F.col(f"_m.b_{e}").alias(e) for e in boxes.EDGES]
    )


def mining_statistics(detections: DataFrame, kept: DataFrame, frame: str) -> DataFrame:
    """One row: examined frames, kept and rejected detections, percentage rejected."""
    n = detections.agg(F.count_distinct(frame).alias("examined"), F.count("*").alias("_all"))
    k = kept.agg(F.count("*").alias("kept"))
    return n.join(k).select(
        "examined", "kept", (F.col("_all") - F.col("kept")).alias("rejected"),
        F.when(F.col("_all") > 0, 100 * (F.col("_all") - F.col("kept")) / F.col("_all")).otherwise(F.lit(0.0)).alias("rejected_pct"),
    )


def suppress(df: DataFrame, frame: str, order: str, iou: float = 0.45, per_class: str | None = None, wide: int = 64) -> DataFrame:
    """Greedy non-maximum suppression within each frame; the rows that stay.

    Boxes go by score, then ``order``; one that overlaps a kept one by more than
    ``iou`` goes.  ``per_class`` limits it to boxes of that column's value.
    Overlaps of the boxes of many frames are found at once; the greedy choice goes by rank
    for all of those frames together, in frames of more than ``wide`` boxes box by box.
    """
    def one(box, size):
        import numpy as np

        left, keep = np.ones(len(box), bool), np.zeros(len(box), bool)
        for i in range(len(box)):
            if left[i]:
                keep[i] = True
                left &= ~over(box, box[i], size, size[i])
        return keep

    def over(a, b, size_a, size_b):
        import numpy as np

        span = np.minimum(a[:, 2:], b[..., 2:]) - np.maximum(a[:, :2], b[..., :2])
        both = np.clip(span[:, 0], 0, None) * np.clip(span[:, 1], 0, None)
        return both > iou * np.maximum(size_a + size_b - both, 1e-12)

    def run(rows, starts):
        import numpy as np

        b = np.stack([rows[e].astype(float) for e in boxes.EDGES], 1)
        size, n = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), len(b)
        many = np.diff(np.append(starts, n))
        keep, rank = np.ones(n, bool), np.arange(n) - np.repeat(starts, many)
        for k in np.flatnonzero(many > wide):
            at = slice(starts[k], starts[k] + many[k])
            keep[at] = one(b[at], size[at])
        behind = np.where(np.repeat(many <= wide, many), np.repeat(many, many) - rank - 1, 0)  # boxes of the frame that come later
        i = np.repeat(np.arange(n), behind)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
        close = over(b[j], b[i], size[j], size[i])
        i, j = i[close], j[close]
        order = np.argsort(rank[i], kind="stable")
        i, j = i[order], j[order]
        for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(rank[i])) + 1):
            keep[j[some][keep[i[some]]]] = False
        return {c: v[keep] for c, v in rows.items()}

    keys = [frame] + ([per_class] if per_class else [])
    return map_run_batches(df, keys, [F.col("score").desc(), order], run, df.schema)


def decode_head(df: DataFrame, frame: str, conf: float = 0.25, iou: float = 0.45, side: int = 640) -> DataFrame:
    """Anchors (frame, anchor, width, height, cx, cy, w, h, scores) to detections in image pixels.

    Confidence first, then class-agnostic suppression, then the letterbox is undone.
    """
    from kerbside.operators.annotations import above_confidence

    some = above_confidence(df, F.col("scores"), conf)
    x1, y1 = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
    some = some.withColumns({"x1": x1, "y1": y1, "x2": x1 + F.col("w"), "y2": y1 + F.col("h")})
    kept = suppress(some, frame, "anchor", iou)
    r, left, top = boxes.letterbox(F.col("width"), F.col("height"), side)
    back = boxes.undo_letterbox(boxes.columns(), r, left, top, F.col("width"), F.col("height"))
    return kept.withColumns(dict(zip(boxes.EDGES, [b.cast("float") for b in back], strict=True)))


def points_in_boxes(points: DataFrame, boxes_: DataFrame, frame: str, box_id: str, value: str, least: int = 3) -> DataFrame:
    """Per box the number and the median of the values of the points (frame, u, v) inside it, if there are ``least``."""
    p = points.select(F.col(frame).alias("_f"), "u", "v", value)
    inside = (F.col(frame) == F.col("_f")) & F.col("u").between(F.col("x1"), F.col("x2")) & F.col("v").between(F.col("y1"), F.col("y2"))
    return (
        boxes_.join(p, inside)
        .groupBy(frame, box_id)
        .agg(F.count("*").alias("n_points"), F.median(value).alias("median_value"))
        .where(F.col("n_points") >= least)
    )


def ratio_test(pairs: DataFrame, query: str, other: str, distance: str, ratio: float = 0.75) -> DataFrame:
    """The nearest match of each query, where it is clearly nearer than the second: d1 < ratio * d2."""
    order = Window.partitionBy(query).orderBy(distance, other)
    ranked = pairs.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    return (
        ranked.groupBy(query)
        .agg(
            F.max(F.when(F.col("_n") == 1, F.col(other))).alias(other),
            F.max(F.when(F.col("_n") == 1, F.col(distance))).alias("d1"),
            F.max(F.when(F.col("_n") == 2, F.col(distance))).alias("d2"),
        )
        .where(F.col("d1") < ratio * F.col("d2"))
    )
