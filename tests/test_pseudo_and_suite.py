"""Pseudo-labels against plain Python, and variants judged on one subset."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import annotations, pseudo, suite

BOX = "x1 double, y1 double, x2 double, y2 double"
FRAMES = "split string, stem string, width int, height int"


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([("train", "rw_a", 100, 50), ("train", "rw_b", 100, 50), ("val", "rw_c", 100, 50), ("val", "co_d", 100, 50), ("val", "rw_e", 100, 50)], FRAMES)


def test_completion_clips_before_it_judges_the_size(spark, frames):
    found = spark.createDataFrame(
        [
            ("rw_a", 11, 0.9, -20.0, 10.0, 5.0, 30.0),  # 5 pixels are left
            ("rw_a", 11, 0.8, -20.0, 10.0, 30.0, 90.0),  # clipped on two sides
            ("rw_a", 11, 0.55, 0.0, 0.0, 20.0, 20.0),  # not over the score
            ("rw_b", 0, 0.99, 0.0, 0.0, 20.0, 20.0),  # another class
            ("rw_b", None, 0.99, 0.0, 0.0, 20.0, 20.0),
            ("rw_c", 11, 0.7, 0.0, 0.0, 5.0, 20.0),  # too narrow, but seen
            ("co_d", 11, 0.9, 0.0, 0.0, 20.0, 20.0),  # has labels of its own
            ("zz", 11, 0.9, 0.0, 0.0, 20.0, 20.0),  # no such frame
        ],
        f"stem string, class_id int, score double, {BOX}",
    )
    made = pseudo.complete(frames, found, 11, 2, "rw_")
    (row,) = made.labels.collect()
    assert (row.split, row.stem, row.cls, row.score) == ("train", "rw_a", 2, 0.8)
    assert (row.cx, row.cy, row.w, row.h) == pytest.approx((0.15, 29.5 / 50, 0.3, 39 / 50))
    stats = {r.split: r[1:] for r in made.statistics.collect()}
    assert stats == {"train": (2, 1, 1), "val": (2, 1, 0)}
    none = pseudo.complete(frames, found.limit(0), 11, 2, "rw_")
    assert none.labels.count() == 0 and {r.split: r[1:] for r in none.statistics.collect()} == {"train": (2, 0, 0), "val": (2, 0, 0)}
    assert pseudo.complete(frames.limit(0), found, 11, 2).statistics.count() == 0


def test_completion_twice_leaves_one_copy(spark, frames):
    found = spark.createDataFrame([("rw_a", 11, 0.8, 0.0, 0.0, 30.0, 30.0)], f"stem string, class_id int, score double, {BOX}")
    hand = spark.createDataFrame([("train", "rw_a", 0, *(0.5,) * 4, *(1.0, 1.0, 30.0, 30.0), "hand")], f"split string, stem string, cls int, cx double, cy double, w double, h double, {BOX}, provenance string")
    added = pseudo.complete(frames, found, 11, 2, "rw_").labels.withColumns({"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(30.0), "y2": F.lit(30.0)})
    once = annotations.append_pseudo_labels(hand, added)
    assert once.count() == annotations.append_pseudo_labels(once, added).count() == 2


def test_mining_takes_the_annotations_box(spark, frames):
    truths = spark.createDataFrame([("rw_a", 1, 10.0, 10.0, 30.0, 30.0), ("rw_a", 2, 60.0, 10.0, 90.0, 40.0), ("rw_b", 1, 0.0, 0.0, 20.0, 20.0), ("rw_c", 1, 90.0, 10.0, 130.0, 30.0)], f"stem string, truth_id int, {BOX}")
    found = spark.createDataFrame(
        [
            ("rw_a", 1, 11, 0.9, 11.0, 10.0, 31.0, 30.0), ("rw_a", 2, 11, 0.5, 12.0, 10.0, 32.0, 30.0),  # both agree with the first
            ("rw_a", 3, 11, 0.9, 40.0, 40.0, 50.0, 50.0), ("rw_a", 4, 0, 0.9, 60.0, 10.0, 90.0, 40.0),  # none; another class
            ("rw_c", 1, 11, 0.6, 92.0, 10.0, 130.0, 30.0), ("rw_e", 1, 11, 0.9, 0.0, 0.0, 9.0, 9.0),  # beyond the edge; a frame without a truth
        ],
        f"stem string, det_id int, class_id int, score double, {BOX}",
    )
    made = pseudo.mine(frames, found, truths, 11, 2)
    rows = sorted((r.stem, r.det_id, round(r.cx, 6), round(r.w, 6), r.score) for r in made.labels.collect())
    assert rows == [("rw_a", 1, 0.2, 0.2, 0.9), ("rw_a", 2, 0.2, 0.2, 0.5), ("rw_c", 1, 0.945, 0.09, 0.6)]
    assert tuple(made.statistics.first()) == (3, 3, 1, 25.0)
    assert tuple(pseudo.mine(frames, found.limit(0), truths, 11, 2).statistics.first()) == (3, 0, 0, 0.0)


def test_variants_share_a_subset_and_one_may_fail(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "cone", i, *(b := rng.uniform(0, 60, 2)), *(b + 20)) for i in range(40)]
    truths = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], f"image_id int, class_name string, gt_id int, {BOX}")
    images = truths.select("image_id")
    good = truths.select("image_id", "class_name", F.col("gt_id").alias("det_id"), F.lit(0.9).alias("score"), "x1", "y1", "x2", "y2")
    seen = []

    def right(chosen):
        seen.append(sorted(r.image_id for r in chosen.collect()))
        return good.join(chosen, "image_id", "left_semi")

    def half(chosen):
        return right(chosen).where("image_id % 8 = 0")

    def broken(chosen):
        raise OSError("no weights")

    made = suite.accuracies({"right": right, "half": half, "broken": broken, "late": lambda c: right(c).withColumn("x1", F.raise_error(F.lit("bad box")).cast("double"))}, images, truths, subset=10)
    acc = {r.variant: r for r in made.collect()}
    assert seen[0] == list(range(0, 40, 4)) and all(s == seen[0] for s in seen)
    assert acc["right"].map_50_95 == pytest.approx(1.0) and 0.45 < acc["half"].map_50 < 0.55
    assert acc["broken"].error == "OSError: no weights" and acc["broken"].map_50 is None and "bad box" in acc["late"].error
    assert {r.eval_images for r in acc.values()} == {10}
    timed = [(v, dev, n, ms + n) for v, dev, ms in (("right", "cpu", 20.0), ("half", "cpu", 10.0), ("half", "gpu", 2.0)) for n in (1, 2) for _ in range(5)]
    out = {(r.variant, r.device): r for r in suite.compared_variants(spark.createDataFrame(timed, "variant string, device string, number int, ms double"), made, "right").collect()}
    assert out["half", "cpu"].speedup == pytest.approx(12 / 22) and out["half", "gpu"].speedup is None and out["right", "cpu"].map_50_95 == acc["right"].map_50_95
    assert out["right", "cpu"].n == 5 and out["right", "cpu"].p50_ms == 22.0
