"""Model variants side by side: timings, speed against a baseline, and accuracy on one subset of images."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import evaluation, splits, statistics
from kerbside.storage import cut

METRICS = ("map_50_95", "map_50", "map_small", "map_large")
ACCURACY = f"variant string, {', '.join(f'{m} double' for m in METRICS)}, eval_images bigint, error string"


def accuracies(variants: Mapping[str, Callable[[DataFrame], DataFrame]], images: DataFrame, truths: DataFrame, image: str = "image_id", subset: int = 500) -> DataFrame:
    """Per variant the metrics on ``subset`` images evenly strided in their order, or the error that stopped it.

    ``variants`` names functions from images to detections.  Images and truths of
    the subset are written once and serve all variants, so that they are judged alike; one that
    fails leaves the others be.  A variant is a job of its own, as models are
    few; its boxes are matched by image on the executors.
    """
    chosen = cut(splits.stride_sample(images, [image], subset))
    known = cut(truths.join(chosen.select(image), image, "left_semi"))
    count = chosen.count()
    rows = []
    for name, detect in variants.items():
        try:
            made = evaluation.summary(evaluation.average_precision(detect(chosen), known, image)).first()
            rows.append((name, *[made[m] for m in METRICS], count, None))
        except Exception as stopped:  # noqa: BLE001 - it is what the row tells
            rows.append((name, *[None for _ in METRICS], count, f"{type(stopped).__name__}: {stopped}"[:200]))
    return images.sparkSession.createDataFrame(rows, ACCURACY)


def compared_variants(timings: DataFrame, accuracy: DataFrame, baseline: str, ms: str = "ms", number: str = "number", by: str = "device") -> DataFrame:
    """One row per variant and ``by``: latencies of its last pass, ``speedup`` over the baseline there, and its metrics.

    timings: variant, ``by``, the number of the pass and milliseconds.  A variant without
    timings has no row; one without accuracy has nulls.
    """
    last = statistics.last_pass(timings, "variant", number)
    timed = statistics.latency(last, ["variant", by], ms)
    return statistics.against_baseline(timed, "variant", baseline, "fps", [by]).join(F.broadcast(accuracy), "variant", "left")
