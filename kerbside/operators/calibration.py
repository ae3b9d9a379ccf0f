"""Camera height and pitch from the agreement of the two range cues.

Samples have v_bottom, h_px and height_m.  Every step is one aggregate over the
samples for a small grid of candidates; only the grid's losses come to the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import Camera, Pose, resized
from kerbside.operators.quantiles import percentiles

#: Minimum box height and the fraction of the image below which the base has to be.
SENSITIVITY = ((0, 0.0), (40, 0.0), (60, 0.62), (80, 0.76), (120, 0.83), (160, 0.86))


def gate(df: DataFrame, width: Column, height: Column, min_h_px: float, min_base: float, aspect: float = 16 / 9, margin: float = 6.0) -> DataFrame:
    """Boxes fit for calibration: image of the aspect, tall enough, base low enough, clear of every border."""
    return df.where(
        (F.abs(width / height - aspect) <= 0.03)
        & (F.col("y2") - F.col("y1") >= min_h_px)
        & (F.col("y2") >= min_base * height)
        & (F.col("y1") > margin) & (F.col("y2") < height - margin)
        & (F.col("x1") > margin) & (F.col("x2") < width - margin)
    )


def modal_size(df: DataFrame, width: str, height: str, order: str) -> DataFrame:
    """The most frequent (width, height); of equals the one seen first in ``order``."""
    sizes = df.groupBy(width, height).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return sizes.agg(F.max_by(F.struct(width, height, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_s")).select("_s.*")


def height_sensitivity(samples: DataFrame, cam: Camera, thresholds: Sequence[tuple[float, float]] = SENSITIVITY, least: int = 25) -> DataFrame:
    """Quartiles of the implied camera height under each pair of thresholds with ``least`` samples; one pass."""
    implied = F.col("height_m") * (F.col("v_bottom") - cam.centre[1]) / F.col("h_px")
    rungs = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(h)).alias("min_box_px"), F.lit(float(b)).alias("min_base_frac")) for i, (h, b) in enumerate(thresholds)])
    rows = samples.select("h_px", "v_bottom", implied.alias("_m"), F.explode(rungs).alias("_t")).select("*", "_t.*")
    rows = rows.where((F.col("h_px") >= F.col("min_box_px")) & (F.col("v_bottom") >= F.col("min_base_frac") * cam.size[1]))
    made = percentiles(rows, ["step", "min_box_px", "min_base_frac"], F.col("_m"), [0.25, 0.5, 0.75], aggregates=[F.count("*").alias("_all")])
    made = made.withColumn("n", F.col("_all")).where(F.col("n") >= least)
    return made.select("step", "min_box_px", "min_base_frac", "n", *[F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("q25", "median", "q75"))])


def last_usable(rungs: DataFrame, least: int = 300) -> DataFrame:
    """The height of the strictest rung that still has ``least`` samples."""
    return rungs.where(F.col("n") >= least).agg(F.max_by("median", "step").alias("height_m"))


def log_ratio(cam: Camera, height: Column | float, pitch_deg: Column | float) -> Column:
    """Log of size depth over plane depth; null where the plane is not hit ahead."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    h, t = as_col(height), F.radians(as_col(pitch_deg))
    c, s = F.cos(t), F.sin(t)
    vn = (F.col("v_bottom") - cam.centre[1]) / cam.focal[1]
    den = vn * c + s
    plane = h * s + F.when(den != 0, h * (c - vn * s) / den) * c
    return F.ln(cam.focal[1] * F.col("height_m") / F.col("h_px")) - F.when(plane > 1e-6, F.ln(plane))


def huber(r: Column, delta: float = 0.25) -> Column:
    a = F.abs(r)
    q = F.least(a, F.lit(delta))
    return 0.5 * q * q + delta * (a - q)


def losses(samples: DataFrame, cam: Camera, grid: Sequence[tuple[float, float]], delta: float = 0.25) -> DataFrame:
    """(height, pitch_deg, loss): mean Huber loss of each candidate, 1e9 without a finite sample."""
    # as one folded literal, so that another grid runs the same compiled code
    points = F.from_json(F.lit(json.dumps([{"height": float(h), "pitch_deg": float(p)} for h, p in grid])), "array<struct<height:double,pitch_deg:double>>")
    rows = samples.select("v_bottom", "h_px", "height_m", F.explode(points).alias("_p")).select("*", "_p.*")
    loss = huber(log_ratio(cam, F.col("height"), F.col("pitch_deg")), delta)
    return rows.groupBy("height", "pitch_deg").agg(F.coalesce(F.avg(loss), F.lit(1e9)).alias("loss"))


def seed_height(samples: DataFrame, cam: Camera, bounds: tuple[float, float] = (0.4, 3.0)) -> DataFrame:
    """Median of the height that pitch 0 implies, within the bounds."""
    implied = F.when(F.col("h_px") != 0, F.col("height_m") * (F.col("v_bottom") - cam.centre[1]) / F.col("h_px"))
    middle = F.get("q", F.lit(0))
    return percentiles(samples, [], implied, [0.5]).select(F.when(middle.isNotNull(), F.least(F.greatest(middle, F.lit(bounds[0])), F.lit(bounds[1]))).alias("height_m"))


def agreement(samples: DataFrame, cam: Camera, height: float | None = None, pitch_deg: float | None = None) -> DataFrame:
    """One row: n, median_ratio, median_abs_log_ratio, p90_abs_log_ratio over samples with both cues."""
    r = log_ratio(cam, cam.pose.height_m if height is None else height, cam.pose.pitch_deg if pitch_deg is None else pitch_deg)
    # the ratio and its size as two groups, so that one search serves both
    rows = samples.select(r.alias("_r")).select(F.inline(F.array(F.struct(F.lit(0).alias("_kind"), F.col("_r").alias("_x")), F.struct(F.lit(1).alias("_kind"), F.abs("_r").alias("_x")))))
    made = percentiles(rows, ["_kind"], F.col("_x"), [0.5, 0.9])
    of = lambda kind, i: F.max(F.when(F.col("_kind") == kind, F.get("q", F.lit(i))))
    return made.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.exp(of(0, 0)).alias("median_ratio"), of(1, 0).alias("median_abs_log_ratio"), of(1, 1).alias("p90_abs_log_ratio"),
    )


@dataclass(frozen=True)
class Fit:
    pose: Pose
    loss: float


def fit_pose_by_simplex(
    samples: DataFrame,
    cam: Camera,
    fixed_height: float | None = None,
    height_bounds: tuple[float, float] = (0.4, 3.0),
    pitch_bounds: tuple[float, float] = (-12.0, 12.0),
    starts: Sequence[float] = (-4.0, 0.0, 4.0),
    least: int = 50,
    x_tolerance: float = 1e-4,
    loss_tolerance: float = 1e-8,
    steps: int = 200,
) -> Fit:
    """Pose with the least loss of downhill simplexes from several pitches.

    All simplexes move together: a step sends every point that any of them may
    need (reflected, expanded, contracted on both sides, shrunk) through one
    aggregate over the samples, so a step is one job whatever the number of
    starts.  A simplex rests when its corners and losses agree; points out of bounds
    lose by 1e9.  The first height is the one that pitch 0 implies.  Fewer than ``least`` samples are an error.
    """
    if (n := samples.count()) < least:
        raise ValueError(f"{n} calibration samples; at least {least} are needed")
    kept = samples.persist()
    try:
        height = fixed_height if fixed_height else seed_height(kept, cam).first()["height_m"]

        def priced(points: Sequence[tuple[float, ...]]) -> dict[tuple[float, ...], float]:
            whole = {p: p if len(p) == 2 else (fixed_height, *p) for p in points}
            within = {w for w in whole.values() if height_bounds[0] <= w[0] <= height_bounds[1] and pitch_bounds[0] <= w[1] <= pitch_bounds[1]}
            got = {(r["height"], r["pitch_deg"]): r["loss"] for r in losses(kept, cam, sorted(within)).collect()} if within else {}
            return {p: got.get(w, 1e9) for p, w in whole.items()}

        def corners(first: tuple[float, ...]) -> list[tuple[float, ...]]:
            # a corner for each free number, five percent away
            return [first] + [tuple(v if i != j else v * 1.05 if v else 0.00025 for j, v in enumerate(first)) for i in range(len(first))]

        simplexes = [corners((p,) if fixed_height else (height, p)) for p in starts]
        known = priced([c for s in simplexes for c in s])
        simplexes = [sorted((known[c], c) for c in s) for s in simplexes]
        for _ in range(steps):
            moving = [s for s in simplexes if max(abs(a - b) for _, c in s[1:] for a, b in zip(c, s[0][1], strict=True)) > x_tolerance or max(v - s[0][0] for v, _ in s[1:]) > loss_tolerance]
            if not moving:
                break
            ways = [_ways([c for _, c in s]) for s in moving]
            known = priced(list({c for w in ways for some in w.values() for c in (some if isinstance(some, list) else [some])}))
            for s, way in zip(moving, ways, strict=True):
                s[:] = _moved(s, way, known)
        loss, best = min(s[0] for s in simplexes)
        return Fit(Pose(*(best if len(best) == 2 else (fixed_height, *best))), loss)
    finally:
        kept.unpersist()


def _ways(corners: list[tuple[float, ...]]) -> dict:
    """Where a simplex may move, its corners in the order of their losses."""
    *good, worst = corners
    middle = [sum(c) / len(good) for c in zip(*good, strict=True)]
    along = lambda t: tuple(m + t * (m - w) for m, w in zip(middle, worst, strict=True))
    shrunk = [tuple((a + b) / 2 for a, b in zip(corners[0], c, strict=True)) for c in corners[1:]]
    return {"reflected": along(1.0), "expanded": along(2.0), "outside": along(0.5), "inside": along(-0.5), "shrunk": shrunk}


def _moved(simplex: list[tuple[float, tuple]], way: dict, known: dict) -> list[tuple[float, tuple]]:
    (best, _), second, worst = simplex[0], simplex[-2][0], simplex[-1][0]
    at = lambda name: (known[way[name]], way[name])
    reflected = at("reflected")
    if reflected[0] < best:
        new = min(at("expanded"), reflected)
    elif reflected[0] < second:
        new = reflected
    else:
        new = at("outside") if reflected[0] < worst else at("inside")
        if new[0] > min(reflected[0], worst):
            return sorted([simplex[0], *((known[c], c) for c in way["shrunk"])])
    return sorted([*simplex[:-1], new])


def fit_pose(
    samples: DataFrame,
    cam: Camera,
    fixed_height: float | None = None,
    height_bounds: tuple[float, float] = (0.4, 3.0),
    pitch_bounds: tuple[float, float] = (-12.0, 12.0),
    rounds: int = 6,
    side: int = 9,
    least: int = 50,
) -> Fit:
    """Pose with the least loss, by a grid that closes in around the best point.

    Each round is one job that sends ``side`` (squared, if the height is free)
    numbers back.  Fewer than ``least`` samples are an error.
    """
    if (n := samples.count()) < least:
        raise ValueError(f"{n} calibration samples; at least {least} are needed")
    (h0, h1), (p0, p1) = height_bounds, pitch_bounds
    kept = samples.persist()
    try:
        best = Fit(Pose(math.nan, math.nan), math.inf)
        for _ in range(rounds):
            step = lambda lo, hi: [lo + (hi - lo) * i / (side - 1) for i in range(side)]
            heights = [fixed_height] if fixed_height else step(h0, h1)
            found = losses(kept, cam, [(h, p) for h in heights for p in step(p0, p1)]).agg(F.min(F.struct("loss", "height", "pitch_deg")).alias("m")).first()["m"]
            if found["loss"] < best.loss:
                best = Fit(Pose(found["height"], found["pitch_deg"]), found["loss"])
            # two cells on either side, within the bounds
            dh, dp = 2 * (h1 - h0) / (side - 1), 2 * (p1 - p0) / (side - 1)
            h0, h1 = max(height_bounds[0], best.pose.height_m - dh), min(height_bounds[1], best.pose.height_m + dh)
            p0, p1 = max(pitch_bounds[0], best.pose.pitch_deg - dp), min(pitch_bounds[1], best.pose.pitch_deg + dp)
        return best
    finally:
        kept.unpersist()


@dataclass(frozen=True)
class Calibration:
    """The camera with its new pose, quartiles of the implied height, and how far the two cues agree before and after, on rows not fitted."""

    camera: Camera
    sensitivity: DataFrame
    before: DataFrame
    after: DataFrame
    loss: float


def calibrate(samples: DataFrame, cam: Camera, image_size: tuple[int, int] | None = None, held_out: Column | None = None, fix_height: bool = True) -> Calibration:
    """Fit a camera's pose to samples (v_bottom, h_px, height_m) and check it on the ``held_out`` ones.

    ``image_size`` is that of the samples, if it is not the camera's.  With
    ``fix_height`` the height is that of the strictest thresholds with enough
    samples, where there is one, and only the pitch is fitted.  The camera comes
    back at its own size, and keeps its sigmas.
    """
    view = resized(cam, image_size) if image_size else cam
    apart = held_out if held_out is not None else F.lit(False)
    used, check = samples.where(~apart), samples.where(apart) if held_out is not None else samples
    rungs = height_sensitivity(used, view)
    height = last_usable(rungs).first()["height_m"] if fix_height else None
    fit = fit_pose(used, view, fixed_height=height)
    made = replace(cam, pose=fit.pose, source="auto_calibrated")
    return Calibration(made, rungs, agreement(check, view), agreement(check, replace(view, pose=fit.pose)), fit.loss)
