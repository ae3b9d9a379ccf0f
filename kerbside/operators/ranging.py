"""Metric range of boxes from apparent size and from the ground plane, fused.

One projection over the boxes and a broadcast of the priors: no shuffle, no UDF.
Missing numbers are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.config import Camera, Prior, RangingConfig, RangingSetup, resized
from kerbside.functions import geometry as geo

PRIOR_SCHEMA = (
    "prior_name string, height_m double, height_sigma_m double, ground_contact boolean, mount_height_m double, mount_height_sigma_m double"
)


def prior_table(df: DataFrame, priors: tuple[Prior, ...]) -> DataFrame:
    rows = [(p.name, p.height_m, p.height_sigma_m, p.ground_contact, p.mount_height_m, p.mount_height_sigma_m) for p in priors]
    return df.sparkSession.createDataFrame(rows, PRIOR_SCHEMA)


def _size_gate(cam: Camera, cfg: RangingConfig) -> Column:
    """The first gate that keeps the height of a box from giving its depth, or null."""
    margin = cfg.truncation_margin_px
    return (
        F.when(F.coalesce(F.col("height_m"), F.lit(0.0)) <= 0, "size:no_prior")
        .when(F.col("_h") < cfg.min_box_height_px, "size:box_too_small")
        .when((F.col("y1") <= margin) | (F.col("y2") >= F.lit(cam.size[1] - margin)), "size:truncated")
    )


def _size_cue(cam: Camera, cfg: RangingConfig) -> tuple[Column, Column]:
    """Depth and inverse squared relative sigma, null where a gate holds."""
    by_edge, by_height = F.lit(math.sqrt(2) * cfg.edge_sigma_px) / F.col("_h"), F.col("height_sigma_m") / F.col("height_m")
    free = F.col("_fs").isNull()
    return F.when(free, cam.focal[1] * F.col("height_m") / F.col("_h")), F.when(free, F.try_divide(F.lit(1.0), by_edge * by_edge + by_height * by_height))


def _plane_gate(cam: Camera, cfg: RangingConfig) -> Column:
    """The first gate that keeps the foot of a box from giving its depth, or null."""
    plane, n, d = (F.col(c) for c in ("_plane", "_n", "_d"))
    meets = (F.abs(d) >= 1e-9) & (plane * n * d > 0)
    return (
        F.when(~F.col("ground_contact") & (F.col("mount_height_m") <= 0), "plane:not_applicable")
        .when(F.col("y2") >= F.lit(cam.size[1] - cfg.truncation_margin_px), "plane:base_cut_off")
        .when(F.abs(plane) < 0.05, "plane:degenerate_height")
        .when(~F.coalesce(meets, F.lit(False)), "plane:above_horizon")
        .when(F.abs(n) < 1e-9, "plane:degenerate")
        .when(plane * d <= 0, "plane:behind_camera")
    )


def _plane_cue(cam: Camera, cfg: RangingConfig) -> tuple[Column, Column]:
    """Depth and inverse squared relative sigma, null where a gate holds.

    With n = cos - v sin and d = v cos + sin of the pitch and the normalised row
    v, the depth of the ray on the plane is plane / d, as n cos + d sin = 1.  Its
    relative change is -1 / (n d) per unit of row and -(d / n + n / d) per radian
    of pitch, where n belongs to the horizontal range that the pitch error turns.
    """
    plane, n, d = (F.col(c) for c in ("_plane", "_n", "_d"))
    by_row = F.lit(cfg.edge_sigma_px / cam.focal[1]) / (n * d)
    by_height = F.hypot(F.lit(cam.sigma.height_m), F.col("mount_height_sigma_m")) / plane
    by_pitch = (d / n + n / d) * math.radians(cam.sigma.pitch_deg)
    free = F.col("_fp").isNull()
    return F.when(free, plane / d), F.when(free, F.try_divide(F.lit(1.0), by_row * by_row + by_height * by_height + by_pitch * by_pitch))


def estimate_ranges(df: DataFrame, setup: RangingSetup | None = None, image_size: tuple[int, int] | None = None) -> DataFrame:
    """Add the range of every box: columns class_name, x1, y1, x2, y2 to

    valid, method (fused, size, plane, none), distance_m, sigma_m, forward_m,
    lateral_m, size_m, size_sigma_m, plane_m, plane_sigma_m, flags.

    ``image_size`` (width, height) rescales the camera.  The distance is clamped,
    its sigma and the coordinates are not.  Flags of both cues stay even where
    the other one succeeds or the mode leaves one out.
    """
    setup = setup or RangingSetup()
    cfg = setup.config
    cam = resized(setup.camera, image_size) if image_size else setup.camera
    own = df.columns
    rows = df.join(F.broadcast(prior_table(df, setup.priors)), F.col("class_name") == F.col("prior_name"), "left")
    known = F.col("prior_name").isNotNull()
    # What is used more than once is a column of its own: Catalyst keeps such
    # projections apart, and the generated code stays small.
    c, s, v = math.cos(cam.pose.pitch), math.sin(cam.pose.pitch), geo.normalised_row(F.col("y2"), cam)
    rows = rows.withColumns({"_h": F.col("y2") - F.col("y1"), "_plane": F.lit(cam.pose.height_m) - F.col("mount_height_m"), "_n": c - v * s, "_d": v * c + s})
    # an unknown class fails the first gate of the size and, without a plane, one of the plane's
    rows = rows.withColumns({"_fs": _size_gate(cam, cfg), "_fp": _plane_gate(cam, cfg)})
    cues = dict(zip(("_zs", "_ws"), _size_cue(cam, cfg), strict=True)) | dict(zip(("_zp", "_wp"), _plane_cue(cam, cfg), strict=True))
    left_out = {"ground_only": ("_zs", "_ws"), "size_only": ("_zp", "_wp")}.get(cfg.fusion, ())
    cues |= {k: F.lit(None).cast("double") for k in left_out}
    # A filter on a result is pushed down by substitution as far as here: it does not pass a generator,
    # or it would hold the cues several times over and no longer compile.
    rows = rows.select("*", F.inline_outer(F.array(F.struct(*[v.alias(k) for k, v in cues.items()]))))
    # Each line below refers to a cue as rarely as it can: a filter on a result is
    # pushed down by substitution, and repeated references would multiply there.
    zs, ws, zp, wp = (F.col(c) for c in ("_zs", "_ws", "_zp", "_wp"))
    zero = F.lit(0.0)
    weight = F.coalesce(ws, zero) + F.coalesce(wp, zero)
    u, v = (F.col("x1") + F.col("x2")) * 0.5, F.least(F.col("y2"), F.lit(float(cam.size[1] - 1)))
    per_depth = geo.distance_of(u, v, F.lit(1.0), cam)
    rows = rows.withColumns(
        {
            "_z": F.exp(F.try_divide(F.coalesce(ws * F.ln(zs), zero) + F.coalesce(wp * F.ln(zp), zero), weight)),
            "_r": F.sqrt(F.try_divide(F.lit(1.0), weight)),
            "_apart": F.abs(F.ln(zs) - F.ln(zp)),
        }
    )
    depth = F.col("_z")
    lateral, _, forward = geo.backproject(u, v, F.lit(1.0), cam)
    rows = rows.withColumns({"_dist": depth * per_depth, "forward_m": depth * forward, "lateral_m": depth * lateral})
    flags = F.array_compact(
        F.array(
            F.when(known, F.col("_fs")),
            F.when(known, F.col("_fp")),
            F.when(F.col("_apart") > math.log(1.6), F.concat(F.lit("cue_disagreement:"), F.format_string("%.2f", F.bround(F.exp("_apart"), 2)), F.lit("x"))),
            F.when(F.col("_dist") > cfg.max_range_m, "range_saturated"),
            F.when(~known, F.concat(F.lit("no_prior:"), F.col("class_name"))),
            F.when(known & F.col("_fs").isNull() & F.col("_fp").isNull() & depth.isNull(), "no_valid_cue"),
        )
    )
    method = F.when(zs.isNotNull() & zp.isNotNull(), "fused").when(zs.isNotNull(), "size").when(zp.isNotNull(), "plane")
    return rows.select(
        *own,
        depth.isNotNull().alias("valid"),
        method.when(known, "none").otherwise("").alias("method"),
        # least and greatest skip nulls, so an unknown distance needs its own case
        F.when(F.col("_dist").isNotNull(), F.least(F.greatest("_dist", F.lit(cfg.min_range_m)), F.lit(cfg.max_range_m))).alias("distance_m"),
        (F.col("_dist") * F.col("_r")).alias("sigma_m"),
        "forward_m",
        "lateral_m",
        (zs * per_depth).alias("size_m"),
        (zs * per_depth / F.sqrt(ws)).alias("size_sigma_m"),
        (zp * per_depth).alias("plane_m"),
        (zp * per_depth / F.sqrt(wp)).alias("plane_sigma_m"),
        flags.alias("flags"),
    )


def nearest_first(df: DataFrame, frame: str, *ties: str) -> DataFrame:
    """Add ``rank`` within each frame, nearest box first; unknown ranges last, ties by ``ties``."""
    order = Window.partitionBy(frame).orderBy(F.coalesce("distance_m", F.lit(1e9)), *ties)
    return df.withColumn("rank", F.row_number().over(order))


def nearest(df: DataFrame, frame: str, columns: list[str], *ties: str) -> DataFrame:
    """The nearest box of each frame.  A partial aggregate, so that no frame is sorted."""
    key = F.struct(F.coalesce("distance_m", F.lit(1e9)).alias("_d"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    best = df.groupBy(frame).agg(F.min(F.struct(key.alias("_key"), F.struct(*columns).alias("_row"))).alias("_best"))
    return best.select(frame, "_best._row.*")
