"""Ranging and geometry: random scenes through a forward model written apart, and tables of single cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.config import CAMERA, Camera, Pose, Prior, RangingConfig, RangingSetup, camera_tree, overlay, pinhole, ranging_setup, read_camera, resized
from kerbside.functions import boxes as bx
from kerbside.functions import geometry as geo
from kerbside.operators import calibration, ranging, stereo

BOX = "class_name string, x1 double, y1 double, x2 double, y2 double"
PRIORS = (Prior("cone", 0.75, 0.14), Prior("stop_sign", 0.79, 0.09, ground_contact=False, mount_height_m=2.0, mount_height_sigma_m=0.45), Prior("flat", None, None), Prior("hung", 0.5, 0.1, ground_contact=False))


def looking(pitch_deg: float, up: float = 1.3) -> Camera:
    return pinhole((1920, 1080), 60.0, Pose(up, pitch_deg))


def seen(cam: Camera, points) -> np.ndarray:
    """Pixels and optical depths of points (right, down, forward) in the level frame, by a rotation and an intrinsic matrix."""
    t = cam.pose.pitch
    turn = np.array([[1, 0, 0], [0, math.cos(t), -math.sin(t)], [0, math.sin(t), math.cos(t)]])
    inner = np.array([[cam.focal[0], 0, cam.centre[0]], [0, cam.focal[1], cam.centre[1]], [0, 0, 1]])
    image = np.asarray(points, float) @ turn.T @ inner.T
    return np.column_stack([image[:, :2] / image[:, 2:], image[:, 2]])


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def scene(seed: int, n: int = 40):
    rng = random.Random(seed)
    return [(rng.uniform(-4, 4), rng.uniform(-1, 1.5), rng.uniform(3, 70)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_pixels_with_depth_go_back_to_their_points(spark, seed):
    cam = looking(random.Random(seed).uniform(-9, 9))
    points = scene(seed)
    table = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([seen(cam, points), points])], "u double, v double, d double, x double, y double, z double")
    back = geo.backproject(F.col("u"), F.col("v"), F.col("d"), cam)
    far = geo.distance_of(F.col("u"), F.col("v"), F.col("d"), cam)
    worst = table.select(*[F.max(F.abs(b - F.col(c))).alias(c) for b, c in zip(back, "xyz", strict=True)], F.max(F.abs(far - F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))).alias("far")).first()
    assert max(worst) < 1e-8


@pytest.mark.parametrize("seed", range(4))
def test_rows_of_the_road_and_ranges_undo_each_other(spark, seed):
    rng = random.Random(seed)
    cam = looking(rng.uniform(-9, 9), rng.uniform(0.8, 2.5))
    road = [(0.0, cam.pose.height_m, rng.uniform(3, 70)) for _ in range(30)]
    table = spark.createDataFrame([(float(r[1]), z) for r, (_, _, z) in zip(seen(cam, road), road, strict=True)], "v double, z double")
    plane = F.lit(cam.pose.height_m)
    off = table.select(F.max(F.abs(geo.ground_range(F.col("v"), plane, cam) / F.col("z") - 1)), F.max(F.abs(geo.row_of_forward(F.col("z"), plane, cam) - F.col("v")))).first()
    assert max(off) < 1e-7
    sky = geo.horizon_of_pitch(F.lit(cam.centre[1]), F.lit(cam.focal[1]), F.lit(cam.pose.pitch_deg)) - 4
    row = values(spark, none=geo.ground_range(sky, plane, cam), inf=geo.ground_range_or_inf(sky, plane, cam), pitch=geo.pitch_from_horizon(sky + 4, cam))
    assert row.none is None and row.inf == math.inf and row.pitch == pytest.approx(cam.pose.pitch_deg)


def test_view_focal_and_level_frame(spark):
    row = values(spark, f=geo.focal_of_view(F.lit(1920), F.lit(60.0)), v=geo.view_of_focal(F.lit(1920), F.lit(pinhole((1920, 1080), 47.0).focal[0])), d=geo.depth_to_forward(F.lit(5.0), F.lit(60.0)))
    assert (row.f, row.v, row.d) == pytest.approx((960 * math.sqrt(3), 47.0, 2.5))
    turned = values(spark, **dict(zip("xyz", geo.levelled(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(90.0)), strict=True)))
    assert tuple(turned) == pytest.approx((1.0, 2.0, 0.0), abs=1e-12)


def ranged(spark, rows, cam=None, size=None, **config):
    return ranging.estimate_ranges(spark.createDataFrame(rows, BOX), RangingSetup(cam or looking(0.0), PRIORS, RangingConfig(**config)), size).collect()


def standing(cam: Camera, name: str, height: float, z: float, x: float = 0.0) -> tuple:
    """The box of an upright square thing on the road."""
    base, top = seen(cam, [(x, cam.pose.height_m, z), (x, cam.pose.height_m - height, z)])
    half = (base[1] - top[1]) / 2
    return name, float(base[0] - half), float(top[1]), float(base[0] + half), float(base[1])


def test_things_of_known_size_are_ranged_by_both_cues(spark):
    cam = looking(0.0)
    depth = [5.0, 7.5, 15.0, 33.0]
    for r, z in zip(ranged(spark, [standing(cam, "cone", 0.75, z) for z in depth], cam), depth, strict=True):
        assert (r.method, r.flags) == ("fused", []) and r.forward_m == pytest.approx(z, rel=1e-6) and r.distance_m == pytest.approx(math.hypot(z, 1.3), rel=1e-6)
        assert r.sigma_m < min(r.size_sigma_m, r.plane_sigma_m)  # two cues are surer than either


GATES = [
    (("cone", 900.0, 1.0, 1000.0, 900.0), "plane", ["size:truncated"]),
    (("cone", 900.0, 900.0, 1000.0, 1079.0), "none", ["size:truncated", "plane:base_cut_off"]),
    (("cone", 900.0, 100.0, 960.0, 200.0), "size", ["plane:above_horizon"]),
    (("cone", 900.0, 600.0, 905.0, 605.0), "plane", ["size:box_too_small"]),
    (("banana", 900.0, 600.0, 960.0, 700.0), "", ["no_prior:banana"]),
    (("flat", 900.0, 600.0, 960.0, 700.0), "plane", ["size:no_prior"]),
    (("hung", 900.0, 600.0, 960.0, 700.0), "size", ["plane:not_applicable"]),
]


def test_gates_close_one_cue_or_both(spark):
    for r, (_, method, flags) in zip(ranged(spark, [g[0] for g in GATES]), GATES, strict=True):
        assert (r.method, r.flags) == (method, flags) and r.valid == (r.distance_m is not None) == (method not in ("", "none"))


def test_modes_disagreement_and_saturation(spark):
    cam = looking(0.0)
    name, x1, y1, x2, y2 = standing(cam, "cone", 0.75, 10.0)
    assert ranged(spark, [(name, x1, (y1 + y2) / 2, x2, y2)])[0].flags == ["cue_disagreement:2.00x"]
    far = ranged(spark, [standing(cam, "cone", 0.75, 120.0)], min_box_height_px=1.0)[0]
    assert far.distance_m == 80.0 and far.flags == ["range_saturated"] and far.forward_m == pytest.approx(120.0, rel=1e-6)
    assert [ranged(spark, [(name, x1, y1, x2, y2)], fusion=m)[0].method for m in ("size_only", "ground_only")] == ["size", "plane"]
    with pytest.raises(ValueError):
        RangingConfig(fusion="other")


@pytest.mark.parametrize("by", [2, 3])
def test_ranges_do_not_depend_on_the_image_size(spark, by):
    box = standing(looking(2.0), "cone", 0.75, 12.0, 1.5)
    small = ranged(spark, [(box[0], *[x / by for x in box[1:]])], looking(2.0), (1920 // by, 1080 // by), min_box_height_px=1.0, edge_sigma_px=2.5 / by)[0]
    whole = ranged(spark, [box], looking(2.0))[0]
    assert (small.forward_m, small.lateral_m) == pytest.approx((whole.forward_m, whole.lateral_m), rel=1e-6)


def test_nearest_first(spark):
    rows = spark.createDataFrame([(1, 5.0, "a"), (1, None, "b"), (1, 2.0, "c"), (2, None, "d")], "frame int, distance_m double, k string")
    assert [r.k for r in ranging.nearest_first(rows, "frame", "k").orderBy("frame", "rank").collect()] == ["c", "a", "b", "d"]
    assert {(r.frame, r.k) for r in ranging.nearest(rows, "frame", ["k"], "k").collect()} == {(1, "c"), (2, "d")}


def samples_of(spark, cam: Camera, seed: int, n: int = 400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        box = standing(cam, "cone", rng.gauss(0.75, 0.05), rng.uniform(4, 35))
        rows.append((i, box[4], box[4] - box[2], 0.75))
    return spark.createDataFrame(rows, "i int, v_bottom double, h_px double, height_m double")


@pytest.mark.parametrize("pose", [Pose(1.55, 2.5), Pose(1.10, -1.5)])
def test_calibration_finds_the_pose(spark, pose):
    true = pinhole((1920, 1080), 60.0, pose)
    samples, start = samples_of(spark, true, 0), pinhole((1920, 1080), 60.0)
    free = calibration.fit_pose(samples, start)
    assert free.pose.height_m == pytest.approx(pose.height_m, rel=0.06) and abs(free.pose.pitch_deg - pose.pitch_deg) < 0.6
    fixed = calibration.fit_pose(samples, start, fixed_height=pose.height_m)
    assert abs(fixed.pose.pitch_deg - pose.pitch_deg) < 0.3
    made = calibration.calibrate(samples, start, held_out=F.col("i") % 4 == 0, fix_height=False)
    assert made.camera.source == "auto_calibrated" and made.camera.sigma == start.sigma and made.sensitivity.count() > 0
    assert made.after.first().median_abs_log_ratio < 0.1 < made.before.first().median_abs_log_ratio and made.after.first().n <= 100
    half = calibration.calibrate(samples.withColumns({c: F.col(c) / 2 for c in ("v_bottom", "h_px")}), start, (960, 540), fix_height=False)
    assert half.camera.size == start.size and half.camera.pose.pitch_deg == pytest.approx(calibration.calibrate(samples, start, fix_height=False).camera.pose.pitch_deg)
    with pytest.raises(ValueError):
        calibration.fit_pose(samples.limit(10), start)


def test_stereo_relations(spark):
    rows = {r.range_m: r for r in stereo.design_table(spark, 700.0, 0.12, (1, 5, 10, 20)).collect()}
    assert all(r.disparity_px * z == pytest.approx(84.0) for z, r in rows.items())
    assert rows[20].sigma_m == pytest.approx(4 * rows[10].sigma_m)
    assert values(spark, z=geo.disparity_to_depth(F.lit(0.0), 700.0, 0.12)).z == math.inf


def test_triangulation_recovers_points(spark):
    cam, shift, points = looking(0.0), 0.5, [(1.0, 0.5, 8.0), (-2.0, 1.0, 15.0)]
    left, right = seen(cam, points), seen(cam, np.array(points) - [shift, 0, 0])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([left[:, :2], right[:, :2]])], "u1 double, v1 double, u2 double, v2 double")
    k = [[cam.focal[0], 0.0, cam.centre[0]], [0.0, cam.focal[1], cam.centre[1]], [0.0, 0.0, 1.0]]
    made = stereo.valid_depths(stereo.triangulate(rows, k, np.eye(3).tolist(), [-shift, 0, 0])).collect()
    assert [(r.X, r.Y, r.Z) for r in made] == [pytest.approx(p, rel=1e-6) for p in points]


@pytest.mark.parametrize("pitch", [-3.0, 0.0, 6.0])
def test_the_raster_of_the_ground_lies_in_the_image(spark, pitch):
    cam = looking(pitch)
    take = np.array(geo.raster_homography(cam, -10.0, 40.0, 10.0))
    for x, z in ((-4.0, 9.0), (0.0, 20.0), (7.5, 38.0)):
        place = values(spark, **dict(zip("pq", geo.raster_pixel(F.lit(x), F.lit(z), -10.0, 40.0, 10.0), strict=True)))
        u, v, w = take @ [place.p, place.q, 1.0]
        assert (u / w, v / w) == pytest.approx(tuple(seen(cam, [(x, cam.pose.height_m, z)])[0, :2]), rel=1e-9)
    on = values(spark, a=geo.on_raster(F.lit(0.0), F.lit(10.0)), b=geo.on_raster(F.lit(11.0), F.lit(10.0)), c=geo.on_raster(F.lit(None).cast("double"), F.lit(10.0)))
    assert tuple(on) == (True, False, False)


def test_boxes(spark):
    a, b = [F.lit(x) for x in (0.0, 0.0, 10.0, 10.0)], [F.lit(x) for x in (5.0, 0.0, 15.0, 10.0)]
    row = values(spark, third=bx.iou(a, b), none=bx.iou(a, [F.lit(0.0)] * 4), floor=bx.iou_floored([F.lit(1.0)] * 4, [F.lit(1.0)] * 4), meet=bx.overlaps(a, b), inf=bx.finite(F.lit(float("inf"))), two=bx.finite(F.lit(2.0)))
    assert row.third == pytest.approx(1 / 3) and (row.none, row.floor, row.meet, row.inf, row.two) == (0.0, 0.0, True, None, 2.0)
    assert [values(spark, x=bx.size_band(F.lit(x))).x for x in (1023.0, 1024.0, 9216.0)] == ["small", "medium", "large"]


def test_configuration():
    tree = {"intrinsics": {"image_width": 640, "image_height": 480, "hfov_deg": 90.0}, "priors": {"cone": {"height_m": 0.7, "odd": 1}}, "estimator": {"bbox_edge_sigma_px": 3.0}}
    setup = ranging_setup(tree)
    assert setup.camera.focal == pytest.approx((320.0, 320.0)) and setup.priors[0].height_m == 0.7 and setup.config.edge_sigma_px == 3.0
    assert camera_tree(setup.camera)["intrinsics"]["hfov_deg"] == 90.0 and read_camera(camera_tree(CAMERA)) == CAMERA
    assert read_camera({"intrinsics": {"image_width": 4, "image_height": 2, "fx": 3.0}, "extrinsics": {"pitch_deg": 1}}) == Camera((4, 2), (3.0, 3.0), (2.0, 1.0), Pose(1.3, 1.0))
    assert resized(CAMERA, (960, 540)).centre == (480.0, 270.0)
    assert overlay({"a": 1, "b": 2}, {"b": None, "c": 3}, a=9) == {"a": 9, "b": 2, "c": 3}
