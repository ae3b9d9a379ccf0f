"""Lens distortion is recovered from planted boards; simplexes agree with the closing grid."""

from __future__ import annotations

import numpy as np
import pytest

from kerbside.operators import lens

REAL = {"a": [800.0, 820, 320, 240, -0.28, 0.09, -0.01, 0.0012, -0.0008], "b": [1200.0, 1190, 640, 350, 0.11, -0.05, 0.02, -0.0005, 0.001]}


def corners(rng, cam: str, views: int, noise: float) -> list:
    x, y = (g.ravel() * 0.025 for g in np.meshgrid(np.arange(9.0), np.arange(6.0)))
    rows = []
    for v in range(views):
        pose = np.array([0.4 * np.cos(v), 0.45 * np.sin(v), 0.2 * v, -0.1 + 0.02 * np.cos(2 * v), -0.06 + 0.02 * np.sin(v), 0.28 + 0.02 * v])
        seen = lens.projected(REAL[cam], pose, x, y) + rng.normal(0, noise, (54, 2)) if noise else lens.projected(REAL[cam], pose, x, y)
        rows += [(cam, v, *map(float, c)) for c in np.column_stack([x, y, seen])]
    return rows


def test_known_distortion_is_recovered(spark):
    rng = np.random.default_rng(0)
    rows = corners(rng, "a", 8, 0.0) + corners(rng, "b", 8, 0.05)
    rows += [("few", v, *r[2:]) for v in range(2) for r in corners(rng, "a", 1, 0.0)] + [(None, 1, 0.0, 0.0, 0.0, 0.0), ("a", 99, 0.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cam string, view int, x double, y double, u double, v double").repartition(3)
    got = {r.cam: r for r in lens.refined_intrinsics(df, "cam", "view", steps=14).collect()}
    numbers = {k: np.array([got[k][n] for n in lens.NUMBERS], float) for k in REAL}
    assert np.allclose(numbers["a"][:4], REAL["a"][:4], rtol=1e-5) and np.allclose(numbers["a"][4:], REAL["a"][4:], atol=2e-3) and got["a"].rms_px < 1e-3
    assert np.allclose(numbers["b"][:4], REAL["b"][:4], rtol=5e-3) and abs(numbers["b"][4] - 0.11) < 0.05 and got["b"].rms_px < 0.11
    assert got["few"].fx is None and got["few"].n_views == 2 and got["a"].n_views == 8


def test_rotation_vectors_come_back():
    rng = np.random.default_rng(1)
    for w in [np.zeros(3), np.array([np.pi - 1e-6, 0, 0]), *rng.normal(0, 1, (20, 3))]:
        back = lens.rotation_vector(lens.rotation(w))
        assert np.allclose(lens.rotation(back), lens.rotation(w), atol=1e-9) and np.linalg.norm(back) <= np.pi + 1e-9


def test_nothing_to_calibrate(spark):
    df = spark.createDataFrame([], "cam string, view int, x double, y double, u double, v double")
    assert lens.refined_intrinsics(df, "cam", "view").count() == 0


@pytest.mark.parametrize("fixed", [None, 1.3])
def test_simplexes_agree_with_the_closing_grid(spark, fixed):
    import math

    from kerbside.config import CAMERA
    from kerbside.operators import calibration

    rng, rows = np.random.default_rng(3), []
    for _ in range(400):
        z, t = rng.uniform(4, 30), math.radians(-2.5)
        c, s = math.cos(t), math.sin(t)
        depth, below = 1.3 * s + z * c, 1.3 * c - z * s
        rows.append((CAMERA.centre[1] + CAMERA.focal[1] * below / depth, CAMERA.focal[1] * 0.7 / depth * math.exp(rng.normal(0, 0.03)), 0.7))
    samples = spark.createDataFrame([tuple(map(float, r)) for r in rows], "v_bottom double, h_px double, height_m double")
    made = calibration.fit_pose_by_simplex(samples, CAMERA, fixed_height=fixed)
    grid = calibration.fit_pose(samples, CAMERA, fixed_height=fixed, rounds=9)
    assert made.loss <= grid.loss + 1e-7
    assert abs(made.pose.pitch_deg - grid.pose.pitch_deg) < (0.01 if fixed else 0.05) and abs(made.pose.height_m - grid.pose.height_m) < 1e-2
    with pytest.raises(ValueError):
        calibration.fit_pose_by_simplex(samples.limit(10), CAMERA)
