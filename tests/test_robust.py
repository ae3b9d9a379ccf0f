"""Robust fits recover planted models; fetching caches, retries and resumes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import robust, statistics
from kerbside.sources import fetch

K = np.array([[800.0, 0, 320], [0, 820, 240], [0, 0, 1]])


def turned(x, y, z):
    cx, sx, cy, sy, cz, sz = (f(a) for a in (x, y, z) for f in (np.cos, np.sin))
    return np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])


def seen(points, r=np.eye(3), t=np.zeros(3)):
    p = (points @ r.T + t) @ K.T
    return p[:, :2] / p[:, 2:]


def test_homography_and_pose(spark):
    rng = np.random.default_rng(0)
    h = np.array([[1.1, 0.02, 30], [-0.03, 0.95, -12], [1e-4, 2e-5, 1]])
    a = rng.uniform(0, 600, (120, 2))
    b = robust._moved(h, a)
    b[:30] += rng.uniform(20, 90, (30, 2))
    rows = [(1, *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)] + [(2, 0.0, 0.0, 1.0, 1.0)]
    got = {r.pair: r for r in robust.homographies(spark.createDataFrame(rows, "pair int, x double, y double, u double, v double"), "pair").collect()}
    assert np.allclose(np.reshape(got[1].h, (3, 3)), h, rtol=1e-5, atol=1e-7) and got[1].n_inliers == 90
    assert got[2].h is None and got[2].n == 1

    world = np.column_stack([rng.uniform(-4, 4, 150), rng.uniform(-3, 3, 150), rng.uniform(5, 20, 150)])
    r, t = turned(0.03, -0.06, 0.02), np.array([0.6, 0.1, 0.79])
    p1, p2 = seen(world), seen(world, r, t)
    p2[:40] += rng.uniform(15, 80, (40, 2))
    rows = [("m", *map(float, (*p, *q))) for p, q in zip(p1, p2, strict=True)] + [("few", 0.0, 0.0, 1.0, 1.0)] * 3
    got = {x.pair: x for x in robust.relative_poses(spark.createDataFrame(rows, "pair string, u1 double, v1 double, u2 double, v2 double"), "pair", K).collect()}
    # a wrong match may lie within a pixel of its line by chance and takes part in the last fit
    assert np.allclose(np.reshape(got["m"].r, (3, 3)), r, atol=1e-3) and np.allclose(got["m"].t, t / np.linalg.norm(t), atol=1e-2)
    assert 110 <= got["m"].n_inliers <= 120 and got["few"].r is None and got["few"].n_inliers == 0


def test_board_intrinsics(spark):
    x, y = (g.ravel() * 0.025 for g in np.meshgrid(np.arange(9.0), np.arange(6.0)))
    board, rows = np.column_stack([x, y, np.zeros(54)]), []
    for v in range(6):
        p = seen(board, turned(0.3 * np.cos(v), 0.35 * np.sin(v), 0.1 * v), np.array([-0.1 + 0.01 * v, -0.06, 0.5 + 0.03 * v]))
        rows += [("c", v, *map(float, c)) for c in np.column_stack([x, y, p])]
        rows += [("few", v, *map(float, c)) for c in np.column_stack([x, y, p])] if v < 2 else []
    got = {r.cam: r for r in robust.board_intrinsics(spark.createDataFrame(rows, "cam string, view int, x double, y double, u double, v double"), "cam", "view").collect()}
    assert np.allclose([got["c"].fx, got["c"].fy, got["c"].cx, got["c"].cy], [800, 820, 320, 240], rtol=1e-3)
    assert got["few"].fx is None and got["few"].n_views == 2


def test_sparsity(spark):
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, -3, 1, 2, -1, 5, 4, -6])], "i int, w double")
    thin = statistics.without_smallest(rows, "w", 0.5, ["i"])
    assert {r.i: r.w for r in thin.collect()} == {0: 0, 1: -3, 2: 0, 3: 0, 4: 0, 5: 5, 6: 4, 7: -6}
    assert statistics.sparsity(thin, "w").first().sparsity == 0.5


def test_fetch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def flaky(url, start=None, end=None):
        seen_before = log / f"{url}-{start}"
        if url == "bad" or not seen_before.exists():
            seen_before.write_text("x")
            raise OSError("no")
        return b"0123456789"[start : end + 1] if start is not None else url.encode()

    rows = spark.createDataFrame([("a", "a.jpg"), ("bad", "b.jpg")], "url string, name string")
    got = {r.name: r.body for r in fetch.fetched(rows, "url", "name", str(tmp_path / "cache"), get=flaky).collect()}
    assert bytes(got["a.jpg"]) == b"a" and got["b.jpg"] is None and (tmp_path / "cache" / "a.jpg").read_bytes() == b"a"
    with pytest.raises(Exception, match="not a name inside"):
        fetch.fetched(rows.withColumn("name", F.lit("../x")), "url", "name", str(tmp_path), get=flaky).collect()

    plan = fetch.byte_ranges(spark, 10, 4)
    assert [tuple(r) for r in plan.orderBy("chunk").collect()] == [(0, 0, 3), (1, 4, 7), (2, 8, 9)]
    parts = tmp_path / "parts"
    assert all(r.done for r in fetch.fetch_ranges(plan, "f", str(parts), longest_wait=0.01, get=flaky).collect())
    assert b"".join(p.read_bytes() for p in sorted(parts.iterdir())) == b"0123456789"
    assert fetch.byte_ranges(spark, 10, 4, plan.where("chunk < 2")).count() == 1


def test_seventy_percent_outliers():
    rng = np.random.default_rng(7)
    h = np.array([[0.9, 0.05, 12], [0.02, 1.05, 8], [-5e-5, 8e-5, 1]])
    for seed in range(5):
        a = rng.uniform(0, 600, (200, 2))
        b = robust._moved(h, a)
        b[:140] = rng.uniform(0, 600, (140, 2))
        found, inlier = robust.fit_homography(a, b, seed=seed)
        assert np.allclose(found, h, rtol=1e-4, atol=1e-6) and inlier[140:].all() and inlier.sum() <= 65
    world = np.column_stack([rng.uniform(-4, 4, 200), rng.uniform(-3, 3, 200), rng.uniform(5, 20, 200)])
    r, t = turned(0.03, -0.06, 0.02), np.array([0.6, 0.1, 0.79])
    p1, p2 = seen(world), seen(world, r, t)
    p2[:140] += rng.choice([-1, 1], (140, 2)) * rng.uniform(15, 200, (140, 2))
    got = robust.fit_pose(p1, p2, K, limit=0.5)
    assert got is not None and np.allclose(got[0], r, atol=5e-3) and got[4][140:].mean() > 0.95


def test_few_draws_where_all_agree(monkeypatch):
    drawn, plain = [], robust._samples
    monkeypatch.setattr(robust, "_samples", lambda *a: drawn.append(1) or plain(*a))
    a = np.random.default_rng(1).uniform(0, 100, (40, 2))
    robust.fit_homography(a, a + 3.0)
    assert len(drawn) == 1


def test_rain_is_streaks_under_a_veil():
    from kerbside.operators import pixels

    dark = np.zeros((240, 320, 3), np.uint8)
    made = [pixels.rain(dark, level, np.random.default_rng(4)).astype(float)[:, :, 0] for level in range(5)]
    assert all(b.mean() > a.mean() for a, b in zip(made, made[1:], strict=False))
    for level, img in enumerate(made):
        assert img.min() == int(255 * pixels.RAIN["haze"][level])  # where no drop is, there is only the veil
        down, aside = np.abs(np.diff(img, axis=0)).mean(), np.abs(np.diff(img, axis=1)).mean()
        assert down < aside  # streaks are long and upright
    assert (pixels.rain(dark, 2, np.random.default_rng(4)) == pixels.rain(dark, 2, np.random.default_rng(4))).all()
    line = pixels.path(9, 0.0)
    assert (line[4] == 1).all() and line.sum() == 9
