"""Robust two-view models and board calibration over tables of point pairs, one run of rows per pair of views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kerbside.operators.runs import map_runs

#: Minimal samples are drawn in blocks of TRIALS until one without an outlier is as sure as CERTAINTY, by the best share of
#: inliers so far, or MOST are drawn.  At 70 % outliers eight-point samples need about 105 000, four-point ones 900.
TRIALS, CERTAINTY, MOST = 1000, 0.999, 1_000_000


def _best_inliers(n: int, k: int, seed: int, judge):
    """The largest set of inliers of random samples of ``k`` of ``n`` rows; ``judge`` gives a line of inliers for each sample."""
    import numpy as np

    rng, best, drawn, needed = np.random.default_rng(seed), np.zeros(n, bool), 0, MOST
    while drawn < min(needed, MOST):
        near = judge(_samples(rng, n, k))
        drawn += TRIALS
        if (top := near[near.sum(1).argmax()]).sum() > best.sum():
            best = top
        clean = (best.sum() / n) ** k
        needed = np.log(1 - CERTAINTY) / np.log1p(-clean) if 0 < clean < 1 else 0 if clean else MOST
    return best


def _samples(rng, n: int, k: int):
    """TRIALS x k row numbers, distinct within a line."""
    import numpy as np

    if n < 64:
        return rng.random((TRIALS, n)).argsort(1)[:, :k]
    out = rng.integers(0, n, (TRIALS, k))
    while len(again := np.flatnonzero((np.diff(np.sort(out, 1), axis=1) == 0).any(1))):
        out[again] = rng.integers(0, n, (len(again), k))
    return out


def _scaled(p):
    """Points about their mean at a mean distance of sqrt 2, and the 3 x 3 that does it."""
    import numpy as np

    mid = p.mean(0)
    s = np.sqrt(2) / max(np.hypot(*(p - mid).T).mean(), 1e-12)
    return (p - mid) * s, np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])


def _null_vectors(rows):
    import numpy as np

    return np.linalg.svd(rows)[2][..., -1, :].reshape(*rows.shape[:-2], 3, 3)


def _homography(a, b):
    """Batched direct linear solutions, a and b of ... x n x 2."""
    import numpy as np

    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    first = np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], -1)
    second = np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], -1)
    return _null_vectors(np.concatenate([first, second], -2))


def _moved(h, a):
    import numpy as np

    p = np.concatenate([a, np.ones((len(a), 1))], 1) @ np.swapaxes(h, -1, -2)
    return p[..., :2] / np.where(np.abs(p[..., 2:]) < 1e-12, 1e-12, p[..., 2:])


def fit_homography(a, b, limit: float = 3.0, seed: int = 0):
    """(3 x 3 with a last entry of 1, inlier mask) that maps points ``a`` to ``b`` within ``limit``; (None, mask) if there is none."""
    import numpy as np

    if len(a) < 4:
        return None, np.zeros(len(a), bool)
    (sa, ta), (sb, tb) = _scaled(a), _scaled(b)
    unscale = lambda h: np.linalg.inv(tb) @ h @ ta

    def judge(pick):
        off = _moved(unscale(_homography(sa[pick], sb[pick])), a) - b
        return np.hypot(off[..., 0], off[..., 1]) <= limit

    inlier = _best_inliers(len(a), 4, seed, judge)
    if inlier.sum() < 4:
        return None, inlier
    h = unscale(_homography(sa[inlier], sb[inlier]))
    return (None if abs(h[2, 2]) < 1e-12 else h / h[2, 2]), inlier


def _essential(a, b):
    """Batched eight-point solutions with two equal singular values and a third of 0."""
    import numpy as np

    rows = (np.concatenate([b, np.ones_like(b[..., :1])], -1)[..., :, None] * np.concatenate([a, np.ones_like(a[..., :1])], -1)[..., None, :]).reshape(*a.shape[:-1], 9)
    u, _, vt = np.linalg.svd(_null_vectors(rows))
    return (u * np.array([1.0, 1.0, 0.0])) @ vt


def _sampson(e, a, b):
    """Squared first-order distance of matches to the epipolar constraint."""
    import numpy as np

    x, y = (np.concatenate([p, np.ones((len(p), 1))], 1) for p in (a, b))
    right, left = x @ np.swapaxes(e, -1, -2), y @ e
    return (y * right).sum(-1) ** 2 / np.maximum((right[..., :2] ** 2).sum(-1) + (left[..., :2] ** 2).sum(-1), 1e-18)


def _depths(r, t, a, b):
    """Depth of every match in both views."""
    import numpy as np

    x, y = (np.concatenate([p, np.ones((len(p), 1))], 1) for p in (a, b))
    # y ~ r (z x) + t: cross with y removes the unknown scale
    lhs, rhs = np.cross(y, x @ r.T), -np.cross(y, np.broadcast_to(t, y.shape))
    z = (lhs * rhs).sum(1) / np.maximum((lhs * lhs).sum(1), 1e-18)
    return z, (z[:, None] * (x @ r.T) + t)[:, 2]


def fit_pose(p1, p2, k, limit: float = 1.0, seed: int = 0):
    """(rotation, unit translation, essential, fundamental, inlier mask) from view 1 to view 2, or None.

    ``limit`` is in pixels.  Of the four decompositions the one with most
    matches before both cameras counts.
    """
    import numpy as np

    if len(p1) < 8:
        return None
    back = np.linalg.inv(k)
    a, b = (np.concatenate([p, np.ones((len(p), 1))], 1) @ back.T for p in (p1, p2))
    a, b = a[:, :2], b[:, :2]
    bound = (limit / ((k[0, 0] + k[1, 1]) / 2)) ** 2
    inlier = _best_inliers(len(a), 8, seed, lambda pick: _sampson(_essential(a[pick], b[pick]), a, b) <= bound)
    for _ in range(3):
        if inlier.sum() < 8:
            return None
        e = _essential(a[inlier], b[inlier])
        inlier = _sampson(e, a, b) <= bound
    if inlier.sum() < 8:
        return None
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    ways = [(u @ w @ vt, s * u[:, 2]) for w in (turn, turn.T) for s in (1, -1)]
    r, t = max(ways, key=lambda way: sum((np.minimum(*_depths(*way, a[inlier], b[inlier])) > 0)))
    return r, t, e, back.T @ e @ back, inlier


def homographies(df: DataFrame, pair: str, limit: float = 3.0, seed: int = 0) -> DataFrame:
    """Points (pair, x, y, u, v) to (pair, h, n_inliers, n): row by row entries of the map from (x, y) to (u, v).

    A pair with fewer than four points, or none that agree, has a null ``h``.
    """
    key = df.schema[pair].dataType.simpleString()

    def run(rows):
        import numpy as np

        h, inlier = fit_homography(np.stack([rows["x"], rows["y"]], 1).astype(float), np.stack([rows["u"], rows["v"]], 1).astype(float), limit, seed)
        return {pair: [rows[pair][0]], "h": np.array([None if h is None else h.ravel().tolist(), None], object)[:1], "n_inliers": [int(inlier.sum())], "n": [len(inlier)]}

    return map_runs(df.select(pair, "x", "y", "u", "v"), [pair], ["x", "y", "u", "v"], run, f"`{pair}` {key}, h array<double>, n_inliers bigint, n bigint")


def relative_poses(df: DataFrame, pair: str, k, limit: float = 1.0, seed: int = 0) -> DataFrame:
    """Matches (pair, u1, v1, u2, v2) to (pair, r, t, e, f, n_inliers, n); nulls where eight matches do not agree."""
    import numpy as np

    key, k = df.schema[pair].dataType.simpleString(), np.asarray(k, float)

    def run(rows):
        p1, p2 = (np.stack([rows[f"u{i}"], rows[f"v{i}"]], 1).astype(float) for i in (1, 2))
        found = fit_pose(p1, p2, k, limit, seed)
        out = {pair: [rows[pair][0]], "n_inliers": [int(found[4].sum()) if found else 0], "n": [len(p1)]}
        for i, name in enumerate("rtef"):
            out[name] = np.array([found[i].ravel().tolist() if found else None, None], object)[:1]
        return out

    points = ["u1", "v1", "u2", "v2"]
    return map_runs(df.select(pair, *points), [pair], points, run, f"`{pair}` {key}, n_inliers bigint, n bigint, r array<double>, t array<double>, e array<double>, f array<double>")


def board_intrinsics(df: DataFrame, camera: str, view: str, least_views: int = 5) -> DataFrame:
    """Corners (camera, view, x, y on the board, u, v in pixels) to (camera, fx, fy, cx, cy, n_views).

    The closed-form solution from the views' homographies, without lens
    distortion.  Nulls where a camera has fewer than ``least_views`` usable views.
    """
    key = df.schema[camera].dataType.simpleString()
    views = homographies(df.selectExpr(f"struct(`{camera}` as c, `{view}` as v) as _s", "x", "y", "u", "v").selectExpr("to_json(_s) as _view", "_s.c as _c", "x", "y", "u", "v").select("_view", "x", "y", "u", "v"), "_view")
    names = df.selectExpr(f"to_json(struct(`{camera}` as c, `{view}` as v)) as _view", f"`{camera}`").distinct()
    usable = views.where("h is not null").join(names, "_view").select(camera, "_view", "h")

    def run(rows):
        import numpy as np

        h = np.stack([np.asarray(x, float).reshape(3, 3) for x in rows["h"]])
        out = {camera: [rows[camera][0]], "n_views": [len(h)]} | {c: [float("nan")] for c in ("fx", "fy", "cx", "cy")}
        if len(h) >= least_views:
            # pixels are scaled to about one, or the equations are hopelessly uneven
            s = 1 / max(np.abs(h[:, :2, 2]).max(), 1.0)
            h = np.diag([s, s, 1.0]) @ h

            def v(i, j):
                a, b = h[:, :, i], h[:, :, j]
                return np.stack([a[:, 0] * b[:, 0], a[:, 0] * b[:, 1] + a[:, 1] * b[:, 0], a[:, 1] * b[:, 1], a[:, 2] * b[:, 0] + a[:, 0] * b[:, 2], a[:, 2] * b[:, 1] + a[:, 1] * b[:, 2], a[:, 2] * b[:, 2]], 1)

            equations = np.concatenate([v(0, 1), v(0, 0) - v(1, 1)])
            b11, b12, b22, b13, b23, b33 = np.linalg.svd(equations / np.linalg.norm(equations, axis=1, keepdims=True))[2][-1]
            conic = np.array([[b11, b12, b13], [b12, b22, b23], [b13, b23, b33]])
            conic = conic if b11 > 0 else -conic
            if (np.linalg.eigvalsh(conic) > 0).all():
                k = np.linalg.inv(np.linalg.cholesky(conic).T)
                k = k / k[2, 2]
                out |= {"fx": [k[0, 0] / s], "fy": [k[1, 1] / s], "cx": [k[0, 2] / s], "cy": [k[1, 2] / s]}
        return out

    made = map_runs(usable, [camera], ["_view"], run, f"`{camera}` {key}, n_views bigint, fx double, fy double, cx double, cy double")
    return made.selectExpr(f"`{camera}`", *[f"nullif({c}, double('NaN')) as {c}" for c in ("fx", "fy", "cx", "cy")], "n_views")
