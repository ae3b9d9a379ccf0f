"""Board calibration with lens distortion, refined over tables of corners.

The reprojection error of all corners is lowered by damped Gauss-Newton steps.
Its normal equations are sums over rows: each view adds up those of its corners
and eliminates its own pose, the views of a camera are summed, and only nine
equations a camera reach the driver.  Poses of views stay in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.robust import board_intrinsics, homographies
from kerbside.operators.runs import map_runs
from kerbside.storage import cut

#: Focal lengths, centre, radial terms of the second, fourth and sixth degree, and two tangential ones.
NUMBERS = ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "p1", "p2")


def rotation(w):
    """3 x 3 of a rotation vector."""
    import numpy as np

    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    a, b = (1.0, 0.5) if angle < 1e-8 else (np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2)
    return np.eye(3) + a * k + b * k @ k


def rotation_vector(r):
    """The vector whose rotation is ``r``; its quaternion is the heaviest eigenvector of a symmetric 4 x 4."""
    import numpy as np

    d, o = np.diag(r), r + r.T
    skew = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    m = np.empty((4, 4))
    m[:3, :3] = o - np.diag(np.diag(o)) + np.diag(2 * d - d.sum())
    m[3, :3] = m[:3, 3] = skew
    m[3, 3] = d.sum()
    q = np.linalg.eigh(m)[1][:, -1]
    q = q if q[3] >= 0 else -q
    half = np.linalg.norm(q[:3])
    return q[:3] * (2.0 if half < 1e-12 else 2 * np.arctan2(half, q[3]) / half)


def projected(lens, pose, x, y):
    """Pixels of board points (x, y, 0) seen from ``pose`` (rotation vector, shift) through ``lens`` (see NUMBERS)."""
    import numpy as np

    fx, fy, cx, cy, k1, k2, k3, p1, p2 = lens
    r = rotation(pose[:3])
    at = np.outer(x, r[:, 0]) + np.outer(y, r[:, 1]) + pose[3:]
    a, b = at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]
    s = a * a + b * b
    radial = 1 + s * (k1 + s * (k2 + s * k3))
    u = a * radial + 2 * p1 * a * b + p2 * (s + 2 * a * a)
    v = b * radial + p1 * (s + 2 * b * b) + 2 * p2 * a * b
    return np.stack([fx * u + cx, fy * v + cy], 1)


def _view_equations(lens, pose, x, y, u, v, damping):
    """Of one view: what it adds to the camera's equations and right side, the squared error, and how its pose follows the camera's step."""
    import numpy as np

    start = np.concatenate([lens, pose])
    scale = np.maximum(np.abs(start), np.repeat([1.0, 1e-2, 1e-2], [4, 5, 6])) * 1e-6
    base = projected(lens, pose, x, y)
    columns = []
    for i, h in enumerate(scale):
        step = np.zeros(15)
        step[i] = h
        ahead, behind = start + step, start - step
        columns.append(((projected(ahead[:9], ahead[9:], x, y) - projected(behind[:9], behind[9:], x, y)) / (2 * h)).ravel())
    j, off = np.stack(columns, 1), (np.stack([u, v], 1) - base).ravel()
    whole, side = j.T @ j, j.T @ off
    a, b, c = whole[:9, :9], whole[:9, 9:], whole[9:, 9:] + damping * np.diag(np.diag(whole[9:, 9:]) + 1e-12)
    solved = np.linalg.solve(c, np.concatenate([b.T, side[9:, None]], 1))
    return a - b @ solved[:, :9], side[:9] - b @ solved[:, 9], np.diag(a), float(off @ off), solved


def _first_pose(h, k):
    """Pose of a view from the homography of its board."""
    import numpy as np

    m = np.linalg.solve(k, h)
    m = m * 2 / (np.linalg.norm(m[:, 0]) + np.linalg.norm(m[:, 1]))
    m = m if m[2, 2] > 0 else -m
    p, _, q = np.linalg.svd(np.column_stack([m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])]))
    r = p @ np.diag([1.0, 1.0, np.linalg.det(p @ q)]) @ q
    return np.concatenate([rotation_vector(r), m[:, 2]])


def refined_intrinsics(df: DataFrame, camera: str, view: str, least_views: int = 5, steps: int = 30, tolerance: float = 1e-8) -> DataFrame:
    """Corners (camera, view, x, y on the board, u, v in pixels) to (camera, the nine NUMBERS, rms_px, n_views).

    Starts from the closed form without distortion.  Every camera is damped by
    itself: a step that does not lower its error is taken back and tried again
    with more damping.  It ends when no camera's error falls by more than
    ``tolerance`` of itself, unless it is below a millionth of a pixel, or after ``steps`` steps.  A camera without a start
    has nulls.  One row per camera reaches the driver at a time; a view's corners are one run of rows.
    """
    import numpy as np

    known = df.select(F.col(camera).alias("cam"), F.col(view).alias("view"), *[F.col(c).cast("double").alias(c) for c in "xyuv"]).where("cam is not null and view is not null and x + y + u + v is not null")
    rows = cut(known.withColumn("key", F.to_json(F.struct("cam", "view"))))
    first = {r["cam"]: r for r in board_intrinsics(rows, "cam", "view", least_views).collect()}
    lenses = {k: np.array([r["fx"], r["fy"], r["cx"], r["cy"], 0, 0, 0, 0, 0], float) for k, r in first.items() if r["fx"] is not None}
    kind = rows.schema["cam"].dataType.simpleString()

    def lens_table(values: dict, damping: dict) -> DataFrame:
        made = [(k, v.tolist(), float(damping[k])) for k, v in values.items()]
        # a row per camera
        return F.broadcast(df.sparkSession.createDataFrame(made, f"cam {kind}, lens array<double>, damping double"))

    def begin(r):
        lens = np.asarray(r["lens"][0], float)
        k = np.array([[lens[0], 0, lens[2]], [0, lens[1], lens[3]], [0, 0, 1.0]])
        return {"key": [r["key"][0]], "pose": np.array([_first_pose(np.asarray(r["h"][0], float).reshape(3, 3), k).tolist(), None], object)[:1]}

    damping = dict.fromkeys(lenses, 1e-3)
    found = homographies(rows.select("key", "x", "y", "u", "v"), "key").where("h is not null").select("key", "h")
    cams = rows.select("key", "cam").distinct()
    poses = cut(map_runs(found.join(cams, "key").join(lens_table(lenses, damping), "cam"), ["key"], [], begin, "key string, pose array<double>"))

    def equations(r):
        lens, pose = (np.asarray(r[c][0], float) for c in ("lens", "pose"))
        a, g, d, error, solved = _view_equations(lens, pose, r["x"], r["y"], r["u"], r["v"], float(r["damping"][0]))
        packed = np.concatenate([a.ravel(), g, d, [error, len(r["x"])]])
        return {"cam": [r["cam"][0]], "key": [r["key"][0]], "sums": np.array([packed.tolist(), None], object)[:1], "solved": np.array([solved.ravel().tolist(), None], object)[:1], "old": np.array([pose.tolist(), None], object)[:1]}

    def summed(at: dict, poses_: DataFrame):
        """The table of views, and per camera the sums of their equations."""
        views = rows.join(poses_, "key").join(lens_table(at, damping), "cam")
        views = cut(map_runs(views, ["key"], ["x", "y", "u", "v"], equations, f"cam {kind}, key string, sums array<double>, solved array<double>, old array<double>"))
        parts = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(101)]
        return views, {r["cam"]: (np.array([r[f"s{i}"] for i in range(101)]), r["n"]) for r in views.groupBy("cam").agg(F.count("*").alias("n"), *parts).collect()}

    views, sums = summed(lenses, poses) if lenses else (None, {})
    for _ in range(steps if lenses else 0):
        moves = {}
        for k, (s, _) in sums.items():
            a, g, d = s[:81].reshape(9, 9), s[81:90], s[90:99]
            moves[k] = np.linalg.lstsq(a + damping[k] * np.diag(d + 1e-12), g, rcond=None)[0]
        table = F.broadcast(df.sparkSession.createDataFrame([(k, m.tolist()) for k, m in moves.items()], f"cam {kind}, move array<double>"))

        def follow(r):
            solved, old, move = np.asarray(r["solved"][0], float).reshape(6, 10), np.asarray(r["old"][0], float), np.asarray(r["move"][0], float)
            return {"key": [r["key"][0]], "pose": np.array([(old + solved[:, 9] - solved[:, :9] @ move).tolist(), None], object)[:1]}

        tried = {k: lenses[k] + moves[k] for k in lenses}
        tried_poses = cut(map_runs(views.join(table, "cam"), ["key"], [], follow, "key string, pose array<double>"))
        new_views, new_sums = summed(tried, tried_poses)
        better = {k for k in lenses if np.isfinite(new_sums[k][0][99]) and new_sums[k][0][99] < sums[k][0][99]}
        gain = max(((sums[k][0][99] - new_sums[k][0][99]) / sums[k][0][99] for k in better if sums[k][0][99] > 1e-12 * sums[k][0][100]), default=0.0)
        tired = all(damping[k] > 1e8 for k in lenses if k not in better) and gain <= tolerance
        damping = {k: damping[k] / 10 if k in better else damping[k] * 10 for k in lenses}
        if better == set(lenses):
            lenses, views, sums = tried, new_views, new_sums
        else:
            # a camera whose step failed keeps its place, but its equations need the new damping
            lenses = {k: tried[k] if k in better else lenses[k] for k in lenses}
            chosen = df.sparkSession.createDataFrame([(k,) for k in better], f"cam {kind}")
            old = views.join(F.broadcast(chosen), "cam", "left_anti").select("key", F.col("old").alias("pose"))
            kept = new_views.join(F.broadcast(chosen), "cam").select("key", F.col("old").alias("pose"))
            views, sums = summed(lenses, cut(old.unionByName(kept)))
        if tired or better and gain <= tolerance:
            break
    made = [(k, int(first[k]["n_views"]), *([None] * 10 if k not in lenses else [*map(float, lenses[k]), float(np.sqrt(sums[k][0][99] / max(sums[k][0][100], 1)))])) for k in first]
    out = df.sparkSession.createDataFrame(made, f"cam {kind}, n_views bigint, " + ", ".join(f"{c} double" for c in (*NUMBERS, "rms_px")))
    return out.select(F.col("cam").alias(camera), *NUMBERS, "rms_px", "n_views")
