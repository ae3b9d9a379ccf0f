"""Two-view geometry over tables of matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geometry as geo
from kerbside.operators.quantiles import percentiles


def design_table(spark, focal: float, baseline: float, ranges: Sequence[float] = (2, 5, 10, 20, 30, 50), sigma: float = 0.25) -> DataFrame:
    """range_m, disparity_px, sigma_m and relative_error at some ranges."""
    return design(spark.createDataFrame([(float(r),) for r in ranges], "range_m double"), focal, baseline, sigma)


def design(rows: DataFrame, focal: float, baseline: float, sigma: float = 0.25) -> DataFrame:
    """Add disparity_px, sigma_m and relative_error to rows with a ``range_m``."""
    z = F.col("range_m")
    made = rows.withColumns({"disparity_px": geo.depth_to_disparity(z, focal, baseline), "sigma_m": geo.depth_sigma(z, focal, baseline, sigma)})
    return made.withColumn("relative_error", F.col("sigma_m") / z)


def triangulate(df: DataFrame, k, r, t, points: Sequence[str] = ("u1", "v1", "u2", "v2")) -> DataFrame:
    """Add X, Y, Z in the first camera's frame, up to the scale of ``t``, by the linear method, batch by batch."""
    import numpy as np

    k, r, t = (np.asarray(x, float) for x in (k, r, t))
    p1 = k @ np.hstack([np.eye(3), np.zeros((3, 1))])
    p2 = k @ np.hstack([r, t.reshape(3, 1)])

    @F.pandas_udf("X double, Y double, Z double")
    def solve(u1, v1, u2, v2):
        import pandas as pd

        u1, v1, u2, v2 = (x.to_numpy(float)[:, None] for x in (u1, v1, u2, v2))
        a = np.stack([u1 * p1[2] - p1[0], v1 * p1[2] - p1[1], u2 * p2[2] - p2[0], v2 * p2[2] - p2[1]], 1)
        x = np.linalg.svd(a)[2][:, -1] if len(a) else np.zeros((0, 4))
        w = np.where(np.abs(x[:, 3:]) < 1e-12, 1e-12, x[:, 3:])
        return pd.DataFrame(x[:, :3] / w, columns=["X", "Y", "Z"])

    return df.withColumn("_p", solve(*points)).select("*", "_p.*").drop("_p")


def valid_depths(df: DataFrame, z: str = "Z", scale: float = 1.0) -> DataFrame:
    """Rows with a finite positive depth, scaled."""
    return df.where(~F.isnan(z) & (F.col(z) > 0) & (F.col(z) < float("inf"))).withColumn(z, F.col(z) * scale)


def median_epipolar_error(df: DataFrame, f, points: Sequence[str] = ("u1", "v1", "u2", "v2")) -> DataFrame:
    error = geo.symmetric_epipolar_error(f, *[F.col(p) for p in points])
    made = percentiles(df, [], error, [0.5], aggregates=[F.count("*").alias("_all")])
    return made.select(F.col("_all").alias("n"), F.get("q", F.lit(0)).alias("median_error_px"))


def anchored(df: DataFrame, frame: str, depth: str, distance: str, tie: str) -> DataFrame:
    """Add ``anchor_scale`` of each frame, from its box with the smallest monocular range, and each box's ``ratio``."""
    best = df.where(F.col(distance).isNotNull() & (F.col(depth) > 0)).groupBy(frame).agg(
        F.min(F.struct(F.col(distance).alias("d"), F.col(tie).alias("t"), F.col(depth).alias("z"))).alias("_a")
    )
    scale = best.select(frame, geo.scale_from_height(F.col("_a.z"), F.col("_a.d")).alias("anchor_scale"))
    return df.join(scale, frame).withColumn("ratio", F.when(F.col(distance) > 0, F.col(depth) * F.col("anchor_scale") / F.col(distance)))
