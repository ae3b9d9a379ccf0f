"""Ranging, geometry, calibration and stereo over the fixture boxes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.config import CAMERA, PRIORS, pinhole
from kerbside.functions import boxes as bx
from kerbside.functions import geometry as geo
from kerbside.functions.text import decimals, frame_label, pretty
from kerbside.operators import calibration, ranging, statistics, stereo
from kerbside.plans.fixtures import BOXES_SQL, Book, boxes, r6, read

book = Book()
_C, _S = math.cos(CAMERA.pose.pitch), math.sin(CAMERA.pose.pitch)
_PRIORS = ", ".join(
    f"('{p.name}', {p.height_m}::DOUBLE, {p.height_sigma_m}::DOUBLE, {str(p.ground_contact).lower()}, {p.mount_height_m}::DOUBLE, {p.mount_height_sigma_m}::DOUBLE)" for p in PRIORS
)
RANGED_SQL = f"""{BOXES_SQL}, p(name, hm, hs, ground, mount, ms) AS (VALUES {_PRIORS}),
q AS (SELECT b.*, p.*, y2 - y1 AS hpx, (y2 - {CAMERA.centre[1]}) / {CAMERA.focal[1]} AS vn, {CAMERA.pose.height_m} - mount AS plane FROM b JOIN p ON class_name = name),
g AS (SELECT *, {_C!r}::DOUBLE - vn * {_S!r}::DOUBLE AS n_, vn * {_C!r}::DOUBLE + {_S!r}::DOUBLE AS d_ FROM q),
fw AS (SELECT *, CASE WHEN abs(d_) >= 1e-9 AND plane * n_ * d_ > 0 THEN plane * n_ / d_ END AS fwd FROM g),
fl AS (SELECT *, CASE WHEN hpx < 8 THEN 'size:box_too_small' WHEN y1 <= 4 OR y2 >= 1076 THEN 'size:truncated' END AS fs,
    CASE WHEN NOT ground AND mount <= 0 THEN 'plane:not_applicable' WHEN y2 >= 1076 THEN 'plane:base_cut_off' WHEN abs(plane) < 0.05 THEN 'plane:degenerate_height'
         WHEN fwd IS NULL THEN 'plane:above_horizon' WHEN abs(n_) < 1e-9 OR abs(d_) < 1e-9 THEN 'plane:degenerate'
         WHEN plane * {_S!r}::DOUBLE + fwd * {_C!r}::DOUBLE <= 0 THEN 'plane:behind_camera' END AS fp FROM fw),
cu AS (SELECT *, CASE WHEN fs IS NULL THEN {CAMERA.focal[1]} * hm / hpx END AS zs, CASE WHEN fs IS NULL THEN sqrt((sqrt(2.0) * 2.5 / hpx) ** 2 + (hs / hm) ** 2) END AS rs,
    CASE WHEN fp IS NULL THEN plane * {_S!r}::DOUBLE + fwd * {_C!r}::DOUBLE END AS zp,
    CASE WHEN fp IS NULL THEN sqrt(((-({_S!r}::DOUBLE) / n_ - {_C!r}::DOUBLE / d_) * 2.5 / {CAMERA.focal[1]}) ** 2 + (sqrt(0.15 ** 2 + ms ** 2) / plane) ** 2
        + (((-({_S!r}::DOUBLE) - vn * {_C!r}::DOUBLE) / n_ - n_ / d_) * radians(1.5)) ** 2) END AS rp FROM fl),
z AS (SELECT *, CASE WHEN zs IS NOT NULL AND zp IS NOT NULL THEN 'fused' WHEN zs IS NOT NULL THEN 'size' WHEN zp IS NOT NULL THEN 'plane' ELSE 'none' END AS method,
    CASE WHEN zs IS NOT NULL AND zp IS NOT NULL THEN exp((ln(zs) / rs ** 2 + ln(zp) / rp ** 2) / (1 / rs ** 2 + 1 / rp ** 2)) ELSE coalesce(zs, zp) END AS z,
    CASE WHEN zs IS NOT NULL AND zp IS NOT NULL THEN sqrt(1 / (1 / rs ** 2 + 1 / rp ** 2)) ELSE coalesce(rs, rp) END AS rel,
    ((x1 + x2) / 2 - {CAMERA.centre[0]}) / {CAMERA.focal[0]} AS ru, (least(y2, 1079.0::DOUBLE) - {CAMERA.centre[1]}) / {CAMERA.focal[1]} AS rv FROM cu),
ranged AS (SELECT *, z * sqrt(ru ** 2 + rv ** 2 + 1) AS dist, z * ({_C!r}::DOUBLE - rv * {_S!r}::DOUBLE) AS forward_m, z * ru AS lateral_m,
    zs * sqrt(ru ** 2 + rv ** 2 + 1) AS size_m, zp * sqrt(ru ** 2 + rv ** 2 + 1) AS plane_m,
    CASE WHEN z IS NOT NULL THEN least(greatest(z * sqrt(ru ** 2 + rv ** 2 + 1), 0.3::DOUBLE), 80.0::DOUBLE) END AS distance_m, z * sqrt(ru ** 2 + rv ** 2 + 1) * rel AS sigma_m FROM z)"""


def _ranged(spark: SparkSession, d: str, numbered: bool = True) -> DataFrame:
    return ranging.estimate_ranges(boxes(spark, d, numbered))


@book.add(f"""WITH {RANGED_SQL} SELECT frame, det, class_name, method, method <> 'none' AS valid,
    round(distance_m, 6) + 0.0 AS distance_m, round(sigma_m, 6) + 0.0 AS sigma_m, round(forward_m, 6) + 0.0 AS forward_m, round(lateral_m, 6) + 0.0 AS lateral_m,
    round(size_m, 6) + 0.0 AS size_m, round(size_m * rs, 6) + 0.0 AS size_sigma_m, round(plane_m, 6) + 0.0 AS plane_m, round(plane_m * rp, 6) + 0.0 AS plane_sigma_m FROM ranged""")
def range_boxes(spark, d):
    numbers = ("distance_m", "sigma_m", "forward_m", "lateral_m", "size_m", "size_sigma_m", "plane_m", "plane_sigma_m")
    return _ranged(spark, d).select("frame", "det", "class_name", "method", "valid", *[r6(c).alias(c) for c in numbers])


@book.add(f"""WITH {RANGED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY coalesce(distance_m, 1e9), class_name, x1, y1, x2, y2, score) AS n FROM ranged)
    SELECT frame, class_name, method, round(distance_m, 6) + 0.0 AS distance_m, round(lateral_m, 6) + 0.0 AS lateral_m, score FROM k WHERE n = 1""")
def nearest_obstacle(spark, d):
    best = ranging.nearest(_ranged(spark, d, False), "frame", ["class_name", "method", "distance_m", "lateral_m", "score"], "class_name", "x1", "y1", "x2", "y2", "score")
    return best.select("frame", "class_name", "method", r6("distance_m").alias("distance_m"), r6("lateral_m").alias("lateral_m"), "score")


@book.add(f"""WITH {RANGED_SQL}, f AS (SELECT class_name, unnest(list_filter([fs, fp, CASE WHEN zs / zp > 1.6 OR zp / zs > 1.6 THEN 'cue_disagreement' END,
        CASE WHEN dist > 80 THEN 'range_saturated' END], lambda x: x IS NOT NULL)) AS flag FROM ranged)
    SELECT class_name, flag, count(*) AS n FROM f GROUP BY class_name, flag""")
def range_flags(spark, d):
    # the outer form, as the plain one would filter by the size of the whole flag expression below the join
    rows = _ranged(spark, d, False).select("class_name", F.explode_outer("flags").alias("flag")).where("flag is not null")
    flag = F.when(F.col("flag").startswith("cue_disagreement"), "cue_disagreement").otherwise(F.col("flag"))
    return rows.groupBy("class_name", flag.alias("flag")).agg(F.count("*").alias("n"))


@book.add(f"""WITH {RANGED_SQL} SELECT class_name, coalesce(fp, 'ok') AS gate, count(*) AS n, round(min(zp), 6) + 0.0 AS nearest, round(max(zp), 6) + 0.0 AS farthest FROM ranged GROUP BY ALL""")
def plane_cue_gates(spark, d):
    rows = ranging.estimate_ranges(boxes(spark, d))
    gate = F.coalesce(F.get(F.filter("flags", lambda x: x.startswith("plane:")), F.lit(0)), F.lit("ok"))
    u, v = (F.col("x1") + F.col("x2")) / 2, F.least(F.col("y2"), F.lit(1079.0))
    unit = geo.distance_of(u, v, F.lit(1.0), CAMERA)
    depth = F.col("plane_m") / unit
    return rows.withColumns({"gate": gate, "_z": depth}).groupBy("class_name", "gate").agg(F.count("*").alias("n"), r6(F.min("_z")).alias("nearest"), r6(F.max("_z")).alias("farthest"))


@book.add(f"""WITH {RANGED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY coalesce(distance_m, 1e9), det)::INT AS rank FROM ranged WHERE score > 0.75)
    SELECT frame, rank, det, class_name, round(distance_m, 6) + 0.0 AS distance_m, row_number() OVER (PARTITION BY frame ORDER BY rank DESC)::INT AS draw_order FROM k""")
def pipeline_frame(spark, d):
    from pyspark.sql import Window

    ranked = ranging.nearest_first(_ranged(spark, d).where("score > 0.75"), "frame", "det")
    back = F.row_number().over(Window.partitionBy("frame").orderBy(F.col("rank").desc()))
    return ranked.select("frame", "rank", "det", "class_name", r6("distance_m").alias("distance_m"), back.alias("draw_order"))


@book.add("""WITH c AS (SELECT page_id, 320 + page_id * 131 % 1600 AS width, 240 + page_id * 77 % 1200 AS height, (40 + page_id % 60)::DOUBLE AS hfov, (page_id % 31 - 15)::DOUBLE AS pitch FROM pages),
    k AS (SELECT *, width / 2.0::DOUBLE / tan(radians(hfov) / 2) AS fx FROM c)
    SELECT page_id, round(fx, 6) + 0.0 AS fx, round(degrees(2 * atan(width / 2.0::DOUBLE / fx)), 6) + 0.0 AS hfov, round(height / 2.0::DOUBLE - fx * tan(radians(pitch)), 6) + 0.0 AS horizon,
        round(width // 2 / 2.0::DOUBLE / tan(radians(hfov) / 2), 6) + 0.0 AS half_fx, round(10 * cos(radians(pitch)), 6) + 0.0 AS forward_of_10,
        round(cos(radians(pitch)), 6) + 0.0 AS r11, round(sin(radians(pitch)), 6) + 0.0 AS r12 FROM k""")
def camera_variants(spark, d):
    """A camera for every page, by its number."""
    n = F.col("page_id")
    cams = read(spark, d, "pages").select(n, (320 + n * 131 % 1600).alias("width"), (240 + n * 77 % 1200).alias("height"), (40 + n % 60).cast("double").alias("hfov"), (n % 31 - 15).cast("double").alias("pitch"))
    focal = geo.focal_of_view(F.col("width"), F.col("hfov"))
    _, across, ahead = geo.levelled(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.col("pitch"))
    out = {
        "fx": focal, "hfov": geo.view_of_focal(F.col("width"), focal), "horizon": geo.horizon_of_pitch(F.col("height") / 2, focal, F.col("pitch")),
        "half_fx": geo.focal_of_view(F.floor(F.col("width") / 2), F.col("hfov")), "forward_of_10": geo.depth_to_forward(F.lit(10.0), F.col("pitch")), "r11": across, "r12": -ahead,
    }
    return cams.select("page_id", *[r6(v).alias(k) for k, v in out.items()])


@book.add(f"""WITH {BOXES_SQL}, v AS (SELECT frame, det, y2 AS v, (y2 - 540.0::DOUBLE) / (960.0::DOUBLE / tan(radians(30.0::DOUBLE))) AS den FROM b),
    z AS (SELECT *, CASE WHEN den > 1e-9 THEN least(1.3 / den, 150.0) ELSE 150.0 END AS z FROM v)
    SELECT frame, det, round(z, 6) + 0.0 AS depth_m, round(exp(-0.07 * z), 6) + 0.0 AS transmission, round(degrees(atan((540.0 - v) / 1662.77)), 6) + 0.0 AS horizon_pitch FROM z""")
def row_depth_fog(spark, d):
    """Depth, fog and pitch at the bottom row of every box."""
    cam = pinhole((1920, 1080), 60.0)
    v = F.col("y2")
    depth = F.least(F.coalesce(geo.ground_range(v, F.lit(cam.pose.height_m), cam), F.lit(150.0)), F.lit(150.0))
    return boxes(spark, d, True).select("frame", "det", r6(depth).alias("depth_m"), r6(geo.fog_transmission(depth, 0.07)).alias("transmission"), r6(geo.pitch_from_horizon(v, CAMERA)).alias("horizon_pitch"))


@book.add(f"""WITH {RANGED_SQL} SELECT frame, det, round_even((lateral_m + 10.0) * 12.0, 0)::INT AS px, round_even((40.0 - forward_m) * 12.0, 0)::INT AS py,
        trunc(180 + lateral_m / 10.0 * 180)::INT AS panel_x, trunc(380 - forward_m / 40.0 * 360)::INT AS panel_y
    FROM (SELECT frame, det, round(lateral_m, 6) + 0.0 AS lateral_m, round(forward_m, 6) + 0.0 AS forward_m FROM ranged) WHERE forward_m BETWEEN 0.5 AND 40 AND lateral_m BETWEEN -10 AND 10""")
def bev_visible(spark, d):
    rows = _ranged(spark, d).withColumns({c: r6(c) for c in ("lateral_m", "forward_m")})
    rows = rows.where(geo.on_raster(F.col("lateral_m"), F.col("forward_m")))
    px, py = geo.raster_pixel(F.col("lateral_m"), F.col("forward_m"))
    qx, qy = geo.panel_pixel(F.col("lateral_m"), F.col("forward_m"), 360, 400, 40.0, 10.0)
    return rows.select("frame", "det", px.alias("px"), py.alias("py"), qx.alias("panel_x"), qy.alias("panel_y"))


@book.add(f"""WITH {BOXES_SQL}, g AS (SELECT *, (y2 - {CAMERA.centre[1]}) / {CAMERA.focal[1]} AS vn FROM b),
    k AS (SELECT frame, det, y2, (x1 + x2) / 2 AS u, CASE WHEN vn * {_C!r}::DOUBLE + {_S!r}::DOUBLE > 1e-9 THEN {CAMERA.pose.height_m} * ({_C!r}::DOUBLE - vn * {_S!r}::DOUBLE) / (vn * {_C!r}::DOUBLE + {_S!r}::DOUBLE) END AS z FROM g)
    SELECT frame, det, round(z, 6) + 0.0 AS forward_m,
        round({CAMERA.centre[1]} + {CAMERA.focal[1]} * ({CAMERA.pose.height_m} * {_C!r}::DOUBLE - z * {_S!r}::DOUBLE) / ({CAMERA.pose.height_m} * {_S!r}::DOUBLE + z * {_C!r}::DOUBLE), 6) + 0.0 AS row_back,
        round(({CAMERA.pose.height_m} * {_S!r}::DOUBLE + z * {_C!r}::DOUBLE) * (u - {CAMERA.centre[0]}) / {CAMERA.focal[0]}, 6) + 0.0 AS lateral_m FROM k WHERE z IS NOT NULL""")
def bev_points(spark, d):
    z = geo.ground_range(F.col("y2"), F.lit(CAMERA.pose.height_m), CAMERA)
    rows = boxes(spark, d, True).withColumn("_z", z).where("_z is not null")
    depth = CAMERA.pose.height_m * _S + F.col("_z") * _C
    x, _, forward = geo.backproject((F.col("x1") + F.col("x2")) / 2, F.col("y2"), depth, CAMERA)
    return rows.select("frame", "det", r6(forward).alias("forward_m"), r6(geo.row_of_forward(F.col("_z"), F.lit(CAMERA.pose.height_m), CAMERA)).alias("row_back"), r6(x).alias("lateral_m"))


_F = [[0.0, -0.0004, 0.12], [0.0005, 0.0, -0.31], [-0.11, 0.29, 4.0]]
_LINES = """{b}, m AS (SELECT frame, det, x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM b),
    l AS (SELECT *, -0.0004 * v1 + 0.12 AS a2, 0.0005 * u1 - 0.31 AS b2, -0.11 * u1 + 0.29 * v1 + 4.0 AS c2,
        0.0005 * v2 - 0.11 AS a1, -0.0004 * u2 + 0.29 AS b1, 0.12 * u2 - 0.31 * v2 + 4.0 AS c1 FROM m),
    e AS (SELECT *, 0.5 * (abs(a2 * u2 + b2 * v2 + c2) / sqrt(a2 * a2 + b2 * b2 + 1e-12) + abs(a1 * u1 + b1 * v1 + c1) / sqrt(a1 * a1 + b1 * b1 + 1e-12)) AS err FROM l)""".format(b=BOXES_SQL)


@book.add(f"""WITH {_LINES} SELECT frame, det, round(err, 6) + 0.0 AS error_px, round(a2 / sqrt(a2 * a2 + b2 * b2), 6) + 0.0 AS line_a, round(b2 / sqrt(a2 * a2 + b2 * b2), 6) + 0.0 AS line_b FROM e""")
def epipolar_error(spark, d):
    a, b, _ = geo.epipolar_line(_F, F.col("x1"), F.col("y1"), unit=True)
    error = geo.symmetric_epipolar_error(_F, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return boxes(spark, d, True).select("frame", "det", r6(error).alias("error_px"), r6(a).alias("line_a"), r6(b).alias("line_b"))


@book.add(f"WITH {_LINES} SELECT count(*) AS n, round(median(err), 6) + 0.0 AS median_error_px FROM e")
def epipolar_median(spark, d):
    made = stereo.median_epipolar_error(boxes(spark, d), _F, ("x1", "y1", "x2", "y2"))
    return made.select("n", r6("median_error_px").alias("median_error_px"))


@book.add("""SELECT r AS range_m, round(84.0 / r, 6) + 0.0 AS disparity_px, round(r * r * 0.25 / 84.0, 6) + 0.0 AS sigma_m, round(r * 0.25 / 84.0, 6) + 0.0 AS relative_error,
    round(0.1 * 84.0 / 0.25, 6) + 0.0 AS useful_m FROM (SELECT DISTINCT l_quantity::DOUBLE AS r FROM lineitem WHERE l_quantity > 0)""")
def stereo_table(spark, d):
    """What a pair of cameras can tell at the distances that the lines' quantities name."""
    ranges = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("range_m")).where("range_m > 0").distinct()
    made = stereo.design(ranges, 700.0, 0.12)
    return made.select("range_m", *[r6(c).alias(c) for c in ("disparity_px", "sigma_m", "relative_error")], r6(F.lit(geo.max_useful_range(700.0, 0.12))).alias("useful_m"))


@book.add(f"""WITH {BOXES_SQL} SELECT class_name, count(*) AS n, round(min(z), 6) + 0.0 AS nearest, round(max(z), 6) + 0.0 AS farthest, round(avg(84.0 / z), 6) + 0.0 AS mean_disparity
    FROM (SELECT class_name, CASE WHEN x2 - 960 > 0 THEN 84.0 / (x2 - 960) END AS z FROM b) WHERE z IS NOT NULL GROUP BY class_name""")
def depth_validity(spark, d):
    rows = boxes(spark, d).withColumn("Z", geo.disparity_to_depth(F.col("x2") - 960, 700.0, 0.12))
    rows = stereo.valid_depths(rows).where(bx.finite(F.col("Z")).isNotNull())
    back = geo.depth_to_disparity(F.col("Z"), 700.0, 0.12)
    return rows.groupBy("class_name").agg(F.count("*").alias("n"), r6(F.min("Z")).alias("nearest"), r6(F.max("Z")).alias("farthest"), r6(F.avg(back)).alias("mean_disparity"))


@book.add(f"""WITH {RANGED_SQL}, a AS (SELECT frame, det, class_name, distance_m, 100.0 / hpx AS depth FROM ranged WHERE distance_m IS NOT NULL),
    s AS (SELECT frame, distance_m / depth AS scale FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY distance_m, det, depth) AS n FROM a) WHERE n = 1)
    SELECT a.frame, det, round(scale, 6) + 0.0 AS anchor_scale, round(depth * scale / distance_m, 6) + 0.0 AS ratio FROM a JOIN s USING (frame)""")
def anchor_scale(spark, d):
    rows = _ranged(spark, d).where("distance_m is not null").withColumn("depth", 100.0 / (F.col("y2") - F.col("y1")))
    made = stereo.anchored(rows, "frame", "depth", "distance_m", "det")
    return made.select("frame", "det", r6("anchor_scale").alias("anchor_scale"), r6("ratio").alias("ratio"))


@book.add(f"""WITH {BOXES_SQL} SELECT class_name, count(*) AS n, round(sum(y2 - y1), 6) + 0.0 AS total_h, 1920 AS modal_width, 1080 AS modal_height
    FROM b WHERE y2 - y1 >= 40 AND y2 >= 0.6 * 1080 AND y1 > 6 AND y2 < 1074 AND x1 > 6 AND x2 < 1914 GROUP BY class_name""")
def calibration_gate(spark, d):
    rows = boxes(spark, d).withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    kept = calibration.gate(rows, F.col("width"), F.col("height"), 40.0, 0.6)
    size = calibration.modal_size(kept, "width", "height", "frame")
    made = kept.groupBy("class_name").agg(F.count("*").alias("n"), r6(F.sum(F.col("y2") - F.col("y1"))).alias("total_h"))
    return made.join(F.broadcast(size.select(F.col("width").alias("modal_width"), F.col("height").alias("modal_height"))))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).where("class_name = 'cone' and y2 < 1074")
    return rows.select(F.col("y2").alias("v_bottom"), (F.col("y2") - F.col("y1")).alias("h_px"), F.lit(0.75).alias("height_m"))


_SAMPLES_SQL = f"{BOXES_SQL}, s AS (SELECT y2 AS v_bottom, y2 - y1 AS h_px, 0.75::DOUBLE AS height_m FROM b WHERE class_name = 'cone' AND y2 < 1074)"
_RUNGS_SQL = f"""{_SAMPLES_SQL}, r(step, min_box_px, min_base_frac) AS (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 40.0, 0.0), (2, 60.0, 0.62), (3, 80.0, 0.76), (4, 120.0, 0.83), (5, 160.0, 0.86)),
    k AS (SELECT step, min_box_px, min_base_frac, count(*) AS n, quantile_cont(0.75 * (v_bottom - {CAMERA.centre[1]}) / h_px, [0.25, 0.5, 0.75]) AS q
          FROM s JOIN r ON h_px >= min_box_px AND v_bottom >= min_base_frac * 1080 GROUP BY ALL HAVING count(*) >= 25)"""


@book.add(f"WITH {_RUNGS_SQL} SELECT step, min_box_px, min_base_frac, n, round(q[1], 6) + 0.0 AS q25, round(q[2], 6) + 0.0 AS median, round(q[3], 6) + 0.0 AS q75 FROM k")
def calibration_quantiles(spark, d):
    made = calibration.height_sensitivity(_samples(spark, d), CAMERA)
    return made.select("step", "min_box_px", "min_base_frac", "n", *[r6(c).alias(c) for c in ("q25", "median", "q75")])


@book.add(f"""WITH {_RUNGS_SQL} SELECT round(arg_max(q[2], step), 6) + 0.0 AS height_m,
    (SELECT round(least(greatest(median(0.75 * (v_bottom - {CAMERA.centre[1]}) / h_px), 0.4::DOUBLE), 3.0::DOUBLE), 6) + 0.0 FROM s) AS seed_m FROM k WHERE n >= 300""")
def fit_best_start(spark, d):
    rows = _samples(spark, d)
    height = calibration.last_usable(calibration.height_sensitivity(rows, CAMERA))
    seed = calibration.seed_height(rows, CAMERA).select(r6("height_m").alias("seed_m"))
    return height.select(r6("height_m").alias("height_m")).join(seed)


_LOSS_SQL = f"""{_SAMPLES_SQL}, g(height, pitch_deg) AS (SELECT h, p FROM (VALUES (1.0::DOUBLE), (1.3), (1.6)) a(h), (VALUES (-4.0::DOUBLE), (0.0), (4.0)) b(p)),
    u AS (SELECT height, pitch_deg, h_px, height_m, cos(radians(pitch_deg)) AS c, sin(radians(pitch_deg)) AS si, (v_bottom - {CAMERA.centre[1]}) / {CAMERA.focal[1]} AS vn FROM s, g),
    z AS (SELECT height, pitch_deg, {CAMERA.focal[1]} * height_m / h_px AS zs, height * si + height * (c - vn * si) / nullif(vn * c + si, 0) * c AS zp FROM u),
    l AS (SELECT height, pitch_deg, CASE WHEN zp > 1e-6 THEN abs(ln(zs) - ln(zp)) END AS a FROM z)"""


@book.add(f"WITH {_LOSS_SQL} SELECT height, pitch_deg, round(coalesce(avg(0.5 * least(a, 0.25) ** 2 + 0.25 * (a - least(a, 0.25))), 1e9), 6) + 0.0 AS loss FROM l GROUP BY height, pitch_deg")
def huber_grid_fit(spark, d):
    grid = [(h, p) for h in (1.0, 1.3, 1.6) for p in (-4.0, 0.0, 4.0)]
    return calibration.losses(_samples(spark, d), CAMERA, grid).select("height", "pitch_deg", r6("loss").alias("loss"))


# the same loss on a grid that is narrowed twice around its best pitch
_PITCH_LOSS = f"""{_SAMPLES_SQL}, t AS (SELECT ln({CAMERA.focal[1]} * height_m / h_px) AS zs, (v_bottom - {CAMERA.centre[1]}) / {CAMERA.focal[1]} AS vn FROM s),
    g1(p) AS (SELECT -12.0::DOUBLE + k * 0.25 FROM (SELECT unnest(range(97)) AS k)),
    l1 AS (SELECT p, avg(0.5 * least(a, 0.25) ** 2 + 0.25 * (a - least(a, 0.25))) AS loss FROM (SELECT p, abs(zs - ln(CASE WHEN zp > 1e-6 THEN zp END)) AS a
        FROM (SELECT p, zs, 1.3 * sin(radians(p)) + 1.3 * (cos(radians(p)) - vn * sin(radians(p))) / nullif(vn * cos(radians(p)) + sin(radians(p)), 0) * cos(radians(p)) AS zp FROM t, g1)) GROUP BY p),
    g2(p) AS (SELECT b + (k - 100) * 0.0025 FROM (SELECT arg_min(p, loss) AS b FROM l1 WHERE loss IS NOT NULL), (SELECT unnest(range(201)) AS k)),
    l2 AS (SELECT p, avg(0.5 * least(a, 0.25) ** 2 + 0.25 * (a - least(a, 0.25))) AS loss FROM (SELECT p, abs(zs - ln(CASE WHEN zp > 1e-6 THEN zp END)) AS a
        FROM (SELECT p, zs, 1.3 * sin(radians(p)) + 1.3 * (cos(radians(p)) - vn * sin(radians(p))) / nullif(vn * cos(radians(p)) + sin(radians(p)), 0) * cos(radians(p)) AS zp FROM t, g2 WHERE p BETWEEN -12 AND 12)) GROUP BY p)"""


@book.add(f"WITH {_PITCH_LOSS} SELECT 1.3::DOUBLE AS height_m, round(arg_min(p, loss), 1) + 0.0 AS pitch_deg, round(min(loss), 4) + 0.0 AS loss FROM l2")
def simplex_fit(spark, d):
    fit = calibration.fit_pose_by_simplex(_samples(spark, d), CAMERA, fixed_height=1.3)
    return spark.createDataFrame([(fit.pose.height_m, round(fit.pose.pitch_deg, 1) + 0.0, round(fit.loss, 4))], "height_m double, pitch_deg double, loss double")


@book.add(f"""WITH {_SAMPLES_SQL}, z AS (SELECT {CAMERA.focal[1]} * height_m / h_px AS zs, (v_bottom - {CAMERA.centre[1]}) / {CAMERA.focal[1]} AS vn FROM s),
    p AS (SELECT zs, {CAMERA.pose.height_m} * {_S!r}::DOUBLE + {CAMERA.pose.height_m} * ({_C!r}::DOUBLE - vn * {_S!r}::DOUBLE) / nullif(vn * {_C!r}::DOUBLE + {_S!r}::DOUBLE, 0) * {_C!r}::DOUBLE AS zp FROM z),
    r AS (SELECT CASE WHEN zp > 1e-6 THEN ln(zs) - ln(zp) END AS r FROM p)
    SELECT count(r) AS n, round(exp(median(r)), 6) + 0.0 AS median_ratio, round(median(abs(r)), 6) + 0.0 AS median_abs_log_ratio, round(quantile_cont(abs(r), 0.9), 6) + 0.0 AS p90_abs_log_ratio FROM r""")
def cue_agreement(spark, d):
    made = calibration.agreement(_samples(spark, d), CAMERA)
    return made.select("n", *[r6(c).alias(c) for c in ("median_ratio", "median_abs_log_ratio", "p90_abs_log_ratio")])


@book.add("""WITH p AS (SELECT page_id, 320 + page_id * 131 % 1600 AS w, 240 + page_id * 77 % 1200 AS h FROM pages),
    r AS (SELECT *, least(640.0::DOUBLE / h, 640.0::DOUBLE / w) AS r FROM p),
    q AS (SELECT *, round_even((640 - round_even(w * r, 0)) / 2 - 0.1, 0) AS l, round_even((640 - round_even(h * r, 0)) / 2 - 0.1, 0) AS t FROM r)
    SELECT page_id, round(r, 6) + 0.0 AS scale, l::INT AS pad_left, t::INT AS pad_top, round(greatest(least((100 - l) / r, w - 1), 0), 6) + 0.0 AS x1, round(greatest(least((500 - t) / r, h - 1), 0), 6) + 0.0 AS y2 FROM q""")
def letterbox_inverse(spark, d):
    p = read(spark, d, "pages").select("page_id", (320 + F.col("page_id") * 131 % 1600).alias("w"), (240 + F.col("page_id") * 77 % 1200).alias("h"))
    r, left, top = bx.letterbox(F.col("w"), F.col("h"))
    p = p.withColumns({"r": r, "l": left, "t": top})
    back = bx.undo_letterbox([F.lit(100.0), F.lit(100.0), F.lit(500.0), F.lit(500.0)], F.col("r"), F.col("l"), F.col("t"), F.col("w"), F.col("h"))
    return p.select("page_id", r6("r").alias("scale"), F.col("l").cast("int").alias("pad_left"), F.col("t").cast("int").alias("pad_top"), r6(back[0]).alias("x1"), r6(back[3]).alias("y2"))


@book.add(f"""WITH {BOXES_SQL}, p AS (SELECT *, CASE class_name WHEN 'stop_sign' THEN 'Stop Sign' WHEN 'cone' THEN 'Cone' ELSE 'Barrier' END AS name FROM b)
    SELECT frame, det, name AS pretty_name, name || ', ' || printf('%.1f', round_even(x1, 1)) || 'm' AS label,
    name || ', ' || printf('%.1f', round_even(x1, 1)) || 'm +/-' || printf('%.1f', round_even(y2, 1)) || ', size, ' || printf('%.2f', round_even(score, 2)) AS full_label,
    CASE WHEN x1 > 900 THEN '-' ELSE printf('%.2f', round_even(y2, 2)) END AS shown FROM p""")
def annotation_text(spark, d):
    rows = boxes(spark, d, True)
    shown = decimals(F.when(F.col("x1") <= 900, F.col("y2")), 2)
    full = frame_label(F.col("class_name"), F.col("x1"), F.col("y2"), F.lit("size"), F.col("score"))
    return rows.select("frame", "det", pretty(F.col("class_name")).alias("pretty_name"), frame_label(F.col("class_name"), F.col("x1")).alias("label"), full.alias("full_label"), shown.alias("shown"))


@book.add("""WITH m AS (SELECT event_type AS variant, count(*) AS n, quantile_cont(value, 0.5) AS p50, avg(value) AS mean, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY event_type)
    SELECT variant, n, round(p50, 6) + 0.0 AS p50_ms, round(mean, 6) + 0.0 AS mean_ms, round(p90, 6) + 0.0 AS p90_ms, round(1000 / p50, 6) + 0.0 AS fps,
        round(max(CASE WHEN variant = 'view' THEN p50 END) OVER () / p50, 6) + 0.0 AS speedup FROM m""")
def latency_stats(spark, d):
    made = statistics.latency(read(spark, d, "events").withColumnRenamed("event_type", "variant"), ["variant"], "value")
    made = statistics.against_baseline(made, "variant", "view", "p50_ms")
    return made.select("variant", "n", *[r6(c).alias(c) for c in ("p50_ms", "mean_ms", "p90_ms", "fps", "speedup")])


@book.add("""WITH r AS (SELECT event_type AS variant, value, event_id % 2 AS pass FROM events)
    SELECT variant, count(*) AS n, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50_ms FROM r WHERE pass = 1 GROUP BY variant""")
def last_pass_latency(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("variant"), "value", (F.col("event_id") % 2).alias("pass"))
    return statistics.latency(statistics.last_pass(rows, "variant", "pass"), ["variant"], "value").select("variant", "n", r6("p50_ms").alias("p50_ms"))
