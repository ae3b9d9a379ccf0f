"""Annotations, joins, splits, sequences and duplicates over the fixture views."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kerbside.functions import boxes as bx
from kerbside.functions.hashing import fraction
from kerbside.functions.text import audit_key, clip_parts, file_stem, group_key, name_prefix, run_parts
from kerbside.operators import annotations, datasets, evaluation, graph, matching, pseudo, sequences, splits, suite
from kerbside.plans.fixtures import (
    BOXES_SQL, DOCUMENTS_SQL, STEMS_SQL, SUPPRESSED_SQL, VECTORS_SQL, Book, boxes, clip_stems, document_hashes, frames, index_runs, r6, read, split_groups, vector_hashes,
)
from kerbside.sources import readers
from kerbside.storage import cut

book = Book()
_EDGES = ", ".join(f"round({e}, 6) + 0.0 AS {e}" for e in bx.EDGES)


@book.add(f"""WITH {BOXES_SQL}, k AS (SELECT frame, det, x1 * 2 / 3 AS x1, y1 * 2 / 3 AS y1, x2 * 2 / 3 AS x2, y2 * 2 / 3 AS y2 FROM b),
    c AS (SELECT frame, det, least(greatest(x1, 0), 1279) AS x1, least(greatest(y1, 0), 719) AS y1, least(greatest(x2, 0), 1279) AS x2, least(greatest(y2, 0), 719) AS y2 FROM k)
    SELECT frame, det, 1280 AS new_width, 720 AS new_height, {_EDGES} FROM c WHERE x2 - x1 >= 2 AND y2 - y1 >= 2""")
def box_clip_scale(spark, d):
    made = annotations.fit_to_side(boxes(spark, d, True), F.lit(1920), F.lit(1080), 1280)
    return made.select("frame", "det", F.col("new_width").cast("int").alias("new_width"), F.col("new_height").cast("int").alias("new_height"), *[r6(e).alias(e) for e in bx.EDGES])


@book.add(f"""WITH {BOXES_SQL}, m(category, class_name) AS (VALUES ('cone', 'cone'), ('barrier', 'barrier')), a AS (SELECT b.* FROM b JOIN m ON b.class_name = m.category)
    SELECT o_orderkey AS frame, a.det, a.class_name FROM orders LEFT JOIN a ON o_orderkey = frame""")
def taxonomy_join_keep_negatives(spark, d):
    rows = boxes(spark, d, True).withColumnRenamed("class_name", "category")
    mapped = annotations.map_categories(rows, {"cone": "cone", "barrier": "barrier"})
    return annotations.with_negatives(frames(spark, d).select("frame"), mapped.select("frame", "det", "class_name"), "frame")


@book.add("SELECT o_orderkey AS frame, o_orderstatus AS split FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def images_semi_annotations(spark, d):
    return frames(spark, d).select("frame", "split").join(boxes(spark, d), "frame", "left_semi")


@book.add("SELECT o_orderkey AS frame, o_orderstatus AS split FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def images_anti_annotations(spark, d):
    return frames(spark, d).select("frame", "split").join(boxes(spark, d), "frame", "left_anti")


@book.add("SELECT count(*) AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_members(spark, d):
    return annotations.matched_members(frames(spark, d), boxes(spark, d).select("frame").distinct(), "frame")[1]


@book.add(f"""WITH {BOXES_SQL}, f AS (SELECT o_orderkey AS frame, o_orderstatus AS split FROM orders), s AS (SELECT frame, count(*) AS n FROM b GROUP BY frame)
    SELECT split, class_name, count(*) AS n FROM b JOIN f USING (frame) GROUP BY split, class_name
    UNION ALL SELECT split, '__images__', count(*) FROM f GROUP BY split
    UNION ALL SELECT split, '__negatives__', count(*) FILTER (WHERE s.n IS NULL) FROM f LEFT JOIN s USING (frame) GROUP BY split""")
def split_class_counts(spark, d):
    return annotations.class_counts(frames(spark, d), boxes(spark, d), "frame", "split", "class_name")


@book.add(f"""WITH {BOXES_SQL}, f AS (SELECT o_orderkey AS frame, o_orderstatus AS split FROM orders)
    SELECT split, count(*) FILTER (WHERE class_name = 'barrier') AS barrier, count(*) FILTER (WHERE class_name = 'cone') AS cone, count(*) FILTER (WHERE class_name = 'stop_sign') AS stop_sign
    FROM b JOIN f USING (frame) GROUP BY split""")
def class_balance(spark, d):
    made = boxes(spark, d).join(frames(spark, d).select("frame", "split"), "frame").groupBy("split").pivot("class_name", ["barrier", "cone", "stop_sign"]).count()
    return made.select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("barrier", "cone", "stop_sign")])


@book.add(f"""WITH {BOXES_SQL}, f AS (SELECT o_orderkey AS frame, o_orderstatus AS split FROM orders), c AS (SELECT class_name, count(*) AS n FROM b JOIN f USING (frame) WHERE split = 'P' GROUP BY class_name),
    k(class_name) AS (VALUES ('cone'), ('barrier'), ('stop_sign'), ('drum'))
    SELECT class_name, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN c USING (class_name) WHERE coalesce(n, 0) < (SELECT sum(n) // 3 FROM c)""")
def thin_classes(spark, d):
    """Classes of one split with less than a third of its boxes."""
    rows = boxes(spark, d).join(frames(spark, d).where("split = 'P'").select("frame"), "frame")
    counts = rows.groupBy("class_name").agg(F.count("*").alias("n"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // 3
    return annotations.thin_classes(counts, ["cone", "barrier", "stop_sign", "drum"], "class_name", least)


_CONVERT_SQL = f"""{BOXES_SQL}, a AS (SELECT frame, CASE class_name WHEN 'cone' THEN 0 ELSE 1 END AS cls, class_name, x1 * 2 / 3 AS x1, y1 * 2 / 3 AS y1, x2 * 2 / 3 AS x2, y2 * 2 / 3 AS y2
        FROM b WHERE score <= 0.95 AND class_name IN ('cone', 'barrier') AND x2 - x1 >= 6 AND y2 - y1 >= 6),
    c AS (SELECT frame, cls, class_name, least(greatest(x1, 0), 1279) AS x1, least(greatest(y1, 0), 719) AS y1, least(greatest(x2, 0), 1279) AS x2, least(greatest(y2, 0), 719) AS y2 FROM a),
    l AS (SELECT o_orderstatus AS split, 'im_' || frame AS stem, class_name, cls, (x1 + x2) / 2 / 1280 AS cx, (y1 + y2) / 2 / 720 AS cy, (x2 - x1) / 1280 AS w, (y2 - y1) / 720 AS h
        FROM c JOIN orders ON o_orderkey = frame WHERE x2 - x1 >= 2 AND y2 - y1 >= 2)"""


def _converted(spark, d):
    images = frames(spark, d).select(F.col("frame").alias("image_id"), "split", F.concat(F.lit("im_"), F.col("frame").cast("string")).alias("stem"), "width", "height")
    found = boxes(spark, d).select(F.col("frame").alias("image_id"), F.col("class_name").alias("category"), *bx.EDGES, F.when(F.col("score") > 0.95, 1).otherwise(0).alias("iscrowd"))
    return datasets.convert(images, found, {"cone": "cone", "barrier": "barrier"}, ["cone", "barrier"])


@book.add(f"WITH {_CONVERT_SQL} SELECT split, stem, cls, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(w, 6) + 0.0 AS w, round(h, 6) + 0.0 AS h FROM l")
def converted_labels(spark, d):
    return _converted(spark, d).labels.select("split", "stem", "cls", *[r6(c).alias(c) for c in ("cx", "cy", "w", "h")])


@book.add(f"""WITH {_CONVERT_SQL}, n AS (SELECT stem, count(*) AS n FROM l GROUP BY stem), i AS (SELECT o_orderstatus AS split, n FROM orders LEFT JOIN n ON stem = 'im_' || o_orderkey)
    SELECT split, class_name, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT split, '__images__', count(*) FROM i GROUP BY split UNION ALL SELECT split, '__negatives__', count(*) FILTER (WHERE n IS NULL) FROM i GROUP BY split""")
def converted_counts(spark, d):
    return _converted(spark, d).counts


_MIXED_SQL = f"""{STEMS_SQL}, j AS (SELECT event_type AS prefix, event_id AS idx, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) > 10 THEN 1 ELSE 0 END AS jump FROM events WHERE event_id % 2 = 1),
    i AS (SELECT prefix, idx, sum(jump) OVER (PARTITION BY prefix ORDER BY idx)::BIGINT AS island FROM j),
    r AS (SELECT *, ((row_number() OVER (PARTITION BY prefix, island ORDER BY idx) - 1) // 250)::INT AS chunk FROM i),
    e AS (SELECT *, count(*) OVER (PARTITION BY prefix, island, chunk) > 16 AND row_number() OVER (PARTITION BY prefix, island, chunk ORDER BY idx DESC) <= 8 AS dropped FROM r),
    m AS (SELECT stem, city || '/' || video || '/' || seq AS grp FROM s WHERE event_id % 2 = 0 UNION ALL SELECT 'rw_' || prefix || '_' || idx, prefix || '/' || island || '/' || chunk FROM e WHERE NOT dropped),
    g AS (SELECT grp, count(*) AS n FROM m GROUP BY grp), k AS (SELECT *, ('0x' || substr(md5('0:rw/' || grp), 1, 13))::BIGINT / 4503599627370496 AS rank FROM g),
    f AS (SELECT grp, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY rank, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.27 * sum(n) OVER () THEN 'val' ELSE 'train' END AS split FROM k)"""


def _mixed_stems(spark, d):
    """Clip frames of every other event, numbered frames of the rest."""
    clips = clip_stems(spark, d).where("event_id % 2 = 0").select("stem")
    runs = index_runs(spark, d).where("idx % 2 = 1").select(F.concat_ws("_", F.lit("rw"), "prefix", F.col("idx").cast("string")).alias("stem"))
    return clips.unionByName(runs)


@book.add(f"WITH {_MIXED_SQL} SELECT stem, 'rw' AS source, grp, split FROM m JOIN f USING (grp)")
def resplit_assignment(spark, d):
    return datasets.resplit(_mixed_stems(spark, d)).assignment.select("stem", "source", "grp", "split")


@book.add(f"""WITH {_MIXED_SQL} SELECT 'rw' AS source, count(*) AS groups, count(*) FILTER (WHERE split = 'val') AS val_groups, sum(n)::BIGINT AS images, coalesce(sum(n) FILTER (WHERE split = 'val'), 0)::BIGINT AS val_images,
    round(coalesce(sum(n) FILTER (WHERE split = 'val'), 0) / sum(n), 4) AS fraction FROM f""")
def resplit_summary(spark, d):
    return datasets.resplit(_mixed_stems(spark, d)).summary


@book.add(f"""WITH {STEMS_SQL}, k AS (SELECT stem, 'rw::' || city || '/' || video || '/' || seq AS grp, CASE WHEN event_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM s),
    d AS (SELECT count(*) FILTER (WHERE n > 1) AS duplicate_stems FROM (SELECT stem, count(DISTINCT split) AS n FROM k GROUP BY stem)),
    v AS (SELECT grp, count(*) AS n FROM k WHERE split = 'val' GROUP BY grp), t AS (SELECT DISTINCT grp FROM k WHERE split = 'train'),
    a AS (SELECT count(t.grp) AS shared, coalesce(sum(n) FILTER (WHERE t.grp IS NOT NULL), 0)::BIGINT AS affected, round(coalesce(100.0 * sum(n) FILTER (WHERE t.grp IS NOT NULL) / sum(n), 0), 6) + 0.0 AS affected_pct FROM v LEFT JOIN t USING (grp))
    SELECT *, 0::BIGINT AS near_pairs, duplicate_stems > 0 OR shared > 0 AS leaked FROM d, a""")
def leakage_report(spark, d):
    rows = clip_stems(spark, d).select("stem", F.when(F.col("event_id") % 4 == 0, "val").otherwise("train").alias("split"))
    return datasets.leakage_check(rows).withColumn("affected_pct", r6("affected_pct"))


@book.add(f"""WITH {BOXES_SQL}, s AS (SELECT class_name, CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END AS band FROM b)
    SELECT coalesce(class_name, '__all__') AS class_name, band, count(*) AS n FROM s GROUP BY GROUPING SETS ((band), (class_name, band))""")
def size_band_histogram(spark, d):
    return annotations.size_histogram(boxes(spark, d), "class_name")


@book.add("""WITH r AS (SELECT l_orderkey AS frame, CASE WHEN l_tax + 0.0 = 0 THEN 1 ELSE 0 END AS iscrowd, CASE l_linestatus WHEN 'F' THEN 'person' ELSE 'rider' END AS label,
        l_quantity AS x, l_partkey % 50 AS w, l_suppkey % 40 AS h FROM lineitem)
    SELECT frame, 'person' AS label, count(*) AS n, round(sum(x + w), 6) + 0.0 AS right_edges FROM r WHERE iscrowd = 0 AND w >= 6 AND h >= 6 GROUP BY frame""")
def annotation_clean(spark, d):
    rows = read(spark, d, "lineitem")
    box = bx.from_xywh(F.col("l_quantity"), F.lit(0.0), F.col("l_partkey") % 50, F.col("l_suppkey") % 40)
    rows = rows.select(
        F.col("l_orderkey").alias("frame"), F.when(F.col("l_tax") + 0.0 == 0, 1).otherwise(0).alias("iscrowd"),
        F.when(F.col("l_linestatus") == "F", "person").otherwise("rider").alias("label"), *[b.alias(e) for b, e in zip(box, bx.EDGES, strict=True)],
    )
    kept = annotations.drop_small(annotations.fold_aliases(annotations.drop_crowds(rows), {"rider": "person"}, ["person", "car"]), 6)
    return kept.groupBy("frame", "label").agg(F.count("*").alias("n"), r6(F.sum("x2")).alias("right_edges"))


@book.add(f"""WITH {BOXES_SQL} SELECT frame, det, round((x1 + x2) / 2 / 1920, 6) + 0.0 AS cx, round((y1 + y2) / 2 / 1080, 6) + 0.0 AS cy, round((x2 - x1) / 1920, 6) + 0.0 AS w, round((y2 - y1) / 1080, 6) + 0.0 AS h,
    round(x1, 6) + 0.0 AS back_x1, round(y2, 6) + 0.0 AS back_y2, round(x2 - x1, 6) + 0.0 AS px_w, round((x1 + x2) / 2, 6) + 0.0 AS centre_x, round(least(greatest(x1, 0), 1919), 6) + 0.0 AS clamped FROM b""")
def box_format_roundtrip(spark, d):
    rows = boxes(spark, d, True)
    norm = bx.to_normalised(bx.columns(), 1920, 1080)
    back = bx.from_normalised(norm, 1920, 1080)
    out = {"cx": norm[0], "cy": norm[1], "w": norm[2], "h": norm[3], "back_x1": back[0], "back_y2": back[3], "px_w": bx.to_xywh(bx.columns())[2], "centre_x": bx.centre(bx.columns())[0], "clamped": bx.clamp(F.col("x1"), 0.0, 1919.0)}
    return rows.select("frame", "det", *[r6(v).alias(k) for k, v in out.items()])


@book.add("""WITH r AS (SELECT l_orderkey AS frame, [l_quantity / 100, l_discount * 5, l_tax * 5] AS s FROM lineitem), k AS (SELECT frame, list_max(s) + 0.0 AS score, (list_position(s, list_max(s)) - 1)::INT AS class_id FROM r)
    SELECT class_id, count(*) AS n, round(sum(score), 6) + 0.0 AS total FROM k WHERE score > 0.25 GROUP BY class_id""")
def confidence_argmax(spark, d):
    scores = F.array(F.col("l_quantity") / 100, F.col("l_discount") * 5, F.col("l_tax") * 5)
    made = annotations.above_confidence(read(spark, d, "lineitem"), scores, 0.25)
    return made.groupBy("class_id").agg(F.count("*").alias("n"), r6(F.sum("score")).alias("total"))


def _truth_and_detections(spark: SparkSession, d: str):
    rows = boxes(spark, d, True)
    return rows.where("side = 'O'").drop("side"), rows.where("side = 'F'").drop("side")


_IOU_SQL = f"""{BOXES_SQL}, i AS (SELECT f.frame, f.det, o.det AS gt, f.class_name AS dc, o.class_name AS gc, o.x1, o.y1, o.x2, o.y2,
        greatest(least(f.x2, o.x2) - greatest(f.x1, o.x1), 0) * greatest(least(f.y2, o.y2) - greatest(f.y1, o.y1), 0) AS inter,
        (f.x2 - f.x1) * (f.y2 - f.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) AS both_ FROM b f JOIN b o ON f.frame = o.frame WHERE f.side = 'F' AND o.side = 'O'),
    v AS (SELECT *, CASE WHEN both_ - inter > 0 THEN inter / (both_ - inter) ELSE 0 END AS iou FROM i)"""


@book.add(f"WITH {_IOU_SQL} SELECT frame, det, gt, round(iou, 6) + 0.0 AS iou, iou > 0.2 AS over FROM v WHERE iou >= 0.05")
def iou_pairs(spark, d):
    truths, detections = _truth_and_detections(spark, d)
    pairs = matching.overlap_pairs(detections, truths, ["frame"], 0.05)
    return pairs.select("frame", "det", F.col("b_det").alias("gt"), r6("iou").alias("iou"), (F.col("iou") > 0.2).alias("over"))


@book.add(f"""WITH {_IOU_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY frame, det ORDER BY iou DESC, gt) AS n FROM v)
    SELECT frame, det, gt, round(iou, 6) + 0.0 AS iou, x1, y1, x2, y2 FROM k WHERE n = 1 AND iou >= 0.35""")
def agreement_join(spark, d):
    truths, detections = _truth_and_detections(spark, d)
    made = matching.agreement_join(detections, truths.withColumnRenamed("det", "gt"), "frame", "det", "gt")
    return made.withColumn("iou", r6("iou"))


@book.add(f"""WITH {_IOU_SQL}, m AS (SELECT frame, det, max(iou) AS iou FROM v GROUP BY frame, det), k AS (SELECT count(*) AS kept FROM m WHERE iou >= 0.35),
    n AS (SELECT count(DISTINCT frame) AS examined, count(*) AS total FROM b WHERE side = 'F')
    SELECT examined, kept, total - kept AS rejected, round(100 * (total - kept) / total, 6) + 0.0 AS rejected_pct FROM n, k""")
def mining_statistics(spark, d):
    truths, detections = _truth_and_detections(spark, d)
    kept = matching.agreement_join(detections, truths.withColumnRenamed("det", "gt"), "frame", "det", "gt")
    return matching.mining_statistics(detections, kept, "frame").withColumn("rejected_pct", r6("rejected_pct"))


@book.add(f"""WITH {BOXES_SQL}, p AS (SELECT frame, (x1 + x2) / 2 AS u, (y1 + y2) / 2 AS v, score FROM b)
    SELECT b.frame, b.det, count(*) AS n_points, round(median(p.score), 6) + 0.0 AS median_value FROM b JOIN p ON b.frame = p.frame AND u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2 GROUP BY b.frame, b.det HAVING count(*) >= 3""")
def points_in_boxes(spark, d):
    rows = boxes(spark, d, True)
    u, v = bx.centre(bx.columns())
    points = rows.select("frame", u.alias("u"), v.alias("v"), "score")
    return matching.points_in_boxes(points, rows.drop("score"), "frame", "det", "score", 3).withColumn("median_value", r6("median_value"))


@book.add(f"""WITH {BOXES_SQL}, k AS (SELECT frame, class_name, det FROM b) SELECT frame, count(*) AS n, string_agg(class_name || ':' || det, ',' ORDER BY class_name, det) AS listed,
    array_to_string(list(class_name || ':' || det ORDER BY class_name, det)[1:2], ',') AS first_two FROM k GROUP BY frame""")
def frame_lists(spark, d):
    lists = annotations.box_lists(boxes(spark, d, True), "frame", ["class_name", "det"])
    shown = F.transform("boxes", lambda b: F.concat_ws(":", b["class_name"], b["det"].cast("string")))
    return lists.select("frame", F.size("boxes").cast("long").alias("n"), F.array_join(shown, ",").alias("listed"), F.array_join(F.slice(shown, 1, 2), ",").alias("first_two"))


@book.add("SELECT o_orderstatus AS split, o_orderkey AS frame, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::INT AS number FROM orders QUALIFY number <= 25")
def per_split_limit(spark, d):
    kept = splits.head_of_each(frames(spark, d).select("split", "frame"), ["split"], ["frame"], 25)
    return annotations.numbered(kept, "number", ["frame"], ["split"])


@book.add("""WITH n AS (SELECT o_orderkey AS frame, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders)
    SELECT frame FROM n WHERE i % greatest(1, c // 40) = 0 AND i < 40 * greatest(1, c // 40)""")
def stride_sample(spark, d):
    return splits.stride_sample(frames(spark, d).select("frame"), ["frame"], 40)


@book.add("""WITH n AS (SELECT o_orderkey AS frame, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders)
    SELECT DISTINCT frame FROM n JOIN (SELECT unnest(range(40)) AS k) ON i = floor(k * ((c - 1) / 39))""")
def linspace_sample(spark, d):
    return splits.linspace_sample(frames(spark, d).select("frame"), ["frame"], 40)


@book.add("""SELECT o_orderkey AS frame, CASE WHEN ('0x' || substr(md5('7:' || o_orderkey), 1, 13))::BIGINT / 4503599627370496 < 0.2 THEN 'val' ELSE 'train' END AS split FROM orders""")
def hash_shuffle_split(spark, d):
    return splits.hash_split(frames(spark, d).select("frame"), F.col("frame").cast("string"), 0.2, 7)


@book.add("""SELECT doc_id, CASE WHEN ('0x' || substr(md5('3:' || source), 1, 13))::BIGINT / 4503599627370496 < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents""")
def hash_split(spark, d):
    return splits.hash_split(read(spark, d, "documents").select("doc_id", "source"), F.col("source"), 0.2, 3).drop("source")


_FILL_SQL = """g AS (SELECT lang AS source, source AS grp, count(*) AS n FROM documents GROUP BY ALL),
    r AS (SELECT *, ('0x' || substr(md5('0:' || source || '/' || grp), 1, 13))::BIGINT / 4503599627370496 AS rank FROM g),
    f AS (SELECT source, grp, n, CASE WHEN coalesce(sum(n) OVER (PARTITION BY source ORDER BY rank, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.27 * sum(n) OVER (PARTITION BY source) THEN 'val' ELSE 'train' END AS split FROM r)"""


@book.add(f"WITH {_FILL_SQL} SELECT * FROM f")
def greedy_group_split(spark, d):
    return _filled(spark, d)


def _filled(spark, d):
    rank = fraction(F.concat_ws("/", "source", "grp"), 0)
    return splits.greedy_fill(split_groups(spark, d), "source", rank, "n", 0.27, ["grp"])


@book.add(f"""WITH {_FILL_SQL} SELECT source, count(*) AS groups, count(*) FILTER (WHERE split = 'val') AS val_groups, sum(n)::BIGINT AS images, coalesce(sum(n) FILTER (WHERE split = 'val'), 0)::BIGINT AS val_images,
    round(coalesce(sum(n) FILTER (WHERE split = 'val'), 0) / sum(n), 4) AS fraction FROM f GROUP BY source""")
def split_summary(spark, d):
    return splits.split_summary(_filled(spark, d), "source", "n")


@book.add("""WITH e AS (SELECT DISTINCT doc_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)),
    a AS (SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM e) THEN 'val' ELSE 'train' END AS split FROM documents),
    v AS (SELECT source, count(*) AS n FROM a WHERE split = 'val' GROUP BY source), t AS (SELECT DISTINCT source FROM a WHERE split = 'train')
    SELECT count(*) FILTER (WHERE t.source IS NOT NULL) AS shared, coalesce(sum(n) FILTER (WHERE t.source IS NOT NULL), 0)::BIGINT AS affected,
        round(coalesce(100.0 * sum(n) FILTER (WHERE t.source IS NOT NULL) / sum(n), 0), 6) + 0.0 AS affected_pct, coalesce(bool_or(t.source IS NOT NULL), false) AS leaked FROM v LEFT JOIN t USING (source)""")
def leakage_audit(spark, d):
    items = read(spark, d, "benchmark").select(F.col("text").alias("item"))
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    hit = graph.holding(docs, items, "doc_id", "text", "item").withColumn("_v", F.lit(1))
    placed = docs.drop("text").join(hit, "doc_id", "left").withColumn("split", F.when(F.col("_v") == 1, "val").otherwise("train"))
    made = splits.affected(placed, "source")
    return made.select("shared", "affected", r6("affected_pct").alias("affected_pct"), (F.col("shared") > 0).alias("leaked"))


@book.add("""WITH r AS (SELECT md5(text) AS stem, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents)
    SELECT stem, max(split) AS split, count(DISTINCT split) > 1 AS duplicated FROM r GROUP BY stem""")
def last_split_wins(spark, d):
    rows = read(spark, d, "documents").select(F.md5("text").alias("stem"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))
    return splits.last_split_wins(rows)


@book.add(f"""WITH {STEMS_SQL}, k AS (SELECT 'rw' AS source, city || '/' || video || '/' || seq AS grp, 'rw::' || city || '/' || video || '/' || seq AS audit, CASE WHEN event_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM s)
    SELECT source, grp, audit FROM k WHERE split = 'train' INTERSECT SELECT source, grp, audit FROM k WHERE split = 'val'""")
def shared_groups(spark, d):
    rows = clip_stems(spark, d).withColumns({"_g": group_key(F.col("stem")), "audit": audit_key(F.col("stem")), "split": F.when(F.col("event_id") % 4 == 0, "val").otherwise("train")})
    rows = rows.withColumn("key", F.struct("_g.source", "_g.grp", "audit"))
    return splits.shared_keys(rows, "key").select("key.*")


@book.add(f"WITH {STEMS_SQL} SELECT stem, city, video, seq, frame_ms AS frame FROM s")
def stem_parse(spark, d):
    return clip_stems(spark, d).withColumn("_c", clip_parts(F.col("stem"))).select("stem", "_c.*")


@book.add("""SELECT 'rw_' || event_type || '_' || event_id AS stem, event_type AS prefix, event_id AS idx, event_id / 1000 AS seconds, event_id BETWEEN 100 AND 5000 AS in_bounds FROM events""")
def index_run_parse(spark, d):
    rows = index_runs(spark, d).select(F.concat_ws("_", F.lit("rw"), "prefix", F.col("idx").cast("string")).alias("stem")).withColumn("_r", run_parts(F.col("stem")))
    return rows.select("stem", "_r.prefix", "_r.idx", (F.col("_r.idx") / 1000).alias("seconds"), F.col("_r.idx").between(100, 5000).alias("in_bounds"))


_CLIPS_SQL = f"{STEMS_SQL}, c AS (SELECT city || '/' || video || '/' || seq AS clip_key, frame_ms, stem FROM s)"


@book.add(f"WITH {_CLIPS_SQL} SELECT clip_key, count(*)::INT AS length, min(frame_ms) AS first_ms, string_agg(frame_ms::VARCHAR, ',' ORDER BY frame_ms, stem) AS frame_ids FROM c GROUP BY clip_key HAVING count(*) >= 2")
def clip_sequences(spark, d):
    made = sequences.clips(sequences.clip_frames(clip_stems(spark, d)), 2)
    return made.select("clip_key", "length", F.get("frame_ids", F.lit(0)).alias("first_ms"), F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"))


@book.add(f"""WITH {_CLIPS_SQL}, l AS (SELECT clip_key, lead(frame_ms) OVER (PARTITION BY clip_key ORDER BY frame_ms, stem) - frame_ms AS gap FROM (SELECT clip_key, frame_ms // 2000 AS frame_ms, stem FROM c)),
    m AS (SELECT clip_key, list(gap ORDER BY gap) FILTER (WHERE gap > 0) AS gaps FROM l GROUP BY clip_key)
    SELECT clip_key, round(CASE WHEN gaps[len(gaps) // 2 + 1] / 1000 BETWEEN 0.005 AND 2 THEN gaps[len(gaps) // 2 + 1] / 1000 ELSE 1 / 30 END, 6) + 0.0 AS interval_s FROM m""")
def frame_interval(spark, d):
    # the events' days as clips of two seconds to a millisecond, so that steps fall inside and outside the bounds
    frames_ = sequences.clip_frames(clip_stems(spark, d)).withColumn("frame_ms", F.floor(F.col("frame_ms") / 2000))
    made = sequences.frame_intervals(frames_)
    return made.withColumn("interval_s", r6("interval_s"))


_RUNS_SQL = """j AS (SELECT event_type AS prefix, event_id AS idx, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) > 10 THEN 1 ELSE 0 END AS jump FROM events),
    i AS (SELECT prefix, idx, sum(jump) OVER (PARTITION BY prefix ORDER BY idx)::BIGINT AS island FROM j),
    r AS (SELECT *, ((row_number() OVER (PARTITION BY prefix, island ORDER BY idx) - 1) // 250)::INT AS chunk FROM i)"""


@book.add(f"WITH {_RUNS_SQL} SELECT prefix, island, chunk, count(*) AS n, min(idx) AS lo, max(idx) AS hi FROM r GROUP BY ALL")
def gap_island_runs(spark, d):
    made = sequences.segment_runs(index_runs(spark, d), "prefix", "idx")
    return made.groupBy("prefix", "island", "chunk").agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))


@book.add(f"""WITH {_RUNS_SQL}, e AS (SELECT prefix, idx, count(*) OVER (PARTITION BY prefix, island, chunk) > 16 AND row_number() OVER (PARTITION BY prefix, island, chunk ORDER BY idx DESC) <= 8 AS dropped FROM r)
    SELECT prefix, idx FROM e WHERE NOT dropped""")
def embargo(spark, d):
    made = sequences.embargo(sequences.segment_runs(index_runs(spark, d), "prefix", "idx"), ["prefix", "island", "chunk"], "idx")
    return made.where("not dropped").select("prefix", "idx")


@book.add(f"WITH {VECTORS_SQL} SELECT vec_id, h FROM v")
def vector_hash(spark, d):
    return vector_hashes(spark, d)


@book.add(f"""WITH {VECTORS_SQL}, k AS (SELECT a.vec_id AS query, b.vec_id AS match, bit_count(xor(a.h, b.h))::INT AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.h, b.h)), b.vec_id) AS n
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query, match, distance FROM k WHERE n = 1""")
def hamming_nn(spark, d):
    rows = vector_hashes(spark, d)
    return graph.nearest_codes(rows.where("vec_id % 50 = 0"), rows, "vec_id", "h")


_NEAREST_SQL = f"""WITH {VECTORS_SQL}, k AS (SELECT a.vec_id AS query, b.vec_id AS match, bit_count(xor(a.h, b.h))::INT AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.h, b.h)), b.vec_id) = 1) SELECT query, match, distance FROM k"""


@book.add(_NEAREST_SQL)
def hamming_nn_all(spark, d):
    rows = vector_hashes(spark, d)
    return graph.nearest_by_radius(rows, rows, "vec_id", "h")


@book.add(f"""WITH {DOCUMENTS_SQL}, s AS (SELECT doc_id, h, doc_id % 5 = 0 AS val FROM dh), k AS (SELECT a.doc_id AS query, b.doc_id AS match, bit_count(xor(a.h, b.h))::INT AS distance FROM s a JOIN s b ON a.val AND NOT b.val AND bit_count(xor(a.h, b.h)) <= 6
    QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY bit_count(xor(a.h, b.h)), b.doc_id) = 1) SELECT query, match, distance FROM k""")
def hamming_nn_within(spark, d):
    """Documents of a validation split with a training document at six bits or less."""
    rows = cut(document_hashes(spark, d)).withColumn("val", F.col("doc_id") % 5 == 0)
    return graph.nearest_by_radius(rows.where("val"), rows.where("not val"), "doc_id", "h", bits=48, within=6)


@book.add(f"""WITH {VECTORS_SQL}, k AS (SELECT a.vec_id AS query, b.vec_id AS match, bit_count(xor(a.h, b.h))::INT AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.h, b.h)), b.vec_id) AS n
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query, match, d1, d2 FROM (SELECT query, max(match) FILTER (WHERE n = 1) AS match, max(dist) FILTER (WHERE n = 1) AS d1, max(dist) FILTER (WHERE n = 2) AS d2 FROM k WHERE n <= 2 GROUP BY query) WHERE d1 < 0.95 * d2""")
def ratio_test(spark, d):
    rows = vector_hashes(spark, d)
    pairs = graph.compared(rows.where("vec_id % 50 = 0"), rows, "vec_id", "h", best=2).withColumnRenamed("distance", "dist").drop("place")
    return matching.ratio_test(pairs, "query", "match", "dist", 0.95)


@book.add(f"""WITH {DOCUMENTS_SQL}, u AS (SELECT h, min(doc_id) AS k FROM dh GROUP BY h)
    SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM u a JOIN u b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 3
    UNION ALL SELECT u.k, dh.doc_id, 0 FROM dh JOIN u USING (h) WHERE dh.doc_id > u.k""")
def mih_near_dups(spark, d):
    return graph.band_pairs(document_hashes(spark, d), "doc_id", "h", bits=48)


@book.add(f"""WITH RECURSIVE {DOCUMENTS_SQL}, e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM dh a JOIN dh b ON a.doc_id <> b.doc_id AND bit_count(xor(a.h, b.h)) <= 3),
    t AS (SELECT a AS node, a AS seen FROM e UNION SELECT t.node, e.b FROM t JOIN e ON t.seen = e.a)
    SELECT node, min(seen) AS component FROM t GROUP BY node""")
def duplicate_components(spark, d):
    return graph.components(graph.band_pairs(document_hashes(spark, d), "doc_id", "h", bits=48))


@book.add("SELECT md5(text) AS digest, min(doc_id) AS first_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return graph.exact_groups(read(spark, d, "documents"), "doc_id", F.col("text"))


@book.add("""SELECT 'doc' AS provenance, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'page', count(*), sum(length(html))::BIGINT FROM pages""")
def source_union(spark, d):
    docs = read(spark, d, "documents").select(F.length("text").alias("chars"))
    pages = read(spark, d, "pages").select(F.length("html").alias("chars"), "url")
    return annotations.union_sources(doc=docs, page=pages).groupBy("provenance").agg(F.count("*").alias("n"), F.sum("chars").cast("long").alias("chars"))


@book.add("""SELECT string_split(regexp_replace(string_split(url, '/')[-1], '\\.[^.]+$', ''), '_')[1] AS prefix, count(*) AS images FROM pages WHERE starts_with(url, 'http') GROUP BY 1""".replace("\\\\", "\\"))
def prefix_filter_counts(spark, d):
    rows = read(spark, d, "pages").where(F.col("url").startswith("http"))
    return rows.groupBy(name_prefix(file_stem(F.col("url"))).alias("prefix")).agg(F.count("*").alias("images"))


@book.add("""WITH r AS (SELECT user_id, event_id, value FROM events WHERE event_id % 7 <> 0) SELECT 'img/' || user_id AS image_path, count(*) AS n, round(sum(value), 6) + 0.0 AS xmax_sum FROM r GROUP BY 1""")
def bad_rows_skipped(spark, d):
    e = read(spark, d, "events")
    bad = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.col("value").cast("string"))
    raw = e.select(F.concat(F.lit("/img/"), F.col("user_id").cast("string")).alias("image_path"), F.col("event_type").alias("label"), F.lit("0").alias("xmin"), F.lit("0").alias("ymin"), bad.alias("xmax"), F.lit("10").alias("ymax"))
    return readers.clean_label_rows(raw).groupBy("image_path").agg(F.count("*").alias("n"), r6(F.sum("x2")).alias("xmax_sum"))


@book.add(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT frame, class_name, x1, y1, x2, y2, score, side, det, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det) AS n FROM b), {SUPPRESSED_SQL} SELECT * EXCLUDE (n) FROM kept""")
def nms(spark, d):
    return matching.suppress(boxes(spark, d, True), "frame", "det")


_COCO_SQL = f"""{BOXES_SQL}, ar(area_range, lo, hi) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)),
    th AS (SELECT round(0.5 + 0.05 * k, 2)::DOUBLE AS threshold FROM (SELECT unnest(range(10)) AS k)),
    q AS (SELECT frame, class_name, frame * 1000 + det AS id, score, side, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS size, row_number() OVER (PARTITION BY frame, class_name, side ORDER BY CASE side WHEN 'F' THEN -score END, frame * 1000 + det) AS n FROM b),
    dt AS (SELECT * FROM q WHERE side = 'F'), gt AS (SELECT * FROM q WHERE side = 'O'),
    iv AS (SELECT d.frame, d.class_name, d.n, g.n AS m, g.size, greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS both_, d.size + g.size AS two
        FROM dt d JOIN gt g USING (frame, class_name)),
    ca AS (SELECT frame, class_name, n, list({{'iou': both_ / greatest(two - both_, 1e-12), 'm': m, 'size': size}}) AS c FROM iv GROUP BY ALL),
    st AS (SELECT dt.*, coalesce(c, []) AS c FROM dt LEFT JOIN ca USING (frame, class_name, n)),
    walk(frame, class_name, area_range, lo, hi, threshold, n, id, score, size, taken, pick) AS (
        SELECT frame, class_name, area_range, lo, hi, threshold, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, []::BIGINT[], NULL::STRUCT(iou DOUBLE, m BIGINT, size DOUBLE) FROM dt, ar, th WHERE n = 1
        UNION ALL
        SELECT frame, class_name, area_range, lo, hi, threshold, n, id, score, size, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p.m) END, p
        FROM (SELECT *, coalesce(list_sort(list_filter(free, lambda x: x.size >= lo AND x.size <= hi))[-1], list_sort(free)[-1]) AS p
              FROM (SELECT w.frame, w.class_name, w.area_range, w.lo, w.hi, w.threshold, st.n, st.id, st.score, st.size, w.taken, list_filter(st.c, lambda x: x.iou >= w.threshold - 1e-10 AND NOT list_contains(w.taken, x.m)) AS free
                    FROM walk w JOIN st ON st.frame = w.frame AND st.class_name = w.class_name AND st.n = w.n + 1))),
    ng AS (SELECT class_name, area_range, count(*) AS n_gt FROM gt, ar WHERE size BETWEEN lo AND hi GROUP BY ALL),
    ht AS (SELECT w.class_name, w.area_range, threshold, id, score, n_gt, (pick IS NOT NULL)::INT AS tp FROM walk w JOIN ng USING (class_name, area_range)
        WHERE n > 0 AND CASE WHEN pick IS NULL THEN size BETWEEN lo AND hi ELSE pick.size BETWEEN lo AND hi END),
    cu AS (SELECT *, sum(tp) OVER v AS hits, row_number() OVER v AS place FROM ht WINDOW v AS (PARTITION BY class_name, area_range, threshold ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
    rk AS (SELECT class_name, area_range, threshold, floor(hits / n_gt * 100 + 1e-9) AS k, max(hits / place) AS p, max(hits / n_gt) AS r FROM cu GROUP BY ALL),
    en AS (SELECT *, max(p) OVER v AS e, k - coalesce(lead(k) OVER v, -1) AS points FROM rk WINDOW v AS (PARTITION BY class_name, area_range, threshold ORDER BY k DESC)),
    ap AS (SELECT class_name, area_range, threshold, sum(e * points) / 101 AS ap, max(r) AS recall FROM en GROUP BY ALL),
    cm AS (SELECT class_name, area_range, threshold, coalesce(ap, 0) AS ap, coalesce(recall, 0) AS recall FROM (SELECT class_name, area_range, threshold FROM ng, th) LEFT JOIN ap USING (class_name, area_range, threshold))"""


@book.add(f"WITH RECURSIVE {_COCO_SQL} SELECT class_name, area_range, threshold, round(ap, 6) + 0.0 AS ap, round(recall, 6) + 0.0 AS recall FROM cm")
def coco_map(spark, d):
    return _coco(spark, d).withColumns({c: r6(c) for c in ("ap", "recall")})


def _coco(spark, d):
    truths, detections = _truth_and_detections(spark, d)
    det = detections.withColumn("det_id", F.col("frame") * 1000 + F.col("det"))
    gt = truths.withColumn("gt_id", F.col("frame") * 1000 + F.col("det"))
    return evaluation.average_precision(det, gt, "frame")


@book.add(f"""WITH RECURSIVE {_COCO_SQL} SELECT round(avg(ap) FILTER (WHERE area_range = 'all'), 6) + 0.0 AS map_50_95, round(avg(ap) FILTER (WHERE area_range = 'all' AND threshold = 0.5), 6) + 0.0 AS map_50,
    round(avg(ap) FILTER (WHERE area_range = 'all' AND threshold = 0.75), 6) + 0.0 AS map_75, round(avg(ap) FILTER (WHERE area_range = 'small'), 6) + 0.0 AS map_small,
    round(avg(ap) FILTER (WHERE area_range = 'medium'), 6) + 0.0 AS map_medium, round(avg(ap) FILTER (WHERE area_range = 'large'), 6) + 0.0 AS map_large, round(avg(recall) FILTER (WHERE area_range = 'all'), 6) + 0.0 AS ar_100 FROM cm""")
def coco_summary(spark, d):
    made = evaluation.summary(_coco(spark, d))
    return made.select(*[r6(c).alias(c) for c in made.columns])


_PSEUDO_SQL = f"""{BOXES_SQL}, fr AS (SELECT o_orderkey AS frame, o_orderstatus AS split, CASE WHEN o_orderkey % 2 = 0 THEN 'rw_' ELSE 'co_' END || o_orderkey AS stem FROM orders),
    se AS (SELECT split, stem, frame, det, side, score, x1, y1, x2, y2, greatest(least(x1, 1919), 0) AS a1, greatest(least(y1, 1079), 0) AS a2, greatest(least(x2, 1919), 0) AS a3, greatest(least(y2, 1079), 0) AS a4
        FROM b JOIN fr USING (frame) WHERE class_name = 'stop_sign')"""


def _pseudo(spark, d):
    """Frames with a prefix by their number, and the boxes as a teacher's detections, stop signs under its class number 11."""
    stem = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "rw_").otherwise("co_"), F.col(c).cast("string"))
    known = frames(spark, d).withColumn("stem", stem("frame"))
    found = boxes(spark, d, True).withColumns({"stem": stem("frame"), "class_id": F.when(F.col("class_name") == "stop_sign", 11).otherwise(0), "det_id": F.col("det")})
    return known, found


@book.add(f"""WITH {_PSEUDO_SQL} SELECT split, stem, 2 AS cls, round((a1 + a3) / 2 / 1920, 6) + 0.0 AS cx, round((a2 + a4) / 2 / 1080, 6) + 0.0 AS cy, round((a3 - a1) / 1920, 6) + 0.0 AS w, round((a4 - a2) / 1080, 6) + 0.0 AS h,
    round(score, 6) + 0.0 AS score FROM se WHERE starts_with(stem, 'rw_') AND score > 0.55 AND a3 - a1 >= 6 AND a4 - a2 >= 6""")
def pseudo_labels(spark, d):
    known, found = _pseudo(spark, d)
    return pseudo.complete(known, found, 11, 2, "rw_").labels.withColumns({c: r6(c) for c in ("cx", "cy", "w", "h", "score")})


@book.add(f"""WITH {_PSEUDO_SQL}, su AS (SELECT * FROM se WHERE score > 0.55) SELECT split, count(*) AS images_scanned, count(*) FILTER (WHERE frame IN (SELECT frame FROM su)) AS images_modified,
    (SELECT count(*) FROM su WHERE su.split = f.split AND starts_with(su.stem, 'rw_') AND a3 - a1 >= 6 AND a4 - a2 >= 6) AS boxes_added FROM fr f WHERE starts_with(stem, 'rw_') GROUP BY split""")
def pseudo_label_statistics(spark, d):
    return pseudo.complete(*_pseudo(spark, d), 11, 2, "rw_").statistics


_MINED_SQL = f"""{_PSEUDO_SQL}, tr AS (SELECT * FROM se WHERE side = 'O'), dt AS (SELECT * FROM se WHERE side = 'F' AND score > 0.55 AND frame IN (SELECT frame FROM tr)),
    iv AS (SELECT dt.frame, dt.det, dt.score, tr.split, tr.stem, tr.det AS truth, tr.a1, tr.a2, tr.a3, tr.a4, greatest(least(dt.x2, tr.x2) - greatest(dt.x1, tr.x1), 0) * greatest(least(dt.y2, tr.y2) - greatest(dt.y1, tr.y1), 0) AS both_,
        (dt.x2 - dt.x1) * (dt.y2 - dt.y1) + (tr.x2 - tr.x1) * (tr.y2 - tr.y1) AS two FROM dt JOIN tr USING (frame)),
    ag AS (SELECT * FROM iv QUALIFY row_number() OVER (PARTITION BY frame, det ORDER BY both_ / (two - both_) DESC, truth) = 1), ok AS (SELECT * FROM ag WHERE both_ / (two - both_) >= 0.35)"""


@book.add(f"""WITH {_MINED_SQL} SELECT split, stem, det AS det_id, 2 AS cls, round((a1 + a3) / 2 / 1920, 6) + 0.0 AS cx, round((a2 + a4) / 2 / 1080, 6) + 0.0 AS cy, round((a3 - a1) / 1920, 6) + 0.0 AS w, round((a4 - a2) / 1080, 6) + 0.0 AS h,
    round(score, 6) + 0.0 AS score FROM ok WHERE a3 - a1 >= 2 AND a4 - a2 >= 2""")
def mined_labels(spark, d):
    return _mined(spark, d).labels.withColumns({c: r6(c) for c in ("cx", "cy", "w", "h", "score")})


@book.add(f"""WITH {_MINED_SQL}, n AS (SELECT count(*) AS n FROM dt), k AS (SELECT count(*) AS kept FROM ok) SELECT (SELECT count(DISTINCT frame) FROM tr) AS examined, kept, n - kept AS rejected, round(100 * (n - kept) / n, 6) + 0.0 AS rejected_pct FROM n, k""")
def mined_statistics(spark, d):
    return _mined(spark, d).statistics.withColumn("rejected_pct", r6("rejected_pct"))


def _mined(spark, d):
    known, found = _pseudo(spark, d)
    truths = found.where("side = 'O' and class_id = 11").withColumn("truth_id", F.col("det"))
    return pseudo.mine(known, found.where("side = 'F'"), truths, 11, 2, 0.55)


def _variant_sql(name: str, kept: str) -> str:
    both = "(SELECT * REPLACE ('O' AS side) FROM b UNION ALL SELECT * REPLACE ('F' AS side, x1 + frame % 7 AS x1, x2 + frame % 7 AS x2) FROM b)"
    chosen = f"FROM {both} WHERE frame IN (SELECT frame FROM cs) AND (side = 'O' OR {kept})),\n    dt AS"
    one = f"sn AS (SELECT o_orderkey AS frame, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders), cs AS (SELECT frame FROM sn WHERE i % greatest(1, c // 300) = 0 AND i < greatest(1, c // 300) * 300), {_COCO_SQL}"
    made = one.replace("FROM b),\n    dt AS", chosen)
    of = lambda where, c: f"round(avg(ap) FILTER (WHERE {where}), 6) + 0.0 AS {c}"
    all_ = "area_range = 'all'"
    means = ", ".join([of(all_, "map_50_95"), of(f"{all_} AND threshold = 0.5", "map_50"), of("area_range = 'small'", "map_small"), of("area_range = 'large'", "map_large")])
    return f"SELECT * FROM (WITH RECURSIVE {made} SELECT '{name}' AS variant, {means}, (SELECT count(*) FROM cs) AS eval_images FROM cm)"


@book.add(f"{_variant_sql('whole', 'true')} UNION ALL {_variant_sql('sure', 'score > 0.7')}")
def variant_accuracy(spark, d):
    """Two detectors that see every box up to six pixels aside, one of which keeps what it is sure of, on the same 300 strided frames."""
    rows = boxes(spark, d, True).withColumn("gt_id", F.col("frame") * 1000 + F.col("det"))
    gt, aside = rows.drop("score"), F.col("frame") % 7
    det = rows.withColumns({"det_id": F.col("gt_id"), "x1": F.col("x1") + aside, "x2": F.col("x2") + aside})
    seen = lambda images, rows: rows.join(images.select("frame"), "frame", "left_semi")
    variants = {"whole": lambda images: seen(images, det), "sure": lambda images: seen(images, det.where("score > 0.7"))}
    made = suite.accuracies(variants, frames(spark, d), gt, "frame", 300)
    return made.select("variant", *[r6(m).alias(m) for m in suite.METRICS], "eval_images")


@book.add(f"""WITH {BOXES_SQL}, k AS (SELECT frame, list(round(x1, 6) + 0.0 ORDER BY x1, y1, x2, y2) AS lefts FROM b WHERE class_name = 'stop_sign' GROUP BY frame)
    SELECT frame, len(lefts)::INT AS n, lefts[1] AS first_left, lefts[-1] AS last_left FROM k""")
def sign_frames(spark, d):
    made = readers.frames_with(boxes(spark, d).withColumnRenamed("class_name", "label"), "stop_sign", key="frame")
    return made.select("frame", F.size("boxes").alias("n"), r6(F.element_at("boxes", 1)["x1"]).alias("first_left"), r6(F.element_at("boxes", -1)["x1"]).alias("last_left"))


@book.add(f"WITH {STEMS_SQL} SELECT event_id, stem FROM s WHERE event_id % 30 = 0 ORDER BY event_id LIMIT 200")
def strided_frames(spark, d):
    """Every 30th frame, as far as the most frames that a scan of a video takes."""
    return readers.strided_frames(clip_stems(spark, d), "event_id", 30, 200).select("event_id", "stem")
