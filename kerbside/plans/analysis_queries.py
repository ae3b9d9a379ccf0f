"""Curves, conditions, tracks and event windows over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.operators import evaluation, statistics, tracking
from kerbside.plans.fixtures import BOXES_SQL, SUPPRESSED_SQL, TRACKS_SQL, Book, boxes, r6, read, tracks
from kerbside.streaming import flows

book = Book()

_CURVE_SQL = """s AS (SELECT d.doc_id, d.lang, d.n_chars AS score, l.quality AS y FROM documents d JOIN labels l USING (doc_id)),
    k AS (SELECT *, row_number() OVER w AS rank, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER (PARTITION BY lang) AS total FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id)),
    r AS (SELECT lang, rank, tp / total AS recall, max(tp / rank) OVER (PARTITION BY lang ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM k WHERE total > 0)"""


@book.add(f"""WITH {_CURVE_SQL}, p AS (SELECT unnest(range(101)) / 100 AS pt)
    SELECT lang, round(avg(coalesce(best, 0)), 6) + 0.0 AS ap FROM (SELECT l.lang, pt, (SELECT max(envelope) FROM r WHERE r.lang = l.lang AND recall >= pt - 1e-11) AS best FROM (SELECT DISTINCT lang FROM r) l, p) GROUP BY lang""")
def average_precision(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.col("n_chars").alias("score"), F.col("quality").alias("y"))
    curve = evaluation.precision_recall(rows, ["lang"], ["-score", "doc_id"], F.col("y") == 1).where("recall is not null")
    return evaluation.interpolated(curve, ["lang"]).select("lang", r6("ap").alias("ap"))


_MEAN_SQL = "m AS (SELECT event_type AS condition, avg(value) AS metric FROM events GROUP BY event_type), c AS (SELECT metric AS clean FROM m WHERE condition = 'view')"


@book.add(f"WITH {_MEAN_SQL}, r AS (SELECT condition, CASE WHEN clean > 0 THEN metric / clean ELSE 0 END AS retained FROM m, c WHERE condition <> 'view') SELECT round(avg(retained), 6) + 0.0 AS score, count(*) AS conditions FROM r")
def retained_score(spark, d):
    means = read(spark, d, "events").groupBy(F.col("event_type").alias("condition")).agg(F.avg("value").alias("metric"))
    made = evaluation.retained(means, "condition", "metric", "view")
    return made.agg(r6(F.avg("retained")).alias("score"), F.count("*").alias("conditions"))


@book.add(f"""WITH {_MEAN_SQL} SELECT condition, round(metric / clean, 6) + 0.0 AS retained, round(100 * metric / clean, 6) + 0.0 AS percent, round(1000 / metric, 6) + 0.0 AS fps,
    row_number() OVER (ORDER BY metric / clean DESC, condition)::INT AS place FROM m, c WHERE condition <> 'view'""")
def conditions_ranked(spark, d):
    from pyspark.sql import Window

    means = read(spark, d, "events").groupBy(F.col("event_type").alias("condition")).agg(F.avg("value").alias("metric"))
    made = evaluation.retained(means, "condition", "metric", "view")
    place = F.row_number().over(Window.orderBy(F.col("retained").desc(), "condition"))
    return made.select("condition", r6("retained").alias("retained"), r6(100 * F.col("retained")).alias("percent"), r6(statistics.frames_per_second(F.col("metric"))).alias("fps"), place.alias("place"))


_DAYS_SQL = """n AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
    a AS (SELECT row_number() OVER (ORDER BY day)::INT AS epoch, n AS a FROM n WHERE event_type = 'view'), b AS (SELECT row_number() OVER (ORDER BY day)::INT AS epoch, n AS b FROM n WHERE event_type = 'purchase')"""


@book.add(f"WITH {_DAYS_SQL} SELECT epoch, a, b, a - b AS delta, (SELECT round(avg(a - b), 6) + 0.0 FROM a JOIN b USING (epoch) WHERE epoch <= 3) AS mean_lead FROM a JOIN b USING (epoch)")
def curve_zip_lead(spark, d):
    days = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    of = lambda x: days.where(F.col("event_type") == x)
    both = statistics.zip_curves(of("view"), of("purchase"), "day", "n")
    lead = statistics.mean_lead(both).select(r6("mean_lead").alias("mean_lead"))
    return both.join(F.broadcast(lead))


@book.add(f"""WITH {TRACKS_SQL}, w AS (SELECT *, count(*) OVER f AS n, regr_slope(z, t - 1704067200) OVER f AS rate, max(t) OVER f - min(t) OVER f AS span FROM t WINDOW f AS (PARTITION BY track ORDER BY t, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
    r AS (SELECT track, event_id, z, CASE WHEN n >= 4 AND span >= 1e-6 THEN rate END AS rate FROM w)
    SELECT track, event_id, round(1e6 * rate, 4) + 0.0 AS rate_micro, round(CASE WHEN rate < -1e-3 THEN -z / rate END, 2) + 0.0 AS ttc FROM r""")
def range_rate_ttc(spark, d):
    rows = tracks(spark, d).withColumn("t", F.col("t") - 1704067200)
    made = tracking.range_rates(rows, "track", "t", "z", ["event_id"])
    return made.select("track", "event_id", (F.round(1e6 * F.col("range_rate"), 4) + 0.0).alias("rate_micro"), (F.round("ttc", 2) + 0.0).alias("ttc"))


@book.add(f"""WITH {TRACKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY track) AS hits FROM t)
    SELECT track, hits, arg_max(z, n) AS first_distance, arg_min(z, n) AS last_distance FROM k WHERE n <= 12 GROUP BY track, hits""")
def track_endpoints(spark, d):
    return tracking.endpoints(tracks(spark, d), "track", "t", "z", ["event_id"])


@book.add()
def tracker(spark, d):
    """A supplier's lines of one month of shipping as a clip, their orders as frames; so clips do not grow with the table's suppliers or years."""
    clip = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM"))
    rows = read(spark, d, "lineitem").select(clip.alias("clip"), F.col("l_orderkey").alias("frame_no"), "l_linenumber", "l_quantity", "l_returnflag")
    box = rows.select(
        "clip", "frame_no", F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "A", "cone").otherwise("barrier").alias("class_name"),
        (100.0 + 40 * F.col("l_linenumber")).alias("x1"), F.lit(100.0).alias("y1"), (160.0 + 40 * F.col("l_linenumber")).alias("x2"), F.lit(180.0).alias("y2"), F.col("l_quantity").alias("distance_m"),
    )
    return tracking.track(box, "clip", "frame_no", "n")


@book.add("""SELECT event_type, epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    rows = flows.with_event_time(read(spark, d, "events"), "ts")
    made = flows.windowed_counts(rows, "ts", ["event_type"], "value", "6 hours")
    return made.select("event_type", F.unix_seconds("window_start").alias("window_start"), "n", r6("total").alias("total"))


@book.add("""WITH s AS (SELECT event_type, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL (k * 3) HOUR AS start FROM events, (VALUES (0), (1)) t(k))
    SELECT event_type, epoch(start)::BIGINT AS window_start, count(*) AS n FROM s GROUP BY ALL""")
def event_sliding_windows(spark, d):
    rows = flows.with_event_time(read(spark, d, "events"), "ts")
    made = flows.windowed_counts(rows, "ts", ["event_type"], "value", "6 hours", "3 hours")
    return made.select("event_type", F.unix_seconds("window_start").alias("window_start"), "n")


@book.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL '8 hours') AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, d):
    made = flows.sessions(flows.with_event_time(read(spark, d, "events"), "ts"), "ts", ["user_id"], "8 hours")
    return made.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@book.add(f"""WITH RECURSIVE {BOXES_SQL}, h AS (SELECT frame, det AS anchor, greatest(score - 0.3, score - 0.5) AS score, x1 / 3 AS cx, y2 / 3 + 140 AS cy, (x2 - x1) / 3 AS w, (y2 - y1) / 3 AS h FROM b),
    e AS (SELECT *, cx - w / 2 AS ex1, cy - h / 2 AS ey1 FROM h WHERE score > 0.25),
    o AS (SELECT frame, anchor, score, ex1 AS x1, ey1 AS y1, ex1 + w AS x2, ey1 + h AS y2, row_number() OVER (PARTITION BY frame ORDER BY score DESC, anchor) AS n FROM e), {SUPPRESSED_SQL}
    SELECT frame, anchor, 0 AS class_id, round(score, 6) + 0.0 AS score, {", ".join(f"round(least(greatest(({e} - {pad}) / (1 / 3.0::DOUBLE), 0), {top}), 3) + 0.0 AS {e}" for e, pad, top in (("x1", 0, 1919), ("y1", 140, 1079), ("x2", 0, 1919), ("y2", 140, 1079)))} FROM kept""")
def letterboxed_heads(spark, d):
    """Synthetic network outputs decoded to boxes."""
    from kerbside.operators.matching import decode_head

    rows = boxes(spark, d, True).select(
        F.col("frame"), F.col("det").alias("anchor"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), (F.col("x1") / 3).alias("cx"), (F.col("y2") / 3 + 140).alias("cy"),
        ((F.col("x2") - F.col("x1")) / 3).alias("w"), ((F.col("y2") - F.col("y1")) / 3).alias("h"), F.array(F.col("score") - 0.3, F.col("score") - 0.5).alias("scores"),
    )
    made = decode_head(rows, "frame")
    return made.select("frame", "anchor", "class_id", r6("score").alias("score"), *[(F.round(F.col(e).cast("double"), 3) + 0.0).alias(e) for e in ("x1", "y1", "x2", "y2")])
