"""Adapter views: the relational tables seen as boxes, frames, stems, hashes and tracks.

Each view is plain arithmetic, written once for Spark and once, in SQL, for the
engine that checks the results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.functions.hashing import rise_bits, simhash

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                # a nudge, here and in r6, lets both engines round exact halves the same way
                self.sql[f.__name__] = sql.replace(", 6) + 0.0", " + 1e-9, 6) + 0.0")
            return f

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, 6) + 0.0


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def boxes(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """frame, class_name, box, score and, if ``numbered``, ``det``: the box's place in its frame."""
    rows = read(spark, sf_dir, "lineitem")
    side = (F.col("l_partkey") % 600 + 4).cast("double")
    cx = ((F.col("l_suppkey") * 37) % 1920).cast("double")
    y2 = F.least(F.lit(1080.0), F.lit(500.0) + 12 * F.col("l_quantity"))
    made = rows.withColumns(
        {
            "frame": F.col("l_orderkey"),
            "class_name": F.when(F.col("l_returnflag") == "A", "cone").when(F.col("l_returnflag") == "N", "barrier").otherwise("stop_sign"),
            "x1": cx - side / 2, "y1": y2 - side, "x2": cx + side / 2, "y2": y2,
            "score": F.lit(0.5) + 5 * F.col("l_discount") + 0.0,
            "side": F.col("l_linestatus"),
        }
    )
    out = ["frame", "class_name", "x1", "y1", "x2", "y2", "score", "side"]
    if numbered:
        made = made.withColumn("det", F.row_number().over(Window.partitionBy("frame").orderBy(*LINE_ORDER)))
        out.append("det")
    return made.select(*out)


BOXES_SQL = f"""b AS (
    SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {", ".join(LINE_ORDER)})::INT AS det FROM (
        SELECT l_orderkey AS frame, CASE l_returnflag WHEN 'A' THEN 'cone' WHEN 'N' THEN 'barrier' ELSE 'stop_sign' END AS class_name,
               (l_suppkey * 37 % 1920)::DOUBLE - (l_partkey % 600 + 4)::DOUBLE / 2 AS x1,
               least(1080.0::DOUBLE, 500.0::DOUBLE + 12 * l_quantity) - (l_partkey % 600 + 4)::DOUBLE AS y1,
               (l_suppkey * 37 % 1920)::DOUBLE + (l_partkey % 600 + 4)::DOUBLE / 2 AS x2,
               least(1080.0::DOUBLE, 500.0::DOUBLE + 12 * l_quantity) AS y2,
               0.5::DOUBLE + 5 * l_discount + 0.0 AS score, l_linestatus AS side, {", ".join(LINE_ORDER)}
        FROM lineitem))"""


#: Greedy suppression of boxes o (frame, n by rank, x1 .. y2): the ranks kept so far go from box to box of a frame.  Needs WITH RECURSIVE.
SUPPRESSED_SQL = """near AS (SELECT a.frame, a.n, list(c.n) AS before_ FROM o a JOIN o c ON a.frame = c.frame AND c.n < a.n
        AND greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) > 0.45 * greatest((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1)
        - greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0), 1e-12) GROUP BY a.frame, a.n),
    walk(frame, n, held) AS (SELECT frame, 0::BIGINT, []::BIGINT[] FROM o WHERE n = 1
        UNION ALL SELECT w.frame, o.n, CASE WHEN list_has_any(w.held, coalesce(near.before_, [])) THEN w.held ELSE list_append(w.held, o.n) END FROM walk w JOIN o ON o.frame = w.frame AND o.n = w.n + 1 LEFT JOIN near ON near.frame = o.frame AND near.n = o.n),
    kept AS (SELECT o.* FROM o JOIN walk w ON w.frame = o.frame AND w.n = o.n AND list_contains(w.held, o.n))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.col("o_orderstatus").alias("split"))


def clip_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem ``rw_<city>_<12 hex digits>_<day>_<ms of day>`` of every event."""
    e = read(spark, sf_dir, "events")
    ms = F.expr("hour(ts) * 3600000L + minute(ts) * 60000L + cast(second(ts) as long) * 1000L + cast(floor(cast(date_format(ts, 'SSSSSS') as long) / 1000) as long)")
    stem = F.concat_ws("_", F.lit("rw"), F.col("event_type"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 12), F.date_format("ts", "yyyyMMdd"), ms.cast("string"))
    return e.select(stem.alias("stem"), "event_id", "user_id", "event_type")


STEMS_SQL = """s AS (
    SELECT 'rw_' || event_type || '_' || substr(md5(user_id::VARCHAR), 1, 12) || '_' || strftime(ts, '%Y%m%d') || '_' ||
           (hour(ts)::BIGINT * 3600000 + minute(ts)::BIGINT * 60000 + (microsecond(ts) // 1000)::BIGINT)::VARCHAR AS stem,
           event_type AS city, substr(md5(user_id::VARCHAR), 1, 12) AS video, strftime(ts, '%Y%m%d') AS seq,
           hour(ts)::BIGINT * 3600000 + minute(ts)::BIGINT * 60000 + (microsecond(ts) // 1000)::BIGINT AS frame_ms, event_id, user_id, event_type
    FROM events)"""


def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("prefix"), F.col("event_id").alias("idx"))


def vector_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", rise_bits(F.col("embedding")).alias("h"))


VECTORS_SQL = """v AS (
    SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1 ELSE 0 END::BIGINT)),
           lambda a, x: a * 2 + x) AS h FROM embeddings)"""


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48-bit majority hash over the distinct words of each document."""
    return simhash(read(spark, sf_dir, "documents"), "doc_id", F.split(F.lower("text"), " "), 48)


DOCUMENTS_SQL = """w AS (
    SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents
), c AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 12))::BIGINT AS code FROM w
), dh AS (
    SELECT doc_id, sum(bit)::BIGINT AS h FROM (
        SELECT doc_id, i, CASE WHEN sum(CASE WHEN (code >> i) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN 1::BIGINT << i ELSE 0 END AS bit
        FROM c, (SELECT unnest(range(48))::INT AS i) GROUP BY doc_id, i) GROUP BY doc_id)"""


def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (lang, source): a source and a group of documents."""
    return read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source"), F.col("source").alias("grp")).agg(F.count("*").alias("n"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), seconds.alias("t"), F.col("value").alias("z"), "event_id", "event_type")


TRACKS_SQL = "t AS (SELECT user_id AS track, epoch_us(ts) / 1e6 AS t, value AS z, event_id, event_type FROM events)"
