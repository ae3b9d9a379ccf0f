"""Scans of annotation files, archives, images and logs as DataFrames.

Malformed rows are skipped, missing inputs that must be there are errors.
Paths may name any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import boxes
from kerbside.functions.text import file_name, file_stem

COORDS = ("xmin", "ymin", "xmax", "ymax")
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int,area:double>>, "
    "categories array<struct<id:bigint,name:string>>"
)


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """image_path, label and box of a CSV with a header; rows whose coordinates are no numbers go."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(f"image_path string, label string, {', '.join(f'{c} string' for c in COORDS)}")
    return clean_label_rows(raw.csv(path))


def clean_label_rows(df: DataFrame) -> DataFrame:
    """Text coordinates to numbers; a leading slash of the path goes, and so do rows that do not parse."""
    numbers = [F.expr(f"try_cast({c} AS double)").alias(e) for c, e in zip(COORDS, boxes.EDGES, strict=True)]
    made = df.select(F.ltrim(F.col("image_path"), F.lit("/")).alias("image_path"), "label", *numbers)
    return made.where(" and ".join(f"{e} is not null" for e in boxes.EDGES))


def boxes_by_image(df: DataFrame) -> DataFrame:
    from kerbside.operators.annotations import box_lists

    return box_lists(df, "image_path", ["label", *boxes.EDGES])


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, ordinal, member (no leading slash) and content of every file in zip archives; one archive is one task."""

    def run(parts: Iterator) -> Iterator:
        import io
        import zipfile

        import pandas as pd

        for pdf in parts:
            for r in pdf.itertuples():
                with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                    for n, info in enumerate(z.infolist()):
                        if not info.is_dir() and info.filename.lower().endswith(suffix.lower()):
                            yield pd.DataFrame([(r.path, n, info.filename.lstrip("/"), z.read(info))], columns=["archive", "ordinal", "member", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, ordinal bigint, member string, content binary")


def by_basename(members: DataFrame) -> DataFrame:
    """One member per base name, the last of the archive."""
    return members.groupBy(file_name(F.col("member")).alias("basename")).agg(F.max_by("member", "ordinal").alias("member"))


def csv_in_zip(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """label_csv of the CSV files in archives."""
    lines = zip_members(spark, path, suffix).select(F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r?\n")).alias("n", "line"))
    fields = F.from_csv(F.col("line"), f"image_path string, label string, {', '.join(f'{c} string' for c in COORDS)}")
    return clean_label_rows(lines.where("n > 0 and line <> ''").select(fields.alias("r")).select("r.*"))


def coco(spark: SparkSession, path: str, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations (x1..y2 from x, y, w, h) and categories of a COCO file.

    With ``wanted`` it is an error that no such category is there.
    """
    doc = spark.read.option("multiLine", True).schema(COCO).json(path)
    return coco_tables(doc, wanted)


def coco_in_zip(spark: SparkSession, path: str, member: str, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = zip_members(spark, path, member).select(F.from_json(F.decode("content", "UTF-8"), COCO).alias("d"))
    return coco_tables(text.select("d.*"), wanted)


def coco_tables(doc: DataFrame, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    rows = doc.select(F.explode("annotations").alias("a")).select("a.*")
    box = boxes.from_xywh(*[F.get("bbox", F.lit(i)) for i in range(4)])
    anns = rows.select(F.col("id").alias("ann_id"), "image_id", "category_id", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), *[b.alias(e) for b, e in zip(box, boxes.EDGES, strict=True)])
    cats = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    if wanted is not None and cats.where(F.col("category").isin(*wanted)).isEmpty():
        raise ValueError(f"none of the categories {wanted} is in the file")
    return images, anns, cats


def label_lines(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """stem, line_no, cls, cx, cy, w, h of label files (one per image); lines without exactly five numbers go."""
    raw = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("stem"), "value")
    return parse_label_lines(raw.where(F.col("stem").startswith(prefix)))


def parse_label_lines(df: DataFrame) -> DataFrame:
    lines = df.select("stem", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    parts = lines.select("stem", "line_no", F.split(F.trim("line"), r"\s+").alias("p")).where(F.size("p") == 5)
    number = lambda i, kind: F.expr(f"try_cast(p[{i}] AS {kind})")
    made = parts.select("stem", "line_no", F.expr("cast(try_cast(p[0] AS double) AS int)").alias("cls"), *[number(i + 1, "double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    return made.where("cls is not null and cx is not null and cy is not null and w is not null and h is not null")


def label_truth(lines: DataFrame, images: DataFrame, names: dict[int, str]) -> DataFrame:
    """Ground truth in COCO terms: image_id and ann_id from 1, category_id from 1, x, y, w, h in pixels, area.

    ``images`` has stem, width, height; images without labels stay, with null annotations.
    Ids follow the order of stem and line, numbered range by range.
    """
    from kerbside.operators.annotations import numbered_globally

    known = numbered_globally(images.select("stem", "width", "height"), "image_id", ["stem"])
    rows = known.join(lines.where(F.col("cls").isin(*names)), "stem", "left")
    box = boxes.from_normalised([F.col(c) for c in ("cx", "cy", "w", "h")], F.col("width"), F.col("height"))
    x, y, w, h = boxes.to_xywh(box)
    made = rows.select("image_id", "stem", "width", "height", "line_no", (F.col("cls") + 1).alias("category_id"), x.alias("x"), y.alias("y"), w.alias("bw"), h.alias("bh"))
    found = numbered_globally(made.where("line_no is not null"), "ann_id", ["image_id", "line_no"])
    empty = made.where("line_no is null").withColumn("ann_id", F.lit(None).cast("bigint"))
    return found.unionByName(empty).withColumn("area", F.col("bw") * F.col("bh"))


def image_files(spark: SparkSession, path: str, pattern: str = "*.jpg", limit: int | None = None) -> DataFrame:
    """path, stem and content of image files in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    made = files.withColumn("stem", file_stem(F.col("path")))
    return made if limit is None else made.orderBy("path").limit(limit)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise FileNotFoundError(message)
    return df


def image_size(content: Column) -> Column:
    """struct(width, height) from the header of a JPEG or PNG, null for anything else; pixels are not decoded."""

    @F.pandas_udf("width int, height int")
    def run(raw):
        import pandas as pd

        return pd.DataFrame([header_size(x) or (None, None) for x in raw], columns=["width", "height"]).astype("Int32")

    return run(content)


def header_size(raw: bytes | None) -> tuple[int, int] | None:
    if not raw:
        return None
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR":
        return int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    if raw[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(raw):
        if raw[at] != 0xFF:
            return None
        kind = raw[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, nChannels, data; files that are no images go."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def frames_with(boxes_: DataFrame, label: str, limit: int | None = None, key: str = "image_path") -> DataFrame:
    """Per image with a box of ``label`` its sorted boxes; the first ``limit`` images by key."""
    rows = boxes_.where(F.col("label") == label).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*boxes.EDGES))).alias("boxes"))
    return rows if limit is None else rows.orderBy(key).limit(limit)


def strided_frames(frames: DataFrame, index: str, stride: int = 1, limit: int | None = None) -> DataFrame:
    rows = frames.where(F.col(index) % stride == 0)
    return rows if limit is None else rows.orderBy(index).limit(limit)


def json_or_none(spark: SparkSession, path: str) -> dict | None:
    """A small JSON artefact as a dictionary; None where it is missing or malformed."""
    import json

    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).head(1)
        return json.loads(rows[0]["value"]) if rows else None
    except (AnalysisException, ValueError):
        return None


def epoch_curve(spark: SparkSession, path: str) -> DataFrame:
    """epoch and value of a training log: the last number of every line that starts with ``all``."""
    return parse_epochs(spark.read.text(path, wholetext=True))


def parse_epochs(df: DataFrame, value: str = "value") -> DataFrame:
    lines = df.select(F.filter(F.transform(F.split(value, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("all ")).alias("l"))
    last = F.transform("l", lambda x: F.element_at(F.split(x, r"\s+"), -1))
    made = lines.select(F.posexplode(F.filter(last, lambda x: F.try_to_number(x, F.lit("999999.999999")).isNotNull())).alias("epoch", "t"))
    return made.select((F.col("epoch") + 1).alias("epoch"), F.expr("try_cast(t AS double)").alias("value"))
