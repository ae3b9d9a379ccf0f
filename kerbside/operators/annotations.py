"""Cleaning, joining and counting of annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import boxes


def drop_crowds(df: DataFrame, flag: str = "iscrowd") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(0)) == 0)


def fold_aliases(df: DataFrame, aliases: Mapping[str, str], classes: Sequence[str], label: str = "label") -> DataFrame:
    """Aliases become their class; rows of no class go."""
    folded = F.col(label)
    for alias, name in aliases.items():
        folded = F.when(F.col(label) == alias, name).otherwise(folded)
    return df.withColumn(label, folded).where(F.col(label).isin(*classes))


def drop_small(df: DataFrame, side: float) -> DataFrame:
    """Rows whose box is at least ``side`` wide and high."""
    return df.where(boxes.at_least(boxes.columns(), side))


def map_categories(df: DataFrame, mapping: Mapping[str, str], category: str = "category", unmapped: str = "drop") -> DataFrame:
    """Add ``class_name`` by an inner join with the broadcast mapping, a configuration table."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"{category} string, class_name string")
    return df.join(F.broadcast(table), category, "inner" if unmapped == "drop" else "left")


def with_negatives(images: DataFrame, annotations: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Images beside their annotations; images without any stay if ``keep``."""
    return images.join(annotations, key, "left" if keep else "inner")


def box_lists(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with the sorted list of its boxes."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("boxes"))


def fit_to_side(df: DataFrame, width: Column, height: Column, max_side: float, min_side: float = 2.0) -> DataFrame:
    """Boxes and image sizes after shrinking to ``max_side`` and clipping; boxes that become smaller than ``min_side`` go."""
    s = boxes.shrink_factor(width, height, max_side)
    new_w, new_h = F.bround(width * s, 0), F.bround(height * s, 0)
    made = df.withColumns({"_s": s, "_w": F.when(s < 1, new_w).otherwise(width), "_h": F.when(s < 1, new_h).otherwise(height)})
    box = boxes.clipped(boxes.scaled(boxes.columns(), F.col("_s")), F.col("_w"), F.col("_h"))
    made = made.withColumns(dict(zip(boxes.EDGES, box, strict=True)))
    return drop_small(made, min_side).withColumnsRenamed({"_s": "scale", "_w": "new_width", "_h": "new_height"})


def class_counts(images: DataFrame, annotations: DataFrame, key: str, split: str, class_name: str) -> DataFrame:
    """(split, class, n): boxes of each class, and the rows __images__ and __negatives__."""
    sizes = annotations.groupBy(key).agg(F.count("*").alias("_n"))
    per_image = images.select(key, split).join(sizes, key, "left")
    totals = per_image.groupBy(split).agg(
        F.count("*").alias("__images__"), F.count_if(F.col("_n").isNull()).alias("__negatives__")
    )
    long = totals.unpivot(split, ["__images__", "__negatives__"], class_name, "n")
    boxes_ = annotations.join(images.select(key, split), key).groupBy(split, class_name).agg(F.count("*").alias("n"))
    return boxes_.unionByName(long)


def thin_classes(counts: DataFrame, classes: Sequence[str], class_name: str, least: int = 50) -> DataFrame:
    """Classes with fewer than ``least`` boxes; a missing class has 0."""
    table = counts.sparkSession.createDataFrame([(c,) for c in classes], f"{class_name} string")
    return F.broadcast(table).join(counts, class_name, "left").select(class_name, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def best_class(scores: Column) -> Column:
    """struct(class_id, score): the first highest score."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("class_id"), top.alias("score"))


def above_confidence(df: DataFrame, scores: Column, conf: float) -> DataFrame:
    return df.withColumn("_best", best_class(scores)).where(F.col("_best.score") > conf).select("*", "_best.*").drop("_best")


def size_histogram(df: DataFrame, class_name: str) -> DataFrame:
    """Boxes by size band, of all classes (class ``__all__``) and of each."""
    banded = df.select(F.col(class_name).alias("_class"), boxes.size_band(boxes.area(boxes.columns())).alias("band"))
    sets = [[F.col("band")], [F.col("_class"), F.col("band")]]
    counted = banded.groupingSets(sets, F.col("_class"), F.col("band")).agg(F.grouping("_class").alias("_all"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("_all") == 1, "__all__").otherwise(F.col("_class")).alias("class_name"), "band", "n")


def matched_members(images: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Images that have a member, and the number of those that have none."""
    return images.join(members, key), images.join(members, key, "left_anti").agg(F.count("*").alias("missing"))


def union_sources(**sources: DataFrame) -> DataFrame:
    """All rows with the name of their source; columns that one lacks are null."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("provenance", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def append_pseudo_labels(labels: DataFrame, pseudo: DataFrame, provenance: str = "pseudo", min_side: float = 6.0) -> DataFrame:
    """Labels and the pseudo boxes that are large enough.  Boxes of an earlier run with this provenance are replaced."""
    old = labels.where(~F.col("provenance").eqNullSafe(F.lit(provenance)))
    return old.unionByName(drop_small(pseudo, min_side).withColumn("provenance", F.lit(provenance)), allowMissingColumns=True)


def numbered(df: DataFrame, name: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ids from 1 in ``order``, within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def numbered_globally(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Ids from 1 over the whole table: range partitions, as many as the session deals, are numbered inside, after what comes before them.

    The sort is done once and its rows are kept in the shared folder, so both passes see the same partitions.
    """
    from kerbside.storage import cut

    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    placed = placed.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_p", "_place", "_start")
