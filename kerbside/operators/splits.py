"""Deterministic splits and samples, and the audit of a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.hashing import fraction
from kerbside.operators.scans import Ordered


def hash_split(df: DataFrame, key: Column, share: float, seed: int = 0) -> DataFrame:
    """Add ``split``: val where the key's hash fraction is under ``share``."""
    return df.withColumn("split", F.when(fraction(key, seed) < share, "val").otherwise("train"))


def greedy_fill(groups: DataFrame, source: str, rank: Column, size: str, share: float, ties: Sequence[str]) -> DataFrame:
    """Add ``split``: groups go to val in the order of ``rank`` while those before them hold less than the share of their source."""
    made = Ordered.of(groups.withColumns({"_rank": rank, "_own": F.coalesce(F.col(size), F.lit(0))}), [source], ["_rank", *ties])
    made = made.running(sums={"_upto": F.col("_own")}).running(sums={"_from": F.col("_own")}, back=True).done()
    before, total = F.col("_upto") - F.col("_own"), F.col("_upto") + F.col("_from") - F.col("_own")
    return made.withColumn("split", F.when(before < share * total, "val").otherwise("train")).drop("_rank", "_own", "_upto", "_from")


def split_summary(groups: DataFrame, source: str, size: str) -> DataFrame:
    val = F.col("split") == "val"
    out = groups.groupBy(source).agg(
        F.count("*").alias("groups"), F.count_if(val).alias("val_groups"), F.sum(size).alias("images"),
        F.coalesce(F.sum(F.when(val, F.col(size))), F.lit(0)).alias("val_images"),
    )
    return out.withColumn("fraction", F.when(F.col("images") > 0, F.round(F.col("val_images") / F.col("images"), 4)).otherwise(F.lit(0.0)))


def stride_sample(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """About ``k`` evenly strided rows, and never more: every max(1, n div k)-th."""
    from kerbside.operators.annotations import numbered_globally

    n = df.count()
    step = max(1, n // k)
    made = numbered_globally(df, "_i", order).withColumn("_i", F.col("_i") - 1)
    return made.where((F.col("_i") % step == 0) & (F.col("_i") < step * k)).drop("_i")


def linspace_sample(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows at the truncated places of an even spacing from the first to the last."""
    from kerbside.operators.annotations import numbered_globally

    n = df.count()
    if n == 0 or k <= 0:
        return df.limit(0)
    place = lambda i: F.floor(i * F.lit((n - 1) / max(k - 1, 1))).cast("long")
    wanted = df.sparkSession.range(min(k, n) if k < 2 else k).select(place(F.col("id")).alias("_w")).distinct()
    made = numbered_globally(df, "_i", order).withColumn("_i", F.col("_i") - 1)
    return made.join(F.broadcast(wanted), F.col("_i") == F.col("_w"), "left_semi").drop("_i")


def head_of_each(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_split_wins(df: DataFrame, stem: str = "stem", split: str = "split") -> DataFrame:
    """One row per stem, of the split that sorts last, and whether it was in several."""
    return df.groupBy(stem).agg(F.max(split).alias(split), (F.count_distinct(split) > 1).alias("duplicated"))


def shared_keys(df: DataFrame, key: str, split: str = "split", a: str = "train", b: str = "val") -> DataFrame:
    return df.where(F.col(split) == a).select(key).intersect(df.where(F.col(split) == b).select(key))


def affected(df: DataFrame, key: str, split: str = "split", val: str = "val") -> DataFrame:
    """One row: shared groups, val rows in them, and their percentage of val."""
    both = shared_keys(df, key, split, b=val)
    rows = df.where(F.col(split) == val).groupBy(key).agg(F.count("*").alias("_n"))
    part = rows.join(both.withColumn("_in", F.lit(True)), key, "left")
    return part.agg(
        F.count("_in").alias("shared"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("_n"))), F.lit(0)).alias("affected"),
        F.coalesce(100.0 * F.sum(F.when(F.col("_in"), F.col("_n"))) / F.sum("_n"), F.lit(0.0)).alias("affected_pct"),
    )


def apply_assignment(labels: DataFrame, assignment: DataFrame, dropped: DataFrame | None = None, stem: str = "stem") -> DataFrame:
    """Labels in their new splits, without the dropped stems; the tables themselves never change."""
    rows = labels.drop("split").join(assignment.select(stem, "split"), stem)
    return rows if dropped is None else rows.join(dropped.select(stem), stem, "left_anti")
