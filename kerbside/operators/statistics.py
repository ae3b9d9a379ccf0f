"""Timings, ratios to a baseline, and curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.quantiles import percentiles


def last_pass(df: DataFrame, variant: str, number: str) -> DataFrame:
    """The measurements of the last pass of each variant; earlier ones warm up."""
    return df.withColumn("_last", F.max(number).over(Window.partitionBy(variant))).where(F.col(number) == F.col("_last")).drop("_last")


def latency(df: DataFrame, variant: Sequence[str], ms: str) -> DataFrame:
    """Per variant: n, p50_ms, mean_ms, p90_ms, fps (from the median; infinite at 0)."""
    made = percentiles(df, variant, F.col(ms), [0.5, 0.9], aggregates=[F.count("*").alias("_all"), F.avg(ms).alias("mean_ms")])
    p50 = F.get("q", F.lit(0))
    return made.select(*variant, F.col("_all").alias("n"), p50.alias("p50_ms"), "mean_ms", F.get("q", F.lit(1)).alias("p90_ms"), frames_per_second(p50).alias("fps"))


def frames_per_second(ms: Column) -> Column:
    return F.when(ms > 0, 1000.0 / ms).otherwise(F.lit(float("inf")))


def ratio(part: Column, whole: Column, missing: float | None = None) -> Column:
    out = F.when(whole != 0, part / whole)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def against_baseline(df: DataFrame, variant: str, baseline: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``speedup``: the baseline's value in the same group over the row's own; null where the group has none."""
    base = F.max(F.when(F.col(variant) == baseline, F.col(value))).over(Window.partitionBy(*(by or [F.lit(0)])))
    return df.withColumn("speedup", ratio(base, F.col(value)))


def zip_curves(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """Two curves side by side by their ordinal ``epoch``, as far as both go, with ``delta`` = a - b."""
    number = F.row_number().over(Window.orderBy(order))
    left = a.select(number.alias("epoch"), F.col(value).alias("a"))
    right = b.select(number.alias("epoch"), F.col(value).alias("b"))
    return left.join(right, "epoch").withColumn("delta", F.col("a") - F.col("b"))


def mean_lead(curves: DataFrame, warm_up: int = 3) -> DataFrame:
    return curves.where(F.col("epoch") <= warm_up).agg(F.avg("delta").alias("mean_lead"))


def sparsity(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """zeros, total and their ratio, of weights as rows."""
    made = df.groupBy(*by).agg(F.count_if(F.col(value) == 0).alias("zeros"), F.count(value).alias("total"))
    return made.withColumn("sparsity", ratio(F.col("zeros"), F.col("total"), 0.0))


def without_smallest(df: DataFrame, value: str, amount: float, ties: Sequence[str]) -> DataFrame:
    """The weights with the given share of smallest magnitude, over the whole table, set to 0; equal magnitudes go by ``ties``."""
    from kerbside.operators.annotations import numbered_globally

    known = df.withColumn("_size", F.abs(value)).where("_size is not null")
    cut_at = round(amount * known.count())
    ranked = numbered_globally(known, "_nth", ["_size", *ties])
    return ranked.withColumn(value, F.when(F.col("_nth") > cut_at, F.col(value)).otherwise(F.lit(0.0))).drop("_size", "_nth")


def parameter_counts(df: DataFrame, layer: str, value: str) -> DataFrame:
    """Per layer, and over all (a null layer), how many weights there are and how many are trained away to 0."""
    made = df.rollup(layer).agg(F.count(value).alias("parameters"), F.count_if(F.col(value) == 0).alias("zeros"))
    return made.withColumn("nonzero", F.col("parameters") - F.col("zeros"))


def headline(metrics: DataFrame, name: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """One row with the wanted metrics as columns, of a table of names and values; null where one is missing or not finite."""
    at = lambda m: F.max(F.when(F.col(name) == m, F.col(value)))
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return metrics.agg(*[fine(at(m)).alias(m) for m in wanted])


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows in ``order``."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
