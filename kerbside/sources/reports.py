"""Sections of a dataset and model report, each a heading and tables over small frames.

A section takes a frame, or None where its job has not been run, which it says.
Tables that a section shows are aggregates; ``writers.markdown`` refuses larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import statistics
from kerbside.sources.writers import markdown

MISSING = "_no results yet_"


def section(heading: str, *parts: str | None) -> str:
    """A heading over the parts there are."""
    shown = [p for p in parts if p]
    return "\n\n".join([f"## {heading}", *(shown or [MISSING])])


def dataset(counts: DataFrame | None, origins: DataFrame | None = None, classes: Sequence[str] = (), split: str = "split", name: str = "class_name") -> str:
    """Images, negatives and boxes of each class per split, from ``annotations.class_counts``, and images by origin, most first."""
    if counts is None:
        return section("Dataset")
    wide = counts.groupBy(split).pivot(name, ["__images__", "__negatives__", *classes]).agg(F.sum("n")).na.fill(0)
    wide = wide.withColumnsRenamed({"__images__": "images", "__negatives__": "negatives"})
    listed = None if origins is None else markdown(origins.orderBy(F.col("images").desc(), "prefix"), ["prefix", "images"])
    return section("Dataset", markdown(wide.orderBy(split), [split, "images", "negatives", *classes]), listed)


def mining(mined: DataFrame | None, completed: DataFrame | None = None) -> str:
    """What mining examined, kept and rejected, and what completion added per split."""
    first = None if mined is None else markdown(mined, ["examined", "kept", "rejected", "rejected_pct"], 1)
    second = None if completed is None else markdown(completed.orderBy("split"), ["split", "images_scanned", "images_modified", "boxes_added"])
    return section("Pseudo-labels", first, second)


def integrity(verdict: DataFrame | None, embargoed: int | None = None) -> str:
    """The row of ``datasets.leakage_check``, the verdict in words, and the frames that a re-split left out."""
    if verdict is None:
        return section("Split integrity")
    row = verdict.first()
    told = "**leaks between the splits were found**" if row["leaked"] else "**no leak was found**"
    dropped = None if embargoed is None else f"Frames left out at the ends of runs: {embargoed}"
    return section("Split integrity", markdown(verdict, [c for c in verdict.columns if c != "leaked"], 2), told, dropped)


def detection(metrics: DataFrame | None, classes: DataFrame | None = None) -> str:
    """A row per model, best first by its first metric, and per class those of the best."""
    if metrics is None:
        return section("Detection")
    columns = [c for c in metrics.columns if c != "model"]
    per = None if classes is None else markdown(classes.orderBy("class_name"), classes.columns)
    return section("Detection", markdown(metrics.orderBy(F.col(columns[0]).desc_nulls_last(), "model"), ["model", *columns]), per)


def curves(a: DataFrame | None, b: DataFrame | None, warm_up: int = 3) -> str:
    """Two training curves (epoch, value) epoch by epoch, and the mean lead of the first over the warm-up."""
    if a is None or b is None or a.isEmpty() or b.isEmpty():
        return section("Training curves")
    both = statistics.zip_curves(a, b, "epoch", "value")
    lead = statistics.mean_lead(both, warm_up).first()["mean_lead"]
    return section("Training curves", markdown(both.orderBy("epoch"), ["epoch", "a", "b", "delta"], 3), f"Mean lead over the first {warm_up} epochs, the only ones with equal rates: {lead:+.3f}")


def calibration(pose: tuple[float, float] | None, agreement: DataFrame | None = None, sensitivity: DataFrame | None = None) -> str:
    """Height and pitch, how well the cues agree per set before and after, and the height by how strict the sample is."""
    if pose is None:
        return section("Camera")
    told = f"Height {pose[0]:.3f} m, pitch {pose[1]:+.2f} degrees"
    return section("Camera", told, *(None if t is None else markdown(t, t.columns) for t in (agreement, sensitivity)))


def benchmark(rows: DataFrame | None, host: str = "", by: str = "device") -> str:
    """A table per device of the rows of ``suite.compared_variants``, fastest first, with the errors there were."""
    if rows is None:
        return section("Speed")
    columns = [c for c in ("variant", "size_mb", "p50_ms", "fps", "speedup", "map_50_95", "map_50") if c in rows.columns]
    devices = [r[0] for r in rows.select(by).distinct().orderBy(by).head(100)]
    tables = [f"### {d}\n\n{markdown(rows.where(F.col(by) == d).orderBy(F.col('fps').desc(), 'variant'), columns, 2)}" for d in devices]
    failed = rows.where("error is not null").select("variant", "error").distinct().orderBy("variant") if "error" in rows.columns else None
    return section("Speed", host, *tables, None if failed is None or failed.isEmpty() else markdown(failed, ["variant", "error"]))


def pruning(before: DataFrame | None, after: DataFrame | None) -> str:
    """Weights that are not zero per layer (null: all), before and after; both as by ``statistics.parameter_counts``."""
    if before is None or after is None:
        return section("Pruning")
    layer = before.columns[0]
    left, right = (df.select(F.col(layer).alias(f"_{n}"), F.col("nonzero").alias(n)) for df, n in ((before, "before"), (after, "after")))
    both = left.join(right, F.col("_before").eqNullSafe(F.col("_after")))
    shown = both.select(F.coalesce("_before", F.lit("all")).alias("layer"), "before", "after", (100 * statistics.ratio(F.col("before") - F.col("after"), F.col("before"), 0.0)).alias("removed_pct"))
    return section("Pruning", markdown(shown.orderBy(F.col("before").desc(), "layer"), shown.columns, 1))


def report(title: str, *sections: str) -> str:
    return "\n\n".join([f"# {title}", *sections]) + "\n"
