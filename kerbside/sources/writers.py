"""Datasets, statistics and reports.  Tables are written anew, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.boxes import finite
from kerbside.functions.text import label_line


def write_dataset(labels: DataFrame, path: str) -> None:
    """Label rows (split, stem, cls, cx, cy, w, h) as Parquet, one folder per split."""
    labels.write.mode("overwrite").partitionBy("split").parquet(path)


def label_texts(labels: DataFrame) -> DataFrame:
    """split, stem and the text of its label file, lines in order."""
    line = label_line(F.col("cls"), [F.col(c) for c in ("cx", "cy", "w", "h")])
    made = labels.select("split", "stem", F.struct("line_no", line.alias("t")).alias("l"))
    lines = made.groupBy("split", "stem").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return lines.select("split", "stem", F.array_join("l.t", "\n").alias("text"))


def descriptor(splits: list[str], names: dict[int, str], root: str) -> str:
    """The dataset's descriptor as YAML: the splits there are, sorted, and the class names."""
    import yaml

    tree = {"path": root, **{s: f"images/{s}" for s in sorted(splits)}, "names": dict(sorted(names.items()))}
    return yaml.safe_dump(tree, sort_keys=False)


def nested_counts(counts: DataFrame, split: str, name: str) -> DataFrame:
    """One row per split with a map from name to n."""
    return counts.groupBy(split).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("counts"))


def summary_lines(nested: DataFrame, split: str) -> DataFrame:
    """One line of text per split: images, negatives, then boxes of each class."""
    get = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).cast("string")
    classes = F.filter(F.map_entries("counts"), lambda e: ~e["key"].startswith("__"))
    parts = F.transform(classes, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    text = F.concat(F.col(split), F.lit(": images="), get("__images__"), F.lit(" negatives="), get("__negatives__"))
    return nested.select(split, F.concat_ws(" ", text, F.array_join(parts, " ")).alias("summary"))


def predictions_json(df: DataFrame, frame: str, places: int = 3) -> DataFrame:
    """frame and JSON of its boxes, nearest first; numbers rounded, what is not finite null."""
    number = lambda c: F.bround(finite(F.col(c)), places)
    row = F.struct(
        F.coalesce("distance_m", F.lit(1e9)).alias("_d"), "class_name", number("score").alias("score"),
        *[number(c).alias(c) for c in ("x1", "y1", "x2", "y2", "distance_m", "sigma_m", "forward_m", "lateral_m")], "method", "flags",
    )
    made = df.groupBy(frame).agg(F.array_sort(F.collect_list(row)).alias("obstacles"))
    return made.select(frame, F.to_json(F.transform("obstacles", lambda o: o.dropFields("_d")), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(df: DataFrame, columns: list[str], places: int = 4, limit: int = 1000) -> str:
    """A Markdown table of a small frame; more than ``limit`` rows are an error."""
    rows = df.select(*columns).head(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a report table has {limit} rows at most")
    show = lambda v: "-" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    lines = [columns, ["---"] * len(columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def report(title: str, sections: list[tuple[str, DataFrame, list[str]]], places: int = 4) -> str:
    """A Markdown report: a title, and per section its heading and a table of the columns named."""
    parts = [f"# {title}", *(f"## {heading}\n\n{markdown(df, columns, places)}" for heading, df, columns in sections)]
    return "\n\n".join(parts) + "\n"
