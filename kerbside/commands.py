"""Jobs over dataset folders: from annotation files to labels, re-split, audit, completion, sources and report.

A dataset folder holds label files behind a ledger (see ``sources.ledger``), one batch
a source, and beside them data.yaml, stats.json and manifest.json, which every
command writes anew from what the ledger lists.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.config import CATEGORY_MAP, CLASS_NAMES
from kerbside.functions.text import file_stem, name_prefix
from kerbside.operators import datasets, pseudo
from kerbside.sources import archives, ledger, readers, reports, writers
from kerbside.sources.archives import store

SIZES = "stem string, width int, height int"


def put_text(folder: str, name: str, text: str) -> None:
    system, root = store(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as f:
        f.write(text.encode())


def get_json(folder: str, name: str) -> dict[str, Any]:
    """The JSON file, an empty dictionary where it is not there."""
    system, root = store(folder)
    if system.get_file_info(f"{root}/{name}").type.name == "NotFound":
        return {}
    with system.open_input_stream(f"{root}/{name}") as f:
        return json.loads(f.read())


def describe(folder: str, names: Mapping[int, str] = CLASS_NAMES, **manifest: Any) -> dict[str, dict[str, int]]:
    """Write data.yaml, stats.json and manifest.json by the ledger; the counts per split, classes by name.

    The manifest keeps what earlier commands put there.
    """
    found = ledger.label_counts(folder)
    named = {split: {(names.get(int(k), k) if k.isdigit() else k): n for k, n in sorted(counts.items())} for split, counts in sorted(found.items())}
    put_text(folder, "data.yaml", writers.descriptor(list(named), dict(names), folder))
    put_text(folder, "stats.json", json.dumps(named, indent=2))
    put_text(folder, "manifest.json", json.dumps({**get_json(folder, "manifest.json"), **manifest}, indent=2, default=str))
    return named


def convert(spark: SparkSession, out: str, inputs: Mapping[str, str], name: str, mapping: Mapping[str, str] = CATEGORY_MAP, names: Mapping[int, str] = CLASS_NAMES, member: str | None = None, prefix: str = "", max_side: int = 1280, keep_negatives: bool = True) -> dict[str, dict[str, int]]:
    """Annotation files (split to path; a path in an archive if ``member`` names one) to labels, as batch ``name``.

    A name that the folder has already adds nothing.  Stems get ``prefix`` in front.
    """
    if name in get_json(out, "manifest.json"):  # also where a re-split has replaced the batches since
        return get_json(out, "stats.json")
    texts = None
    for split, path in inputs.items():
        images, anns, cats = readers.coco_in_zip(spark, path, member, list(mapping)) if member else readers.coco(spark, path, list(mapping))
        known = images.select("image_id", F.lit(split).alias("split"), F.concat(F.lit(prefix), file_stem(F.col("file_name"))).alias("stem"), "width", "height")
        made = datasets.convert(known, anns.join(F.broadcast(cats), "category_id"), mapping, [names[i] for i in sorted(names)], max_side, keep_negatives=keep_negatives)
        lines = made.images.select("split", "stem").join(writers.label_texts(made.labels), ["split", "stem"], "left").na.fill({"text": ""})
        texts = lines if texts is None else texts.unionByName(lines)
    ledger.write_labels(texts, out, name)
    return describe(out, names, **{name: dict(inputs)})


def published(spark: SparkSession, folder: str) -> DataFrame:
    """split, stem and text of every label file that the ledger lists; also of empty ones, which Spark's own readers leave out."""
    found = spark.createDataFrame([], "split string, stem string, text string")
    for batch in ledger.batches(folder):
        files = archives.frames(spark, f"{folder}/{batch['folder']}", ".txt")
        split = F.element_at(F.split("member", "/"), -2)
        found = found.unionByName(files.select(split.alias("split"), file_stem(F.col("member")).alias("stem"), F.decode("content", "UTF-8").alias("text")))
    return found


def resplit(spark: SparkSession, folder: str, share: float = 0.27, seed: int = 0) -> dict[str, dict[str, int]]:
    """Deal the labels of a dataset to splits without a common group, all at once; frames under embargo go."""
    texts = published(spark, folder)
    made = datasets.resplit(texts.select("stem").distinct(), share, seed)
    moved = texts.drop("split").dropDuplicates(["stem"]).join(made.assignment.select("stem", "split"), "stem")
    dropped = made.dropped.count()
    ledger.write_labels(moved, folder, f"resplit-{seed}-{share}", overwrite=True)
    return describe(folder, resplit={"share": share, "seed": seed, "embargoed_frames": dropped})


def audit(spark: SparkSession, folder: str) -> dict[str, Any]:
    """The leakage check of a dataset, written beside it as leakage.json."""
    row = datasets.leakage_check(published(spark, folder).select("stem", "split")).first().asDict()
    put_text(folder, "leakage.json", json.dumps(row, indent=2))
    return row


def complete(spark: SparkSession, folder: str, detections: DataFrame, sizes: DataFrame, class_id: int, cls: int, prefix: str = "", least_score: float = 0.55) -> dict[str, Any]:
    """Append the teacher's boxes to the labels of frames by ``prefix``, once a class and prefix.

    detections: stem, class_id, score, box; sizes: stem, width, height.
    A folder that has them already is left as it is.
    """
    mark = f"complete:{prefix}:{cls}"
    told = get_json(folder, "manifest.json")
    if mark in told or any(b["batch"] == mark for b in ledger.batches(folder)):
        return told.get(mark, {})
    texts = published(spark, folder)
    made = pseudo.complete(texts.select("split", "stem").join(sizes, "stem"), detections, class_id, cls, prefix, least_score)
    numbered = made.labels.withColumn("line_no", F.row_number().over(Window.partitionBy("split", "stem").orderBy(F.col("score").desc(), "cx", "cy", "w", "h")))
    more = writers.label_texts(numbered).withColumnRenamed("text", "more")
    joined = texts.join(more, ["split", "stem"], "left")
    whole = joined.select("split", "stem", F.concat_ws("\n", F.when(F.col("text") != "", F.col("text")), "more").alias("text"))
    stats = {r["split"]: {k: r[k] for k in ("images_scanned", "images_modified", "boxes_added")} for r in made.statistics.collect()}
    ledger.write_labels(whole, folder, mark, overwrite=True)
    describe(folder, **{mark: stats})
    return stats


def counts_frame(spark: SparkSession, counts: Mapping[str, Mapping[str, int]]) -> DataFrame:
    rows = [(split, k, n) for split, of in counts.items() for k, n in of.items()]
    return spark.createDataFrame(rows, "split string, class_name string, n bigint")


def report(spark: SparkSession, folder: str, names: Sequence[str] = tuple(CLASS_NAMES.values())) -> str:
    """The report of a dataset folder from the files that the other commands left, written as report.md."""
    manifest, counts, verdict = (get_json(folder, f"{n}.json") for n in ("manifest", "stats", "leakage"))
    origins = published(spark, folder).groupBy(name_prefix(F.col("stem")).alias("prefix")).agg(F.count("*").alias("images"))
    done = [(split, *(stats[k] for k in ("images_scanned", "images_modified", "boxes_added"))) for key, of in manifest.items() if key.startswith("complete:") for split, stats in of.items()]
    added = spark.createDataFrame(done, "split string, images_scanned bigint, images_modified bigint, boxes_added bigint") if done else None
    checked = spark.createDataFrame([tuple(verdict.values())], list(verdict)) if verdict else None
    text = reports.report(
        "Dataset", reports.dataset(counts_frame(spark, counts) if counts else None, origins, names), reports.mining(None, added),
        reports.integrity(checked, manifest.get("resplit", {}).get("embargoed_frames")),
    )
    put_text(folder, "report.md", text)
    return text
