"""Folders that grow by whole batches: what a ledger names is there, anything else is not.

``_LEDGER`` is one JSON file, replaced by a move, that lists the batches of a
folder with their files and counts.  Writers put a batch's files beside it first,
so a job or a task that dies leaves files that nobody reads, and a batch that is
replayed finds itself in the ledger and adds nothing.  One writer at a time.

``LabelSink`` is a Spark data source that writes label files that way:

    spark.dataSource.register(LabelSink)
    df.write.format("kerbside_labels").mode("append").option("batch", 7).save(path)
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from kerbside.sources.archives import store

LEDGER = "_LEDGER"


def batches(path: str) -> list[dict]:
    """The batches that are there, in the order in which they came: batch, folder, counts."""
    system, root = store(path)
    if system.get_file_info(f"{root}/{LEDGER}").type.name == "NotFound":
        return []
    with system.open_input_stream(f"{root}/{LEDGER}") as f:
        return json.loads(f.read())["batches"]


def publish(path: str, listed: list[dict]) -> None:
    """Make these the batches of the folder, at once; folders that are named no more are removed after it."""
    system, root = store(path)
    before = {b["folder"] for b in batches(path)}
    system.create_dir(root, recursive=True)
    # the file is whole before it gets its name
    with system.open_output_stream(f"{root}/{LEDGER}.{(mark := uuid.uuid4().hex)}") as f:
        f.write(json.dumps({"batches": listed}).encode())
    system.move(f"{root}/{LEDGER}.{mark}", f"{root}/{LEDGER}")
    for folder in before - {b["folder"] for b in listed}:
        system.delete_dir(f"{root}/{folder}")


def _inside(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


def append_batch(df: DataFrame, path: str, batch: int | str) -> bool:
    """Add the rows as one batch, as Parquet; False, and nothing written, where the batch is there already.

    Meant for ``foreachBatch``: a batch that is run again after a failure leaves one copy.
    """
    known = batches(path)
    if any(b["batch"] == str(batch) for b in known):
        return False
    folder = f"batch-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    publish(path, [*known, {"batch": str(batch), "folder": folder, "counts": {}}])
    return True


def read_batches(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows of the batches in the ledger; none without a ledger."""
    folders = [f"{path}/{b['folder']}" for b in batches(path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append every micro-batch of a stream to the folder, each once."""
    writer = stream.writeStream.foreachBatch(lambda df, n: append_batch(df, path, n) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder, and counts by split and class, images and negatives included."""

    folder: str
    counts: dict


class LabelWriter(DataSourceWriter):
    """Rows (split, stem, text) as one label file per image, published with their counts."""

    def __init__(self, path: str, batch: str | None, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.folder = f"labels-{uuid.uuid4().hex}"
        self.batch = batch or self.folder

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = store(self.path)
        # an attempt has a folder of its own, so one that died is not mixed with the one that replaces it
        own = f"part-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        counts: dict[str, Counter] = {}
        made = set()
        for row in rows:
            split, stem, text = row["split"], row["stem"], row["text"] or ""
            if split not in made:
                system.create_dir(f"{root}/{self.folder}/{own}/{split}", recursive=True)
                made.add(split)
            with system.open_output_stream(f"{root}/{self.folder}/{own}/{split}/{stem}.txt") as f:
                f.write(text.encode())
            lines = [line.split()[0] for line in text.splitlines() if line.split()]
            counts.setdefault(split, Counter()).update({"__images__": 1, **({} if lines else {"__negatives__": 1})})
            counts[split].update(lines)
        return Written(own, {k: dict(v) for k, v in counts.items()})

    def commit(self, messages: list[Written | None]) -> None:
        known = batches(self.path)
        if not self.overwrite and any(b["batch"] == self.batch for b in known):
            return self.abort(messages)
        system, root = store(self.path)
        done = [m for m in messages if m is not None]
        total: dict[str, Counter] = {}
        for m in done:
            for split, n in m.counts.items():
                total.setdefault(split, Counter()).update(n)
        system.create_dir(f"{root}/{self.folder}", recursive=True)
        for left in system.get_file_info(_inside(f"{root}/{self.folder}")):
            if left.base_name not in {m.folder for m in done}:
                system.delete_dir(left.path)  # of attempts that died
        entry = {"batch": self.batch, "folder": self.folder, "counts": {k: dict(sorted(v.items())) for k, v in sorted(total.items())}}
        publish(self.path, [*([] if self.overwrite else known), entry])
        # a task of a job that failed may have written on after the job was aborted; only this writer is at work now
        named = {b["folder"] for b in batches(self.path)}
        for left in system.get_file_info(_inside(root)):
            if left.base_name.startswith("labels-") and left.base_name not in named:
                system.delete_dir(left.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        if system.get_file_info(f"{root}/{self.folder}").type.name != "NotFound":
            system.delete_dir(f"{root}/{self.folder}")


class LabelSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kerbside_labels"

    def schema(self) -> str:
        return "split string, stem string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options["path"], self.options.get("batch"), overwrite)


def write_labels(texts: DataFrame, path: str, batch: int | str | None = None, overwrite: bool = False) -> None:
    """Label texts (see ``writers.label_texts``) as files, and their counts, all at once or not at all."""
    texts.sparkSession.dataSource.register(LabelSink)
    made = texts.select("split", "stem", "text").write.format(LabelSink.name()).mode("overwrite" if overwrite else "append")
    (made if batch is None else made.option("batch", str(batch))).save(path)


def label_counts(path: str) -> dict[str, dict[str, int]]:
    """split to class to number, of all batches together."""
    total: dict[str, Counter] = {}
    for b in batches(path):
        for split, n in b["counts"].items():
            total.setdefault(split, Counter()).update(n)
    return {k: dict(v) for k, v in total.items()}


def read_labels(spark: SparkSession, path: str, split: str = "*") -> DataFrame:
    """The label lines of the published files (see ``readers.label_lines``)."""
    from kerbside.functions.text import file_stem
    from kerbside.sources.readers import parse_label_lines
    from pyspark.sql import functions as F

    folders = [f"{path}/{b['folder']}/*/{split}" for b in batches(path) if split == "*" or split in b["counts"]]
    if not folders:
        return parse_label_lines(spark.createDataFrame([], "stem string, value string"))
    return parse_label_lines(spark.read.text(folders, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("stem"), "value"))
