"""Archives read by ranges and streams, label sinks that publish at once, batches that are added once."""

from __future__ import annotations

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from kerbside.sources import archives, ledger


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    with zipfile.ZipFile(root / "big.zip", "w") as z:
        z.mkdir("clips")
        for i in range(40):
            z.writestr(f"/clips/{i:02}.jpg", os.urandom(1000))
        z.writestr("notes.txt", "x")
    with zipfile.ZipFile(root / "small.ZIP", "w") as z:
        z.writestr("a.JPG", b"a")
    (root / "one.jpg").write_bytes(b"one")
    (root / "_left").write_bytes(b"no")
    (root / "other.png").write_bytes(b"no")
    return str(root)


def plain(root: str) -> set:
    out = {(None, "one.jpg", b"one")}
    for name in ("big.zip", "small.ZIP"):
        with zipfile.ZipFile(f"{root}/{name}") as z:
            out |= {(name, i.filename.lstrip("/"), z.read(i)) for i in z.infolist() if i.filename.lower().endswith(".jpg")}
    return out


def rows(df) -> list:
    return [(r.archive and os.path.basename(r.archive), r.member if r.archive else os.path.basename(r.member), bytes(r.content)) for r in df.collect()]


def test_an_archive_is_read_by_several_tasks(spark, folder):
    made = archives.frames(spark, folder, partition_bytes=8000)
    got = rows(made)
    assert set(got) == plain(folder) and len(got) == 42
    tasks = made.where(F.col("archive").endswith("big.zip")).groupBy(F.spark_partition_id()).count()
    assert tasks.count() >= 5
    names = archives.frames(spark, folder, columns="member string, size bigint")
    assert names.columns == ["member", "size"] and names.agg(F.sum("size")).first()[0] == 40 * 1000 + 1 + 3
    assert len(rows(archives.frames(spark, f"{folder}/big.zip"))) == 40
    with pytest.raises(Exception, match="no archive"):
        archives.frames(spark, f"{folder}/none").collect()


def test_streams_read_the_same_frames_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")

    def run() -> int:
        before = len(ledger.batches(out))
        stream = archives.frames(spark, folder, stream=True, partition_bytes=8000)
        ledger.append_stream(stream, out, str(tmp_path / "ck")).awaitTermination(120)
        return len(ledger.batches(out)) - before

    assert run() == 1 and run() == 0
    with zipfile.ZipFile(f"{folder}/later.zip", "w") as z:
        z.writestr("z.jpg", b"z")
    os.utime(f"{folder}/later.zip", (4e9, 4e9))
    assert run() == 1
    got = rows(ledger.read_batches(spark, out, archives.COLUMNS))
    assert len(got) == 43 and set(got) == plain(folder) | {("later.zip", "z.jpg", b"z")}


def test_a_batch_is_added_once(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(10)
    assert ledger.read_batches(spark, path, df.schema).count() == 0
    assert ledger.append_batch(df, path, 0) and not ledger.append_batch(df, path, 0) and ledger.append_batch(df, path, 1)
    assert ledger.read_batches(spark, path, df.schema).count() == 20
    # a writer that died between its files and the ledger
    df.write.parquet(f"{path}/batch-dead")
    assert ledger.read_batches(spark, path, df.schema).count() == 20


def texts(spark, n: int, start: int = 0):
    rows = [("val" if i % 4 == 0 else "train", f"s{i}", "" if i % 5 == 0 else f"{i % 3} 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.1") for i in range(start, start + n)]
    return spark.createDataFrame(rows, "split string, stem string, text string").repartition(4)


def test_labels_and_counts_appear_together(spark, tmp_path):
    path = str(tmp_path / "set")
    ledger.write_labels(texts(spark, 40), path)
    counts = ledger.label_counts(path)
    assert counts["val"]["__images__"] == 10 and counts["train"]["__images__"] == 30 and counts["val"]["__negatives__"] == 2
    read = ledger.read_labels(spark, path)
    assert read.count() == sum(n for c in counts.values() for k, n in c.items() if not k.startswith("__")) == 64
    assert {r.cls: r.n for r in ledger.read_labels(spark, path, "val").groupBy("cls").agg(F.count("*").alias("n")).collect()} == {int(k): n for k, n in counts["val"].items() if not k.startswith("__")}
    ledger.write_labels(texts(spark, 10, 40), path, batch="b")
    ledger.write_labels(texts(spark, 10, 40), path, batch="b")
    assert sum(c["__images__"] for c in ledger.label_counts(path).values()) == 50 and len(ledger.batches(path)) == 2
    ledger.write_labels(texts(spark, 4), path, overwrite=True)
    assert sum(c["__images__"] for c in ledger.label_counts(path).values()) == 4 and sum(n.startswith("labels-") for n in os.listdir(path)) == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "set")
    ledger.write_labels(texts(spark, 8), path)
    before = json.dumps(ledger.batches(path))
    bad = texts(spark, 200, 100).withColumn("text", F.when(F.col("stem") == "s299", F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        ledger.write_labels(bad, path)
    assert json.dumps(ledger.batches(path)) == before and ledger.read_labels(spark, path).select("stem").distinct().count() == 6
    os.makedirs(f"{path}/labels-late/part-0-1")  # as a task that outlives its job may leave it
    ledger.write_labels(texts(spark, 4, 500), path)
    assert {n for n in os.listdir(path) if n.startswith("labels-")} == {b["folder"] for b in ledger.batches(path)}


def test_attempts_that_died_are_not_published(tmp_path):
    path = str(tmp_path / "set")
    writer = ledger.LabelWriter(path, None, False)
    for own in ("part-0-7", "part-0-9"):
        os.makedirs(f"{path}/{writer.folder}/{own}/val")
        (tmp_path / "set" / writer.folder / own / "val" / "a.txt").write_text("0 1 1 1 1")
    writer.commit([ledger.Written("part-0-9", {"val": {"__images__": 1, "0": 1}}), None])
    assert os.listdir(f"{path}/{writer.folder}") == ["part-0-9"] and ledger.label_counts(path) == {"val": {"__images__": 1, "0": 1}}


def test_small_files_are_dealt_by_their_number():
    place = archives._Place("x", ".txt", 1 << 20, ("member",))
    files = [(0, f"x/{i}.txt", i % 3) for i in range(10_000)]
    pieces = place.pieces(files)
    assert [p for piece in pieces for p in piece.files] == [f[1] for f in files]
    assert 3 <= len(pieces) <= 4 and max(len(p.files) for p in pieces) <= archives.FILES_A_PARTITION
