"""Whole jobs: conversion, re-split, leakage check, robustness sweep, reports and the command line."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.__main__ import main
from kerbside.operators import datasets, sequences, splits
from kerbside.sources import writers

BOX = "x1 double, y1 double, x2 double, y2 double"


def test_conversion_from_source_to_labels(spark):
    images = spark.createDataFrame([(1, "train", "a", 2560, 1440), (2, "train", "b", 640, 480), (3, "val", "c", 640, 480)], "image_id int, split string, stem string, width int, height int")
    found = spark.createDataFrame(
        [(1, "Cone", 0, 100.0, 100.0, 300.0, 200.0), (1, "Cone", 1, 0.0, 0.0, 90.0, 90.0), (1, "Dog", 0, 0.0, 0.0, 90.0, 90.0), (1, "Drum", 0, 2500.0, 1000.0, 2700.0, 1500.0), (1, "Cone", 0, 0.0, 0.0, 5.0, 90.0), (2, "Drum", 0, 10.0, 10.0, 50.0, 50.0)],
        f"image_id int, category string, iscrowd int, {BOX}",
    )
    made = datasets.convert(images, found, {"Cone": "cone", "Drum": "barrier"}, ["cone", "barrier"])
    rows = {(r.stem, r.line_no): r for r in made.labels.collect()}
    assert {k: r.cls for k, r in rows.items()} == {("a", 1): 0, ("a", 2): 1, ("b", 1): 1}
    assert (rows["a", 1].cx, rows["a", 1].cy, rows["a", 1].w, rows["a", 1].h) == pytest.approx((100 / 1280, 75 / 720, 100 / 1280, 50 / 720))
    right, bottom = (rows["a", 2].cx + rows["a", 2].w / 2) * 1280, (rows["a", 2].cy + rows["a", 2].h / 2) * 720
    assert (right, bottom) == pytest.approx((1279, 719))  # clipped to the last pixel
    assert {(r.stem, r.new_width) for r in made.images.collect()} == {("a", 1280), ("b", 640), ("c", 640)}
    counts = {(r.split, r.class_name): r.n for r in made.counts.collect()}
    assert counts["train", "barrier"] == 2 and counts["val", "__negatives__"] == 1
    assert datasets.convert(images, found, {"Cone": "cone"}, ["cone"], keep_negatives=False).images.count() == 1
    assert "0 0.078125" in writers.label_texts(made.labels).where("stem = 'a'").first().text


def test_resplit_leaves_no_leak(spark):
    stems = [f"rw_pgh_{i}" for i in range(300)] + [f"rw_bos_{i:012x}_{c}_{m}" for i in range(40) for c in range(2) for m in (0, 500, 900)] + [f"bdd_{i}" for i in range(80)]
    rng = np.random.default_rng(2)
    codes = [int(c) for c in rng.integers(0, 1 << 62, len(stems))]
    codes[400], codes[450], codes[-1] = codes[-2] ^ 5, codes[-2] ^ 3, codes[-2]  # near-duplicates across groups
    frames = spark.createDataFrame(list(zip(stems, codes, strict=True)), "stem string, h bigint")
    made = datasets.resplit(frames, 0.3, 4, "h")
    rows = {r.stem: r for r in made.assignment.collect()}
    dropped = {r.stem for r in made.dropped.collect()}
    assert rows.keys() | dropped == set(stems) and not rows.keys() & dropped and len(dropped) == 16  # two runs, of 250 and 50 frames
    assert len({rows[s].split for s in (stems[400], stems[450], stems[-1], stems[-2])}) == 1
    placed = frames.join(made.assignment, "stem")
    verdict = datasets.leakage_check(placed.where("stem not like 'rw_pgh%'"), "h").first()
    assert (verdict.duplicate_stems, verdict.near_pairs, verdict.leaked) == (0, 0, False)
    for r in made.summary.collect():
        assert 0.3 <= r.fraction < 0.75 and r.groups > r.val_groups > 0
    assert sorted(map(tuple, datasets.resplit(frames.repartition(7), 0.3, 4, "h").assignment.collect())) == sorted(map(tuple, made.assignment.collect()))
    moved = splits.apply_assignment(frames.withColumn("split", F.lit("old")), made.assignment, made.dropped)
    assert moved.count() == len(rows) and moved.where("split = 'old'").count() == 0
    bad = placed.withColumn("split", F.when(F.col("stem") == stems[-1], "val").otherwise("train"))
    worse = datasets.leakage_check(bad.unionByName(bad.where(F.col("stem") == stems[5]).withColumn("split", F.lit("val"))), "h").first()
    assert worse.duplicate_stems == 1 and worse.near_pairs >= 1 and worse.leaked
    assert datasets.leakage_check(bad).first().near_pairs == 0


def test_robustness_sweep(spark):
    rng = np.random.default_rng(0)
    images, truths = [], []
    for i in range(3):
        img = rng.integers(0, 40, (48, 64, 3), np.uint8)
        img[10:30, 20:44] = 250
        images.append((i, 48, 64, bytearray(img.tobytes())))
        truths.append((i, "cone", i, 20.0, 10.0, 44.0, 30.0))
    gt = spark.createDataFrame(truths, f"image_id int, class_name string, gt_id int, {BOX}")

    def bright(pdf):
        import pandas as pd

        out = []
        for r in pdf.itertuples():
            y, x = np.nonzero(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3).mean(2) > 200)
            if len(y):
                out.append((r.image_id, "cone", r.image_id, 0.9, float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1)))
        return pd.DataFrame(out, columns=["image_id", "class_name", "det_id", "score", "x1", "y1", "x2", "y2"])

    detect = lambda df: df.mapInPandas(lambda parts: map(bright, parts), f"image_id int, class_name string, det_id int, score double, {BOX}")
    frame = spark.createDataFrame(images, "image_id int, height int, width int, data binary")
    made = datasets.robustness(frame, gt, detect, {"low_light": [1, 5], "sensor_noise": [1]})
    rows = {(r.condition, r.severity): r for r in made.collect()}
    assert rows["clean", 0].map_50_95 > 0.99 and rows["clean", 0].retained == 1.0
    assert rows["low_light", 5].retained == 0.0 and rows["sensor_noise", 1].retained > 0.9
    text = writers.report("Robustness", [("Conditions", made, ["condition", "severity", "retained"])])
    assert text.startswith("# Robustness") and text.count("\n| ") == 6


def test_clips_and_json(spark, tmp_path):
    made = sequences.clips(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "clip_key string, frame_ms int, stem string"), 1)
    assert [r.clip_key for r in sequences.longest_first(made).collect()] == ["b", "a"]
    writers.write_json(made.select("clip_key", F.lit(None).cast("int").alias("none")), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("part*")).read_text().splitlines()[0])["none"] is None


def test_command_line(spark, tmp_path, capsys):
    assert main([]) == 0 and "nearest_obstacle" in capsys.readouterr().out
    assert main(["stereo_table", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    quantities = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity").distinct().count()
    assert spark.read.parquet(str(tmp_path / "o")).count() == quantities > 6
    with pytest.raises(SystemExit):
        main(["nothing", "here"])
