"""From annotation files to a dataset folder, its re-split, audit, completion and report, by the command line."""

from __future__ import annotations

import json

import pytest
import yaml
from pyspark.sql import functions as F

from kerbside import commands
from kerbside.__main__ import main
from kerbside.sources import catalogue, ledger, reports

STEMS = {"train": [f"pgh_{v:012x}_0_{ms}" for v in range(20) for ms in (0, 500)], "val": [f"pgh_{v:012x}_0_900" for v in range(10)]}


@pytest.fixture
def inputs(tmp_path):
    """Clips whose last frame lies in the other split; every third image has no box."""
    for split, stems in STEMS.items():
        images = [{"id": i, "file_name": f"x/{s}.jpg", "width": 1280, "height": 720} for i, s in enumerate(stems)]
        boxes = [{"id": i, "image_id": i, "category_id": 1 + i % 2, "bbox": [10.0, 20.0, 100.0, 60.0], "iscrowd": 0, "area": 1.0} for i in range(len(stems)) if i % 3]
        categories = [{"id": 1, "name": "Cone"}, {"id": 2, "name": "Drum"}]
        (tmp_path / f"{split}.json").write_text(json.dumps({"images": images, "annotations": boxes, "categories": categories}))
    return [f"{s}={tmp_path / s}.json" for s in STEMS]


def test_dataset_from_annotations_to_report(spark, tmp_path, inputs, capsys):
    out = str(tmp_path / "set")
    call = ["convert", out, "--as", "work", "--in", *inputs, "--prefix", "rw_"]
    assert main(call) == 0 and main(call) == 0  # added once
    stats = json.loads((tmp_path / "set/stats.json").read_text())
    n = {s: len(v) for s, v in STEMS.items()}
    assert {s: stats[s]["__images__"] for s in n} == n and stats["val"]["__negatives__"] == 4
    assert stats["train"]["cone"] + stats["train"]["barrier"] == sum(1 for i in range(n["train"]) if i % 3)
    assert yaml.safe_load((tmp_path / "set/data.yaml").read_text())["names"] == {0: "cone", 1: "barrier", 2: "stop_sign"}
    first = commands.published(spark, out).where("stem = 'rw_pgh_000000000000_0_500'").first()
    assert first.split == "train" and first.text == "1 0.046875 0.069444 0.078125 0.083333"

    assert main(["audit", out]) == 1 and json.loads((tmp_path / "set/leakage.json").read_text())["shared"] == 10
    assert main(["resplit", out, "--share", "0.3", "--seed", "3"]) == 0
    assert main(["audit", out]) == 0
    assert commands.published(spark, out).count() == sum(n.values()) and len(ledger.batches(out)) == 1
    assert main(call) == 0 and commands.published(spark, out).count() == sum(n.values())

    texts = commands.published(spark, out)
    texts.select("stem", F.lit(1280).alias("width"), F.lit(720).alias("height")).write.parquet(str(tmp_path / "sizes"))
    found = [("rw_pgh_000000000000_0_0", 11, 0.9, -10.0, 0.0, 64.0, 72.0), ("rw_pgh_000000000000_0_500", 11, 0.8, 0.0, 0.0, 3.0, 72.0)]
    spark.createDataFrame(found, "stem string, class_id int, score double, x1 double, y1 double, x2 double, y2 double").write.parquet(str(tmp_path / "found"))
    more = ["complete", out, "--detections", str(tmp_path / "found"), "--sizes", str(tmp_path / "sizes"), "--teacher-class", "11", "--class", "2", "--prefix", "rw_"]
    assert main(more) == 0 and main(more) == 0
    got = {r.stem: r.text for r in commands.published(spark, out).collect()}
    assert got["rw_pgh_000000000000_0_0"] == "2 0.025000 0.050000 0.050000 0.100000" and len(got) == sum(n.values())
    assert got["rw_pgh_000000000000_0_500"] == first.text
    capsys.readouterr()
    assert main(["report", out]) == 0
    told = capsys.readouterr().out
    assert told.startswith("# Dataset") and "no leak was found" in told and "Frames left out at the ends of runs: 0" in told and "| rw | 50 |" in told
    assert (tmp_path / "set/report.md").read_text().strip() == told.strip()


def test_an_empty_folder_has_nothing(spark, tmp_path):
    out = str(tmp_path / "none")
    assert commands.published(spark, out).count() == 0 and commands.get_json(out, "stats.json") == {}
    assert commands.describe(out) == {} and not commands.audit(spark, out)["leaked"]


def test_catalogue_is_ordered_and_resumed(spark, tmp_path, capsys):
    tree = {"big": {"url": "u:big", "folder": str(tmp_path / "big"), "size": 1000, "chunk": 300}, "small": {"url": "u:small", "folder": str(tmp_path / "small"), "size": 10, "note": "ten bytes"}, "bad": {"url": "u:bad", "folder": str(tmp_path / "bad"), "size": 500}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(tree))
    assert main(["sources", str(tmp_path / "c.yaml")]) == 0
    assert [line.split()[0] for line in capsys.readouterr().out.splitlines()] == ["small", "bad", "big"]
    with pytest.raises(SystemExit):
        main(["sources", str(tmp_path / "c.yaml"), "nothing"])
    known = catalogue.catalogue(tree)
    with pytest.raises(ValueError):
        catalogue.selected(known)

    def get(url, start, end):
        if url == "u:bad":
            raise OSError("down")
        return bytes(end - start + 1)

    made = catalogue.obtain(spark, catalogue.selected(known, ["small", "big"]), get, 1, 0.0).collect()
    assert [tuple(r) for r in made] == [("small", 1, 1), ("big", 4, 4)]
    assert sum(p.stat().st_size for p in (tmp_path / "big").iterdir()) == 1000
    stopped = catalogue.obtain(spark, catalogue.selected(known, everything=True), get, 1, 0.0).collect()
    assert [tuple(r) for r in stopped] == [("small", 1, 1), ("bad", 1, 0)]  # those after it wait


def test_report_sections(spark):
    frame = spark.createDataFrame
    counts = frame([("val", "__images__", 3), ("val", "cone", 2), ("train", "__images__", 9), ("train", "__negatives__", 4)], "split string, class_name string, n bigint")
    assert "| train | 9 | 4 | 0 |" in reports.dataset(counts, None, ["cone"]) and reports.dataset(None) == f"## Dataset\n\n{reports.MISSING}"
    assert "| 9 | 3 | 1 | 25.0 |" in reports.mining(frame([(9, 3, 1, 25.0)], "examined int, kept int, rejected int, rejected_pct double"))
    a, b = (frame([(i + 1, v + k * i) for i in range(4)], "epoch int, value double") for v, k in ((0.5, 0.1), (0.25, 0.1)))
    assert "+0.250" in reports.curves(a, b) and reports.MISSING in reports.curves(a, b.limit(0))
    rows = frame([("slow", "cpu", 20.0, 50.0, 1.0, 0.4, None), ("fast", "cpu", 10.0, 100.0, 2.0, None, "OSError: gone"), ("fast", "gpu", 1.0, 1000.0, None, 0.4, None)], "variant string, device string, p50_ms double, fps double, speedup double, map_50_95 double, error string")
    text = reports.benchmark(rows, "a host")
    assert text.index("### cpu") < text.index("| fast | 10.00") < text.index("| slow | 20.00") < text.index("### gpu") and "| fast | OSError: gone |" in text
    layers = lambda n: frame([("a", 10, 0, n), (None, 10, 0, n)], "layer string, parameters bigint, zeros bigint, nonzero bigint")
    assert "| all | 10 | 5 | 50.0 |" in reports.pruning(layers(10), layers(5))
    models = frame([("x", 0.1), ("y", 0.9), ("z", None)], "model string, map_50 double")
    shown = reports.detection(models)
    assert shown.index("| y |") < shown.index("| x |") < shown.index("| z | - |")
    assert reports.calibration((1.378, -0.53)).endswith("Height 1.378 m, pitch -0.53 degrees") and reports.MISSING in reports.calibration(None)
    assert reports.report("T", "## A", "## B") == "# T\n\n## A\n\n## B\n"
