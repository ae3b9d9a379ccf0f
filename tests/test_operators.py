"""Data operators on small tables, against plain Python."""

from __future__ import annotations

import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import hashing, text
from kerbside.operators import annotations, evaluation, graph, matching, pixels, runs, sequences, splits, statistics, tracking
from kerbside.sources import readers, writers
from kerbside.streaming import flows

BOX = "x1 double, y1 double, x2 double, y2 double"


def test_perfect_detections_score_one_and_none_score_zero(spark):
    gt = [(i, "cone", i * 10 + j, 10.0 * j, 10.0, 10.0 * j + 8 + 50 * (j % 2), 90.0) for i in range(3) for j in range(3)]
    truths = spark.createDataFrame(gt, f"image_id int, class_name string, gt_id int, {BOX}")
    det = truths.withColumnRenamed("gt_id", "det_id").withColumn("score", F.lit(0.9))
    best = evaluation.summary(evaluation.average_precision(det, truths)).first()
    assert best.map_50_95 > 0.99 and best.map_50 > 0.99 and best.ar_100 == 1.0 and best.map_large is None
    none = evaluation.summary(evaluation.average_precision(det.limit(0), truths)).first()
    assert none.map_50_95 == 0.0 and none.ar_100 == 0.0


def test_matching_is_greedy_by_score(spark):
    truths = spark.createDataFrame([(1, "c", 1, 0.0, 0.0, 100.0, 100.0)], f"image_id int, class_name string, gt_id int, {BOX}")
    det = spark.createDataFrame([(1, "c", 1, 0.5, 0.0, 0.0, 100.0, 100.0), (1, "c", 2, 0.9, 0.0, 0.0, 100.0, 90.0), (1, "d", 3, 0.9, 0.0, 0.0, 9.0, 9.0)], f"image_id int, class_name string, det_id int, score double, {BOX}")
    rows = {(r.det_id, r.threshold): r.tp for r in evaluation.match(det, truths).where("area_range = 'all'").collect()}
    assert rows[2, 0.9] and not rows[1, 0.9] and rows[1, 0.95] and not rows[2, 0.95] and not rows[3, 0.5]


def plain_iou(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(wide, 0) * max(high, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def plain_metric(det, gt):
    """Average precision by class, area range and threshold, in plain loops after the public protocol."""
    out, size = {}, lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for name in {g[1] for g in gt}:
        for area, (lo, hi) in evaluation.AREAS.items():
            n = sum(g[1] == name and lo <= size(g[3:]) <= hi for g in gt)
            for t in evaluation.THRESHOLDS if n else ():
                scored = []
                for image in {d[0] for d in det}:
                    mine = sorted((d for d in det if d[:2] == (image, name)), key=lambda d: (-d[3], d[2]))[:100]
                    truth = [(g, not lo <= size(g[3:]) <= hi) for g in gt if g[:2] == (image, name)]
                    used = set()
                    for d in mine:
                        best, at = t - 1e-10, None
                        for aside in (False, True):  # truths inside the range first
                            for j, (g, off) in enumerate(truth):
                                if at is None or truth[at][1] == aside:
                                    if off == aside and j not in used and plain_iou(d[4:], g[3:]) >= best:
                                        best, at = plain_iou(d[4:], g[3:]), j
                            if at is not None:
                                break
                        if at is not None:
                            used.add(at)
                        if not (truth[at][1] if at is not None else not lo <= size(d[4:]) <= hi):
                            scored.append((-d[3], d[2], at is not None))
                tp, points = 0, []
                for k, (_, _, hit) in enumerate(sorted(scored), 1):
                    tp += hit
                    points.append((tp / n, tp / k))
                out[name, area, t] = sum(max((p for r, p in points if r >= x / 100 - 1e-11), default=0.0) for x in range(101)) / 101
    return out


def test_average_precision_equals_plain_loops(spark):
    rng = random.Random(9)
    gt, det = [], []
    for image in range(14):
        for j in range(rng.randint(0, 6)):
            side, x, y = rng.choice([12, 25, 40, 80, 120, 200]), rng.uniform(0, 300), rng.uniform(0, 300)
            name = rng.choice(["cone", "barrier"])
            gt.append((image, name, image * 100 + j, x, y, x + side, y + side))
            for _ in range(rng.randint(0, 3)):
                dx, dy = rng.uniform(-0.25, 0.25) * side, rng.uniform(-0.25, 0.25) * side
                det.append((image, rng.choice([name, name, "cone"]), len(det), round(rng.random(), 1), x + dx, y + dy, x + dx + side, y + dy + side * rng.uniform(0.8, 1.2)))
        det.append((image, "cone", len(det), 0.35, 1.0, 1.0, 30.0, 30.0))
    truths = spark.createDataFrame(gt, f"image_id int, class_name string, gt_id int, {BOX}")
    found = spark.createDataFrame(det, f"image_id int, class_name string, det_id int, score double, {BOX}")
    got = {(r.class_name, r.area_range, r.threshold): r.ap for r in evaluation.average_precision(found, truths).collect()}
    want = plain_metric(det, gt)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items()) and 0 < sum(want.values()) < len(want)


def test_suppression_equals_a_plain_loop(spark):
    rng = random.Random(1)
    rows = []
    for f in range(12):
        for i in range(15):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            rows.append((f, i, round(rng.random(), 2), x, y, x + 30, y + 30))
    got = {(r.f, r.i) for r in matching.suppress(spark.createDataFrame(rows, f"f int, i int, score double, {BOX}"), "f", "i").collect()}
    want = set()
    for f in range(12):
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
            if all(plain_iou(r[3:], k[3:]) <= 0.45 for k in kept):
                kept.append(r)
        want |= {(f, r[1]) for r in kept}
    assert got == want


def test_agreement_takes_the_first_best_truth(spark):
    det = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 50.0, 60.0, 60.0)], f"f int, d int, {BOX}")
    gt = spark.createDataFrame([(1, 8, 0.0, 0.0, 10.0, 9.0), (1, 7, 0.0, 0.0, 10.0, 9.0), (2, 9, 50.0, 50.0, 60.0, 60.0)], f"f int, g int, {BOX}")
    kept = matching.agreement_join(det, gt, "f", "d", "g")
    assert [(r.d, r.g) for r in kept.collect()] == [(1, 7)]
    assert tuple(matching.mining_statistics(det, kept, "f").first()) == (1, 1, 1, 50.0)


def test_runs_and_embargo_equal_a_plain_loop(spark):
    rng = random.Random(2)
    idx = sorted({rng.randint(0, 4000) for _ in range(1200)})
    rows = spark.createDataFrame([("p", i) for i in idx], "prefix string, idx int")
    got = sequences.embargo(sequences.segment_runs(rows, "prefix", "idx", max_run=50), ["prefix", "island", "chunk"], "idx")
    runs, last = [], None
    for i in idx:
        if last is None or i - last > 10 or len(runs[-1]) == 50:
            runs.append([])
        runs[-1].append(i)
        last = i
    want = {i for r in runs for i in r[-8:] if len(r) > 16}
    assert {r.idx for r in got.where("dropped").collect()} == want
    assert got.select("island", "chunk").distinct().count() == len(runs)


def test_greedy_fill_equals_a_plain_loop(spark):
    rng = random.Random(3)
    groups = [("s", f"g{i}", rng.randint(1, 40), rng.random()) for i in range(60)]
    made = splits.greedy_fill(spark.createDataFrame(groups, "source string, grp string, n int, r double"), "source", F.col("r"), "n", 0.27, ["grp"])
    total, held, want = sum(g[2] for g in groups), 0, set()
    for g in sorted(groups, key=lambda g: g[3]):
        if held < 0.27 * total:
            want.add(g[1])
        held += g[2]
    assert {r.grp for r in made.where("split = 'val'").collect()} == want


def test_samples_and_numbers(spark):
    rows = spark.range(103).repartition(7)
    assert sorted(r.id for r in splits.stride_sample(rows, ["id"], 10).collect()) == list(range(103))[:: 103 // 10][:10]
    assert sorted(r.id for r in splits.linspace_sample(rows, ["id"], 8).collect()) == np.linspace(0, 102, 8).astype(int).tolist()
    assert splits.linspace_sample(rows.limit(0), ["id"], 8).count() == 0
    numbered = annotations.numbered_globally(rows, "n", ["id"]).collect()
    assert all(r.n == r.id + 1 for r in numbered)


def test_banding_finds_all_pairs_within_three_bits(spark):
    rng = random.Random(4)
    codes = [rng.getrandbits(63) for _ in range(60)]
    codes += [c ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for c in codes[:30]] + codes[:5]
    rows = spark.createDataFrame([*enumerate(codes), (999, None)], "k bigint, h bigint")
    got = {r.node: r.component for r in graph.components(graph.band_pairs(rows, "k", "h")).collect()}
    label = {i: i for i in range(len(codes))}
    for _ in codes:
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if bin(a ^ b).count("1") <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(got.get(i, i) == label[i] for i in label)
    near = graph.nearest_codes(rows.where("k < 5"), rows, "k", "h").collect()
    for r in near:
        assert (r.distance, r.match) == min((bin(codes[r.query] ^ c).count("1"), j) for j, c in enumerate(codes) if j != r.query)
    some = sorted(map(tuple, graph.compared(rows.where("k < 40"), rows, "k", "h", best=2).collect()))
    assert some == sorted(map(tuple, graph.compared(rows.where("k < 40"), rows, "k", "h", best=2, block=7).collect())) and len(some) == 80
    with pytest.raises(ValueError):
        graph.band_pairs(rows, "k", "h", blocks=3)


def test_groups_of_duplicates_merge(spark):
    members = spark.createDataFrame([(i, f"s{i % 3}", f"g{9 - i}", i) for i in range(10)], "k bigint, source string, grp string, n int")
    labels = spark.createDataFrame([(1, 1), (4, 1), (7, 1), (2, 2), (3, 2)], "node bigint, component bigint")
    got = {r.k: (r.source, r.grp, r.n) for r in graph.merge_groups(members, labels, "k", ["source", "grp"]).collect()}
    assert got == {i: (f"s{i % 3}", f"g{9 - i}", i) for i in (0, 5, 6, 8, 9)} | {i: ("s1", "g2", i) for i in (1, 4, 7)} | {i: ("s0", "g6", i) for i in (2, 3)}


def test_documents_that_hold_items(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) if i else None) for i in range(60)]
    items = [" ".join(docs[i][1].split(" ")[3 : 3 + n])[1:] for i, n in ((9, 9), (12, 4), (17, 3), (23, 6), (29, 12)) if docs[i][1]] + ["b c", "zz", "a b zz c", None]
    rows, wanted = spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame([(x,) for x in items], "item string")
    want = {k for k, t in docs if t and any(x is not None and x in t for x in items)}
    assert {r.k for r in graph.holding(rows, wanted, "k", "t", "item").collect()} == want and want
    assert graph.holding(rows.limit(0), wanted, "k", "t", "item").count() == graph.holding(rows, wanted.limit(0), "k", "t", "item").count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100}


def test_tracker_ages_evicts_and_measures(spark):
    rows = [("c", f, 0, "cone", 10.0 + f, 10.0, 50.0 + f, 50.0, 20.0 - f) for f in range(12) if f != 5]
    rows += [("c", 0, 1, "cone", 500.0, 500.0, 540.0, 540.0, None), ("c", 0, 2, "barrier", 12.0, 10.0, 52.0, 50.0, 9.0)]
    schema = f"clip string, frame int, n int, class_name string, {BOX}, distance_m double"
    frames = spark.createDataFrame([("c", f) for f in range(12)], "clip string, frame int")
    out = tracking.track(spark.createDataFrame(rows, schema), "clip", "frame", "n", frames)
    by = {r.track_id: r for r in out.collect()}
    assert by[1].hits == 11 and by[1].misses == 0 and by[1].range_rate == pytest.approx(-1.0) and by[1].ttc == pytest.approx(9.0)
    assert by[2].evicted and by[3].evicted and by[2].range_rate is None
    assert [r.track_id for r in tracking.confirmed(out).collect()] == [1] == [r.track_id for r in tracking.surviving(out).collect()]


def plain_tracks(frames, min_overlap=0.2, max_misses=8):
    """(id, class, box, hits, misses, evicted) of all tracks, one box at a time."""
    live, gone, made = [], [], 0
    for boxes in frames:
        free = dict(enumerate(boxes))
        for t in live:
            scored = [(plain_iou(t["box"], b[1]), -i) for i, b in free.items() if b[0] == t["class"]]
            share, i = max(scored, default=(0, 0))
            if share > min_overlap:
                t.update(box=free.pop(-i)[1], hits=t["hits"] + 1, misses=0)
            else:
                t["misses"] += 1
        gone += [t for t in live if t["misses"] > max_misses]
        live = [t for t in live if t["misses"] <= max_misses]
        for _, b in sorted(free.items()):
            made += 1
            live.append({"id": made, "class": b[0], "box": b[1], "hits": 1, "misses": 0})
    return {(t["id"], t["class"], t["box"], t["hits"], t["misses"], t in gone) for t in live + gone}


@pytest.mark.parametrize("seed", range(3))
def test_tracks_equal_a_plain_loop(spark, seed):
    rng, rows, frames = random.Random(seed), [], []
    for f in range(40):
        boxes = []
        for n in range(rng.randint(0, 5)):
            x, y = rng.choice([0, 20, 60, 150]) + rng.uniform(-6, 6) + f / 2, rng.uniform(0, 15)
            boxes.append((rng.choice(["cone", "barrier"]), (x, y, x + 30, y + 30)))
            rows.append(("c", f, n, boxes[-1][0], *boxes[-1][1], None if rng.random() < 0.2 else rng.uniform(1, 9)))
        frames.append(boxes)
    table = spark.createDataFrame(rows, f"clip string, frame int, n int, class_name string, {BOX}, distance_m double")
    every = spark.createDataFrame([("c", f) for f in range(40)], "clip string, frame int")
    got = {(r.track_id, r.class_name, (r.x1, r.y1, r.x2, r.y2), r.hits, r.misses, r.evicted) for r in tracking.track(table, "clip", "frame", "n", every).collect()}
    assert got == plain_tracks(frames) and any(t[5] for t in got) and any(t[3] > 5 for t in got)


def test_runs_cross_batches(spark):
    rows = spark.createDataFrame([(k, i, float(i)) for k in ("a", None, "b", "c") for i in range(57)], "k string, i int, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        made = runs.map_runs(rows.repartition(5), ["k"], ["i"], lambda r: {"k": [r["k"][0]], "n": [len(r["i"])], "s": [(r["i"][1:] > r["i"][:-1]).all() * r["v"].sum()]}, "k string, n int, s double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.n, r.s) for r in made} == {(k, 57, 57 * 28.0) for k in ("a", None, "b", "c")} and len(made) == 4


def test_small_statistics(spark):
    weights = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0)], "layer string, w double")
    assert {(r.layer, r.parameters, r.zeros, r.nonzero) for r in statistics.parameter_counts(weights, "layer", "w").collect()} == {("a", 2, 1, 1), ("b", 1, 0, 1), (None, 3, 1, 2)}
    names = spark.createDataFrame([("map", 0.5), ("p", float("nan"))], "name string, v double")
    assert tuple(statistics.headline(names, "name", "v", ["map", "p", "r"]).first()) == (0.5, None, None)
    assert [r.id for r in statistics.tail(spark.range(50), ["id"], 3).collect()] == [49, 48, 47]
    with pytest.raises(ValueError):
        pixels.detector("weights.abc")
    with pytest.raises(ValueError):
        pixels.detector("weights.onnx")


def test_stream_tracks_equal_batch_tracks(spark, tmp_path):
    schema = f"clip string, frame int, n int, class_name string, {BOX}, distance_m double"
    rows = [(c, f, 0, "cone", 10.0 + f, 10.0, 50.0 + f, 50.0, 20.0 - f) for c in "ab" for f in range(6)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    seen: dict = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(str(tmp_path / "in"))

    def keep(batch, number):
        for r in batch.collect():
            seen[r.clip, r.track_id] = r

    flows.track_stream(stream, "clip", "frame", "n").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    want = {(r.clip, r.track_id): r for r in tracking.track(spark.createDataFrame(rows, schema), "clip", "frame", "n").collect()}
    assert seen.keys() == want.keys() and all(seen[k].hits == want[k].hits == 6 and seen[k].range_rate == pytest.approx(-1.0) for k in want)


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    rows = spark.range(60).select((F.timestamp_seconds(F.col("id") * 400)).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = flows.with_event_time(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 hour")
    out: list = []
    flows.each_batch(flows.windowed_counts(stream, "ts", ["k"], "v", "1 hour"), lambda b, n: out.extend(b.collect()), str(tmp_path / "ck")).awaitTermination(120)
    want = {tuple(r) for r in flows.windowed_counts(rows, "ts", ["k"], "v", "1 hour").collect()}
    # append mode gives windows that the watermark has closed
    assert out and {tuple(r) for r in out} <= want
    assert flows.sessions(rows, "ts", ["k"], "10 minutes").count() == 60 and flows.deduplicated(rows, ["k"]).count() == 3


def test_counts_keep_negatives(spark):
    images = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val")], "i int, split string")
    anns = spark.createDataFrame([(1, "cone"), (1, "cone"), (1, "barrier")], "i int, class_name string")
    counts = annotations.class_counts(images, anns, "i", "split", "class_name")
    got = {(r.split, r.class_name): r.n for r in counts.collect()}
    assert got["train", "__images__"] == 2 and got["train", "__negatives__"] == 1 and got["val", "__negatives__"] == 1 and got["train", "cone"] == 2
    lines = {r.split: r.summary for r in writers.summary_lines(writers.nested_counts(counts, "split", "class_name"), "split").collect()}
    assert lines["train"] == "train: images=2 negatives=1 barrier=1 cone=2"


def test_pseudo_labels_append_once(spark):
    labels = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0, "rw")], f"stem string, {BOX}, provenance string")
    pseudo = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0), ("a", 0.0, 0.0, 5.0, 9.0)], f"stem string, {BOX}")
    once = annotations.append_pseudo_labels(labels, pseudo)
    assert annotations.append_pseudo_labels(once, pseudo).count() == once.count() == 2


def test_audit(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "val"), ("b", "val"), ("c", "train")], "g string, split string")
    assert tuple(splits.affected(rows, "g").first()) == (1, 1, pytest.approx(100 / 3))
    assert {tuple(r) for r in splits.last_split_wins(rows, "g").collect()} == {("a", "val", True), ("b", "val", False), ("c", "train", False)}


def test_stems(spark):
    stems = ["rw_pittsburgh_0123abcdef_7_1500", "rw_pgh_12", "coco_000123", "bddstop_x", "other"]
    rows = spark.createDataFrame([(s,) for s in stems], "stem string")
    got = {r.stem: r for r in rows.select("stem", text.group_key(F.col("stem")).alias("g"), text.audit_key(F.col("stem")).alias("a"), text.clip_parts(F.col("stem")).alias("c")).collect()}
    assert got[stems[0]].g.grp == "pittsburgh/0123abcdef/7" and got[stems[0]].c.frame == 1500 and got[stems[0]].a == "rw::pittsburgh/0123abcdef/7"
    assert got["rw_pgh_12"].g.grp == "pgh" and got["rw_pgh_12"].a == "rw::rw_pgh_12" and got["rw_pgh_12"].c is None
    assert [got[s].g.source for s in stems] == ["rw", "rw", "coco", "bdd", "other"]
    line = rows.limit(1).select(text.label_line(F.lit(1), [F.lit(0.0078125), F.lit(0.5), F.lit(0.25), F.lit(1.0)]).alias("t")).first().t
    assert line == "1 0.007812 0.500000 0.250000 1.000000"


def test_blake_rank(spark):
    import hashlib

    got = spark.createDataFrame([("k",), (None,)], "k string").select(hashing.blake_fraction(F.col("k"), 3).alias("f")).collect()
    assert got[0].f == int.from_bytes(hashlib.blake2s(b"3:k", digest_size=8).digest(), "big") / 2**64 and got[1].f is None


def test_label_files_to_truth(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .5 .5 .05 .05\n1 .25 .25 .5 .5\nbad line\n9 .1 .1 .1 .1\n")
    (tmp_path / "b.txt").write_text("")
    lines = readers.label_lines(spark, str(tmp_path))
    images = spark.createDataFrame([("a", 400, 200), ("b", 400, 200)], "stem string, width int, height int")
    truth = readers.label_truth(lines, images, {0: "cone", 1: "barrier"}).orderBy("image_id", "line_no").collect()
    assert [(r.image_id, r.ann_id, r.category_id) for r in truth] == [(1, 1, 1), (1, 2, 2), (2, None, None)]
    assert (truth[0].x, truth[0].y, truth[0].bw, truth[0].bh) == pytest.approx((190, 95, 20, 10)) and truth[0].area == pytest.approx(200)


def test_csv_zip_and_coco(spark, tmp_path):
    body = "image_path,label,xmin,ymin,xmax,ymax\n/a.jpg,car,1,2,3,4\nb.jpg,sign,x,2,3,4\n"
    (tmp_path / "l.csv").write_text(body)
    assert [tuple(r) for r in readers.label_csv(spark, str(tmp_path / "l.csv")).collect()] == [("a.jpg", "car", 1.0, 2.0, 3.0, 4.0)]
    doc = {"images": [{"id": 1, "file_name": "p/a.jpg"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "Cone"}]}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("/d/l.csv", body)
        z.writestr("e/l.csv", "")
        z.writestr("c.json", json.dumps(doc))
    members = readers.zip_members(spark, str(tmp_path / "x.zip"))
    assert {(r.basename, r.member) for r in readers.by_basename(members).collect()} == {("l.csv", "e/l.csv"), ("c.json", "c.json")}
    assert readers.csv_in_zip(spark, str(tmp_path / "x.zip")).count() == 1
    _, anns, cats = readers.coco_in_zip(spark, str(tmp_path / "x.zip"), "c.json", ["Cone"])
    got = annotations.map_categories(anns.join(cats, "category_id"), {"Cone": "cone"}).first()
    assert (got.x2, got.y2, got.iscrowd, got.class_name) == (4.0, 6.0, 0, "cone")
    with pytest.raises(ValueError):
        readers.coco_in_zip(spark, str(tmp_path / "x.zip"), "c.json", ["Drum"])


def test_images_and_logs(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (300).to_bytes(2, "big") + (500).to_bytes(2, "big") + b"\x03"
    assert readers.header_size(png) == (640, 480) and readers.header_size(jpg) == (500, 300) and readers.header_size(b"no") is None
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "b.jpg").write_bytes(jpg)
    (tmp_path / "i" / "a.jpg").write_bytes(b"junk")
    rows = readers.image_files(spark, str(tmp_path / "i"), limit=5).withColumn("s", readers.image_size(F.col("content"))).collect()
    assert [(r.stem, r.s.width) for r in rows] == [("a", None), ("b", 500)]
    (tmp_path / "t.log").write_text("x\n all 10 0.5\nall 11 nan?\n  all 12 0.75\n")
    assert [tuple(r) for r in readers.epoch_curve(spark, str(tmp_path / "t.log")).orderBy("epoch").collect()] == [(1, 0.5), (2, 0.75)]
    assert readers.json_or_none(spark, str(tmp_path / "none.json")) is None and readers.json_or_none(spark, str(tmp_path / "t.log")) is None
    with pytest.raises(FileNotFoundError):
        readers.require_rows(spark.range(0), "no images")


def test_pixels(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 255, (40, 60, 3), np.uint8)
    rows = spark.createDataFrame([(40, 60, bytearray(img.tobytes())), (40, 60, bytearray(b"x"))], "h int, w int, d binary")
    good = rows.limit(1)
    for name in pixels.CORRUPTIONS:
        one, two, strong = (np.frombuffer(good.select(pixels.corrupted(F.col("h"), F.col("w"), F.col("d"), name, s).alias("d")).first().d, np.uint8).astype(float) for s in (2, 2, 5))
        assert len(one) == img.size and (one == two).all()
        assert np.abs(strong - img.ravel()).mean() > np.abs(one - img.ravel()).mean()
    depths = pixels.row_depths(1080, 1920)
    assert depths[0] == 150 and depths[-1] < 5
    hashes = rows.select(pixels.difference_hash(F.col("h"), F.col("w"), F.col("d"), 16).alias("x")).collect()
    assert len(hashes[0].x) == 4 and hashes[1].x is None
    with pytest.raises(KeyError):
        pixels.corrupted(F.col("h"), F.col("w"), F.col("d"), "snow")
    with pytest.raises(ValueError):
        pixels.corrupted(F.col("h"), F.col("w"), F.col("d"), "fog", 6)
    twice = pixels.detect(rows.select("h"), lambda: lambda pdf: pdf * 2, "h long")
    assert [r.h for r in twice.collect()] == [80, 80]


def test_reports(spark, tmp_path):
    labels = spark.createDataFrame([("train", "a", 1, 0, 0.5, 0.5, 0.1, 0.1), ("train", "a", 0, 1, 0.25, 0.5, 0.1, 0.1)], "split string, stem string, line_no int, cls int, cx double, cy double, w double, h double")
    assert writers.label_texts(labels).first().text.splitlines()[0].startswith("1 0.250000")
    writers.write_dataset(labels, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("split = 'train'").count() == 2
    assert "names:" in writers.descriptor(["val", "train"], {0: "cone"}, "/data")
    row = spark.createDataFrame([(1, "cone", 0.9, 0.0, 0.0, 1.0, 1.0, float("nan"), None, 1.0, 1.0, "size", ["f"])], f"frame int, class_name string, score double, {BOX}, distance_m double, sigma_m double, forward_m double, lateral_m double, method string, flags array<string>")
    assert json.loads(writers.predictions_json(row, "frame").first().json)[0]["distance_m"] is None
    assert writers.markdown(labels.select("stem", "cx"), ["stem", "cx"]).count("\n") == 3


def test_labels_of_all_boxes_have_fixed_decimals(spark):
    from kerbside.plans.fixtures import boxes

    made = boxes(spark, "/root/testdata/sf0.001").select("x1", text.frame_label(F.col("class_name"), F.col("x1")).alias("label"), text.decimals(F.col("y2"), 2).alias("shown"), "y2")
    rows = made.collect()
    assert any(r.x1 < 0 for r in rows) and any(r.x1 % 1 for r in rows)
    assert all(r.label.endswith(f", {r.x1:.1f}m") and r.shown == f"{r.y2:.2f}" for r in rows)


def test_a_detection_is_kept_in_one_row_and_long_runs_match_in_portions(spark, monkeypatch):
    rng = random.Random(4)
    cells = [(i, c, n) for i in range(30) for c in ("a", "b") for n in range(rng.choice([0, 1, 3, 12]))]
    box = lambda: (lambda x, y, s: (float(x), float(y), float(x + s), float(y + s)))(rng.randint(0, 40), rng.randint(0, 40), rng.choice([20, 30, 31, 60, 120]))
    edges = "x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame([(i, c, 100 * k, rng.choice([0.2, 0.5, 0.9]), *box()) for k, (i, c, _) in enumerate(cells)], f"image_id int, class_name string, det_id int, score double, {edges}")
    truths = spark.createDataFrame([(i, c, k, *box()) for k, (i, c, _) in enumerate(cells)], f"image_id int, class_name string, gt_id int, {edges}")
    assert evaluation.verdicts(det, truths).count() == len(cells)  # not one per threshold and range
    rows = evaluation.match(det, truths)
    whole = sorted(map(tuple, rows.collect()))
    assert len(whole) == 40 * len(cells)
    # the counts of a class go on from one range partition to the next: as by the curve over all rows of a line
    hits = rows.where("not ignored").join(evaluation.truth_counts(truths), ["class_name", "area_range"])
    curve = evaluation.precision_recall(hits, ["class_name", "area_range", "threshold"], ["-score", "det_id"], F.col("tp"), F.col("n_gt"))
    wanted = {tuple(r[:3]): tuple(r[3:]) for r in evaluation.interpolated(curve, ["class_name", "area_range", "threshold"]).collect()}
    got = evaluation.average_precision(det, truths).collect()
    assert any(r.ap > 0 for r in got)
    for r in got:
        assert (r.ap, r.recall) == pytest.approx(wanted.get(tuple(r[:3]), (0.0, 0.0)), abs=1e-12)


def test_clips_advance_together_as_one_by_one():
    rng = np.random.default_rng(2)
    frames = [[(c, np.cumsum(rng.uniform(0, 30, (k, 1)), 0) + np.array([0, 0, 40, 50]) * rng.uniform(0.8, 1.2, (k, 1))) for c in range(40) if (k := int(rng.integers(0, 5))) or c % 2] for _ in range(15)]
    together, calls = tracking.Tracks(max_misses=2, clips=40), 0
    apart = [tracking.Tracks(max_misses=2) for _ in range(40)]
    for n, frame in enumerate(frames):
        present = np.zeros(40, bool)
        present[[c for c, _ in frame]] = True
        kinds = [np.array(["cone", "sign"], object)[rng.integers(0, 2, len(b))] for _, b in frame]
        away = [rng.uniform(1, 9, len(b)) for _, b in frame]
        together.advance(np.concatenate(kinds), np.concatenate([b for _, b in frame]), np.concatenate(away), float(n), clip=np.repeat([c for c, _ in frame], [len(b) for _, b in frame]), present=present)
        calls += 1
        for (c, b), k, a in zip(frame, kinds, away, strict=True):
            _advance_by_matrix(apart[c], k, b, a, float(n))
    assert calls == 15
    rows = lambda t: {k: [str(x) for x in v] for k, v in t.columns().items()}
    made = rows(together)
    for c in range(40):
        at = np.flatnonzero(together.clip == c)
        assert {k: [v[i] for i in at] for k, v in made.items()} == rows(apart[c])


def _advance_by_matrix(tracks, class_name, box, distance, time) -> None:
    """One clip's frame with the choice written out over the whole matrix of overlaps."""

    def choose(live, class_name, box, clip):
        took, free = np.full(len(live), -1), np.ones(len(box), bool)
        for line, at in enumerate(live):
            shared = np.array([tracking._shared(tracks.box[[at]], box[[i]])[0] if free[i] and class_name[i] == tracks.class_name[at] else 0.0 for i in range(len(box))])
            if len(box) and shared.max() > tracks.min_overlap:
                took[line] = shared.argmax()
                free[took[line]] = False
        return took

    tracks._choose = choose
    tracks.advance(class_name, box, distance, time)


@pytest.mark.parametrize("wide", [3, 64])
def test_suppression_of_many_frames_at_once_equals_box_by_box(spark, wide):
    rng = random.Random(6)
    rows = [(i, k, rng.choice([0.3, 0.6, 0.9]), *(lambda x, y, s: (x, y, x + s, y + s))(rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(20, 60))) for i in range(60) for k in range(rng.choice([1, 2, 5, 30]))]
    calls = spark.sparkContext.accumulator(0)

    def counted(df, keys, order, fn, schema):
        def called(*args):
            calls.add(1)
            return fn(*args)

        return runs.map_run_batches(df, keys, order, called, schema)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "map_run_batches", counted)
        made = matching.suppress(spark.createDataFrame(rows, f"frame int, id int, score double, {BOX}"), "frame", "id", wide=wide)
        got = {(r.frame, r.id) for r in made.collect()}
    assert calls.value < 30  # not one per frame
    want = set()
    for f in range(60):
        held = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
            a, area = r[3:], lambda b: (b[2] - b[0]) * (b[3] - b[1])
            both = [max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0) for b in held]
            if not any(s > 0.45 * max(area(a) + area(b) - s, 1e-12) for s, b in zip(both, held, strict=True)):
                held.append(a)
                want.add((f, r[1]))
    assert got == want


def test_a_filter_on_a_range_does_not_repeat_the_cues(spark):
    from kerbside.operators import ranging

    rows = spark.createDataFrame([("cone", 900.0, 600.0, 960.0, 700.0)], f"class_name string, {BOX}")
    made = ranging.estimate_ranges(rows).where("distance_m is not null and lateral_m between -10 and 10 and forward_m between 0.5 and 90")
    assert made.count() == 1
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "height_sigma_m" not in " ".join(line for line in plan.splitlines() if "Filter" in line)


def test_a_resplit_parses_each_stem_once(spark):
    from kerbside.operators import datasets

    stems = [(f"rw_oslo_{k:08x}_7_{i}",) for k in range(5) for i in range(4)] + [(f"rw_roads_{i}",) for i in range(0, 60, 2)] + [("coco_1",)]
    made = datasets.resplit(spark.createDataFrame(stems, "stem string")).assignment
    assert made.count() == len(stems) - 8
    assert "RLIKE" not in made._jdf.queryExecution().optimizedPlan().toString().upper()
