"""Detection metrics: matching, average precision by size and threshold, conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import boxes
from kerbside.operators.runs import map_run_batches, portions
from kerbside.operators.scans import Ordered
from kerbside.storage import cut

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
#: Area ranges in square pixels, both ends included as in the public protocol.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
#: One line per area range and threshold, in the order of MATCHES; their verdicts on a detection are the bits of a number.
LINES = [(area, t) for area in AREAS for t in THRESHOLDS]
VERDICTS = "class_name string, det_id bigint, score double, tp bigint, ignored bigint"


def match(detections: DataFrame, truths: DataFrame, image: str = "image_id", max_dets: int = 100) -> DataFrame:
    """Greedy matching per image and class at every threshold and area range.

    detections: image, class_name, det_id, score, box; truths: image,
    class_name, gt_id, box.  Detections go by score, then det_id.  Each takes the
    free truth with the largest overlap at or over the threshold, truths inside
    the area range before those outside.  What matches an outside truth, and what
    is unmatched and itself outside, is ignored.
    """
    line = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("area_range"), F.lit(t).alias("threshold")) for i, (a, t) in enumerate(LINES)]))
    bit = lambda c: F.call_function("getbit", F.col(c), F.col("_l.i")) == 1
    rows = verdicts(detections, truths, image, max_dets).withColumn("_l", line)
    return rows.select("class_name", "det_id", "score", "_l.area_range", "_l.threshold", bit("tp").alias("tp"), bit("ignored").alias("ignored"))


def verdicts(detections: DataFrame, truths: DataFrame, image: str = "image_id", max_dets: int = 100) -> DataFrame:
    """``match`` with one row per detection: the bits of ``tp`` and ``ignored`` are its verdicts in the order of LINES.

    Pairs below the least threshold decide nothing, and a detection and a truth
    that can only meet each other need no choice, so both go for many images at
    once; the choice among the rest is sequential per image and class.
    """
    none = F.lit(None).cast("double")
    det = detections.select(F.col(image).alias("image"), "class_name", F.col("det_id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), *[F.col(e).cast("double") for e in boxes.EDGES], F.lit(0).alias("kind"))
    gt = truths.select(F.col(image).alias("image"), "class_name", F.col("gt_id").cast("long").alias("id"), none.alias("score"), *[F.col(e).cast("double") for e in boxes.EDGES], F.lit(1).alias("kind"))

    def run(rows, starts):
        import numpy as np

        n = len(rows["kind"])
        sizes = np.diff(np.append(starts, n))
        of = np.repeat(np.arange(len(starts)), sizes)  # a row's run
        is_det = rows["kind"] == 0
        n_det = np.add.reduceat(is_det.astype(int), starts)
        seen = is_det & (np.arange(n) - starts[of] < max_dets)
        dets = np.flatnonzero(seen)
        if not len(dets):
            return None
        x1, y1, x2, y2 = (rows[e].astype(float) for e in boxes.EDGES)
        size = (x2 - x1) * (y2 - y1)
        lows, tops = (np.repeat([r[k] for r in AREAS.values()], len(THRESHOLDS))[:, None] for k in (0, 1))
        least = np.tile(THRESHOLDS, len(AREAS))[:, None] - 1e-10
        outside = lambda at: (size[at] < lows) | (size[at] > tops)
        tp, ignored = np.zeros((len(LINES), len(dets)), bool), outside(dets)
        # a run's truths come behind its detections
        first, many = starts + n_det, sizes - n_det
        pairs = [_overlaps(np.arange(a, b), dets, first[of[dets]], many[of[dets]], (x1, y1, x2, y2), size, min(THRESHOLDS) - 1e-10) for a, b in portions(many[of[dets]])]
        d, t, overlap = (np.concatenate(c) for c in zip(*pairs, strict=True))
        alone = (np.bincount(d, minlength=len(dets))[d] == 1) & (np.bincount(t, minlength=n)[t] == 1)
        ds, ts = d[alone], t[alone]
        aside, met = outside(ts), overlap[alone] >= least
        tp[:, ds] = met & ~aside
        ignored[:, ds] = np.where(met, aside, ignored[:, ds])
        d, t, overlap = d[~alone], t[~alone], overlap[~alone]
        lines = np.arange(len(LINES))
        begins = np.flatnonzero(np.diff(of[dets[d]], prepend=-1))
        for a, b in zip(begins, np.append(begins, len(d))[1:], strict=True):
            which, column = np.unique(t[a:b], return_inverse=True)  # the run's truths that are met, in their order
            aside, free = outside(which), np.ones((len(LINES), len(which)), bool)
            own = np.flatnonzero(np.diff(d[a:b], prepend=-1))
            for i, j in zip(own, np.append(own, b - a)[1:], strict=True):
                shared = np.full(len(which), -1.0)
                shared[column[i:j]] = overlap[a + i : a + j]
                ok = free & (shared >= least)
                if not ok.any():
                    continue
                inner = ok & ~aside
                use = np.where(inner.any(1, keepdims=True), inner, ok)
                # the last of equals, as the public protocol keeps replacing at equal overlap
                at = len(which) - 1 - np.where(use, shared, -1.0)[:, ::-1].argmax(1)
                hit = use[lines, at]
                free[lines[hit], at[hit]] = False
                tp[hit, d[a + i]], ignored[hit, d[a + i]] = ~aside[lines[hit], at[hit]], aside[lines[hit], at[hit]]
        bits = 1 << lines.astype(np.int64)
        return {"class_name": rows["class_name"][dets], "det_id": rows["id"][dets].astype(np.int64), "score": rows["score"][dets].astype(float), "tp": bits @ tp, "ignored": bits @ ignored}

    both = det.unionByName(gt)
    return map_run_batches(both, ["image", "class_name"], ["kind", F.col("score").desc(), "id"], run, VERDICTS)


def _overlaps(some, dets, first, many, box, size, least):
    """Places of detections and rows of truths of the same run that overlap by ``least``, with the overlap."""
    import numpy as np

    d = np.repeat(some, many[some])
    t = first[d] + np.arange(len(d)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
    x1, y1, x2, y2 = box
    a = dets[d]
    wide = np.minimum(x2[a], x2[t]) - np.maximum(x1[a], x1[t])
    high = np.minimum(y2[a], y2[t]) - np.maximum(y1[a], y1[t])
    both = np.clip(wide, 0, None) * np.clip(high, 0, None)
    overlap = both / np.maximum(size[a] + size[t] - both, 1e-12)
    keep = overlap >= least
    return d[keep], t[keep], overlap[keep]


def truth_counts(truths: DataFrame) -> DataFrame:
    """(class_name, area_range, n_gt)."""
    size = boxes.area(boxes.columns())
    inside = F.array(*[F.when(size.between(lo, hi), F.lit(k)) for k, (lo, hi) in AREAS.items()])
    return truths.select("class_name", F.explode(F.array_compact(inside)).alias("area_range")).groupBy("class_name", "area_range").agg(F.count("*").alias("n_gt"))


def precision_recall(df: DataFrame, by: list[str], order: list[str], hit: Column, total: Column | None = None) -> DataFrame:
    """Add rank, precision, recall and the precision envelope: the largest precision at this recall or more.

    ``order`` are names, with a minus for descending.  ``total`` is the number of
    hits there are to find, by default those of the group.  A group of any size
    is split over tasks; the envelope looks ahead, which is a running maximum from the other end.
    """
    made = Ordered.of(df.withColumn("_hit", F.coalesce(hit.cast("long"), F.lit(0))), by, order).running(sums={"rank": F.lit(1), "_tp": F.col("_hit")})
    made = made.with_columns({"precision": F.col("_tp") / F.col("rank")})
    made = made.running(tops={"envelope": F.col("precision")}, sums={"_rest": F.col("_hit")}, back=True).done()
    found = F.col("_tp") + F.col("_rest") - F.col("_hit") if total is None else total
    return made.withColumn("recall", F.when(found != 0, F.col("_tp") / found)).drop("_hit", "_tp", "_rest")


def interpolated(curve: DataFrame, by: list[str]) -> DataFrame:
    """``ap``, the average of the envelope at recalls 0, 0.01 .. 1 with 0 beyond the highest recall, and that ``recall``.

    The envelope at a point is the largest precision of the rows that reach it,
    so rows are first reduced to one per group and point.
    """
    # recalls are fractions; a point counts as reached within 1e-9
    reached = F.floor(F.col("recall") * 100 + 1e-9)
    return _averaged(curve.select(*by, reached.alias("_k"), F.col("precision").alias("_p"), F.col("recall").alias("_r")), by)


def _averaged(points: DataFrame, by: list[str]) -> DataFrame:
    steps = points.groupBy(*by, "_k").agg(F.max("_p").alias("_p"), F.max("_r").alias("_r"))
    back = Window.partitionBy(*by).orderBy(F.col("_k").desc())
    envelope = F.max("_p").over(back.rowsBetween(Window.unboundedPreceding, 0))
    points = F.col("_k") - F.lead("_k", 1, -1).over(back)
    return steps.withColumn("_a", envelope * points).groupBy(*by).agg((F.sum("_a") / 101).alias("ap"), F.max("_r").alias("recall"))


def average_precision(detections: DataFrame, truths: DataFrame, image: str = "image_id") -> DataFrame:
    """(class_name, area_range, threshold, ap, recall) for every class with truth in the range; 0 without detections.

    A detection stays one row with its verdicts as bits.  All lines share one
    order, so the rows are range-partitioned once; a first pass counts what every
    partition has of a class, a second one goes on from the counts before its
    partition and keeps, per class and line, the best precision at each point of recall.
    """
    by = ["class_name", "area_range", "threshold"]
    counts = truth_counts(truths)
    grid = counts.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    # kept, as the choice is made in Python and a range partition reads it twice
    made = cut(verdicts(detections, truths, image).where(F.col("class_name").isNotNull()))
    order = [F.col("class_name"), F.col("score").desc(), F.col("det_id")]
    dealt = cut(made.repartitionByRange(*order).sortWithinPartitions(*order).select("class_name", "tp", "ignored"))
    ap = _averaged(_points(dealt, counts), by)
    return grid.join(ap, by, "left").select(*by, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def _points(dealt: DataFrame, counts: DataFrame) -> DataFrame:
    """(class_name, area_range, threshold, _k, _p, _r): the best precision and recall of each partition at each point of recall it reaches.

    ``dealt`` is in order by class, across and within its partitions.
    """

    def classes(batches):
        """Rows of one class of a batch: class, tp and counted as matrices (rows x lines)."""
        import numpy as np

        for pdf in batches:
            names, bits = pdf["class_name"].to_numpy(), np.arange(len(LINES))
            begins = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else []
            tp, counted = (pdf["tp"].to_numpy()[:, None] >> bits) & 1, 1 - ((pdf["ignored"].to_numpy()[:, None] >> bits) & 1)
            for a, b in zip(begins, np.append(begins, len(names))[1:], strict=True):
                yield names[a], tp[a:b], counted[a:b]

    def sums(batches):
        import pandas as pd
        from pyspark import TaskContext

        out = {}
        for name, tp, counted in classes(batches):
            h, n = out.get(name, (0, 0))
            out[name] = h + (tp & counted).sum(0), n + counted.sum(0)
        if out:
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "class_name": list(out), "hits": [h.tolist() for h, _ in out.values()], "n": [n.tolist() for _, n in out.values()]})

    # some forty numbers per partition and class of it, and a row per class and area range
    before, total = {}, {}
    for r in sorted(dealt.mapInPandas(sums, "part int, class_name string, hits array<bigint>, n array<bigint>").collect(), key=lambda r: r["part"]):
        h, n = total.get(r["class_name"], ([0] * len(LINES),) * 2)
        before[r["part"], r["class_name"]] = h, n
        total[r["class_name"]] = [x + y for x, y in zip(h, r["hits"], strict=True)], [x + y for x, y in zip(n, r["n"], strict=True)]
    truths = {(r["class_name"], r["area_range"]): r["n_gt"] for r in counts.collect()}

    def curves(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), {}
        for name, tp, counted in classes(batches):
            if name not in state:
                state[name] = [np.array(v) for v in before[part, name]] + [np.full((2, len(LINES), 101), -1.0)]
            hits, places, best = state[name]
            n_gt = np.array([truths.get((name, area), 0) for area, _ in LINES])
            tp = tp & counted
            row, line = np.nonzero(tp * (n_gt > 0))  # precision is highest where a hit comes
            h, place = (hits + np.cumsum(tp, 0))[row, line], (places + np.cumsum(counted, 0))[row, line]
            point = np.floor(h / n_gt[line] * 100 + 1e-9).astype(int)
            np.maximum.at(best[0], (line, point), h / place)
            np.maximum.at(best[1], (line, point), h / n_gt[line])
            state[name] = [hits + tp.sum(0), places + counted.sum(0), best]
        for name, (_, _, best) in state.items():
            line, point = np.nonzero(best[0] >= 0)
            yield pd.DataFrame({"class_name": name, "area_range": [LINES[i][0] for i in line], "threshold": [LINES[i][1] for i in line], "_k": point, "_p": best[0][line, point], "_r": best[1][line, point]})

    return dealt.mapInPandas(curves, "class_name string, area_range string, threshold double, _k bigint, _p double, _r double")


def summary(ap: DataFrame) -> DataFrame:
    """One row: map_50_95, map_50, map_75, map_small, map_medium, map_large, ar_100; null where no class has truth."""
    of = lambda area, t=None: F.avg(F.when((F.col("area_range") == area) & (F.lit(True) if t is None else F.col("threshold") == t), F.col("ap")))
    return ap.agg(
        of("all").alias("map_50_95"), of("all", 0.5).alias("map_50"), of("all", 0.75).alias("map_75"), of("small").alias("map_small"),
        of("medium").alias("map_medium"), of("large").alias("map_large"), F.avg(F.when(F.col("area_range") == "all", F.col("recall"))).alias("ar_100"),
    )


def retained(df: DataFrame, condition: str, metric: str, clean: str) -> DataFrame:
    """Metric of each other condition over that of ``clean``, 0 where the clean one is not positive; best first by ``retained``."""
    base = F.max(F.when(F.col(condition) == clean, F.col(metric))).over(Window.partitionBy(F.lit(0)))
    ratio = F.when(F.col("_clean") > 0, F.col(metric) / F.col("_clean")).otherwise(F.lit(0.0))
    return df.withColumn("_clean", base).where(F.col(condition) != clean).withColumn("retained", ratio).drop("_clean")
