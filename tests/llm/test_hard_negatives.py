"""Hard negatives against all scores in plain Python, with ties, repeats and odd rows."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import hard_negatives

ROWS = "vec_id bigint, embedding array<double>, label int"


def plain(rows: list[tuple], every: int = 50) -> collections.Counter:
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = list({(k, label, tuple(map(int, v))): None for k, v, label in rows})
    least, most = -(1 << 63), (1 << 63) - 1
    out = []
    for me in (r for r in rows if r[0] is not None and r[0] % every == 0):
        score = lambda r: min(max(sum(a * b for a, b in zip(me[2], r[2])), least), most)  # noqa: B023, E731
        ranked = sorted((-score(r), r[0] is None, r[0] or 0, r[0], r[1]) for r in rows if r != me)
        for p in [r for r in ranked if r[4] == me[1]][:5]:
            good = [r for r in ranked if r[4] != me[1] and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]][:3]
            out += [(me[0], p[3], i + 1, r[3], -p[0], -r[0]) for i, r in enumerate(good)]
    return collections.Counter(out)


def mined(df, every: int = 50, **more) -> collections.Counter:
    return collections.Counter(tuple(r) for r in hard_negatives.mine(df, F.col("id") % every == 0, **more).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 60, (6, 12))
    out = [(i, [float(x) for x in np.floor(centres[i % 6] + rng.normal(0, 30, 12))], int(rng.integers(0, 4))) for i in range(900)]
    hot = out[17][1]
    out += [(1000 + i, hot, i % 3) for i in range(400)]  # one vector under many keys: ties
    out += out[:60] + [(50, out[3][1], 1), (50, out[4][1], 2), (None, out[5][1], 1), (None, hot, 2)]
    out += [(2000, None, 1), (2001, hot, None), (2002, [1.0, None], 1), (2050, [float("nan")] * 12, 1), (2100, [float("inf")] * 12, 0)]
    return out + [(2150, [], 1), (2151, [7.0, -3.0], 2), (2200, [-0.0] * 12, 3), (2201, [0.0] * 12, 3)]


def test_equal_to_all_scores(spark, rows):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert mined(df.withColumns({c: F.lit("x") for c in ("id", "vec", "slot", "part")})) == plain(rows)


@pytest.mark.parametrize("pivots", [0, 1, 40])
def test_parts_blocks_and_pivots_do_not_matter(spark, rows, monkeypatch, pivots):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    df = spark.createDataFrame(rows, ROWS)
    assert mined(df, 10, pivots=pivots, anchors_a_part=25) == plain(rows, 10)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(i, [float(2**40 + i), float(-(2**30) * i), float(2**35)], i % 2) for i in range(20)]
    rows += [(50, [1e200, 0.0, 0.0], 0), (51, [1e150, 1.0, 0.0], 0), (52, [3.0, 0.0, 0.0], 1)]
    assert mined(spark.createDataFrame(rows, ROWS), 10) == plain(rows, 10)


def test_empty_tables_and_no_anchors(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    assert not mined(df.limit(0)) and not mined(df.where("vec_id = 1"))
    assert not mined(df.where("vec_id = 100"))


def test_brackets_hold_and_spare_work():
    rng = np.random.default_rng(4)
    rows = np.floor(np.concatenate([rng.normal(c, 12, (300, 16)) for c in rng.normal(0, 120, (8, 16))]))
    squares = (rows**2).sum(1)
    top = squares.max()
    pivots = hard_negatives.choose_pivots(rows[::7], top, 12)
    anchors = hard_negatives._Anchors([{"id": i, "label": 0, "vec": list(rows[i])} for i in range(0, len(rows), 100)], top, 16, pivots)
    block = object.__new__(hard_negatives._Block)
    block.id, block.far = np.arange(len(rows)), hard_negatives._distances(rows, squares, top, pivots)
    of = np.arange(len(anchors.id))
    low, high = anchors.brackets(block, of)
    exact = anchors.vectors @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(exact, 1)[:, -5][:, None]
    assert (high >= fifth).mean() < 0.35  # two thirds of the rows need no score
