"""Running values with one group that holds all rows, or nearly, against plain loops and windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import evaluation, scans, sequences, splits


@pytest.fixture
def split_all(monkeypatch):
    """Every group counts as too large for a window."""
    monkeypatch.setattr(scans, "GROUP_ROWS", 0)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def loop(rows: list[tuple], back: bool = False) -> dict:
    out, state = {}, {}
    for g, k, x in sorted(rows, key=lambda r: (r[0] or "", r[1]), reverse=back):
        total, top, last = state.get(g, (None, None, None))
        total = total if x is None else x + (total or 0)
        top = top if x is None else x if top is None else max(top, x)
        out[g, k] = (total, top, last)
        state[g] = (total, top, x)
    return out


@pytest.mark.parametrize("groups", [["a"], ["a", "a", "a", "b", "c", None], [f"g{i}" for i in range(300)]])
@pytest.mark.parametrize("back", [False, True])
def test_running_values_equal_a_loop(spark, split_all, groups, back):
    rng = random.Random(2)
    rows = [(rng.choice(groups), k, rng.choice([None, rng.randint(-9, 9)])) for k in range(1200)]
    df = spark.createDataFrame(rows, "g string, k int, x int").repartition(5)
    made = scans.Ordered.of(df, ["g"], ["k"])
    assert made.part
    made = made.running(sums={"s": F.col("x")}, tops={"t": F.col("x")}, lags={"l": F.col("x")}, back=back).done()
    assert {(r.g, r.k): (r.s, r.t, r.l) for r in made.collect()} == loop(rows, back)
    assert made.columns == ["g", "k", "x", "s", "t", "l"]


def test_one_key_is_split_and_small_groups_are_not_kept(spark):
    rows = spark.range(5000).select(F.lit("a").alias("g"), "id")
    split = scans.Ordered.of(rows, ["g"], ["id"], group_rows=100)
    assert split.rows.select("_scan_part").distinct().count() > 1
    assert not scans.Ordered.of(rows, ["g"], ["id"], group_rows=5000).part
    text = plan(split.running(sums={"n": F.lit(1)}).done())
    # no window over the whole group's rows; what is scanned per group are the partitions' summaries
    assert "_scan_part" in text and "windowspecdefinition(g#" not in text.split("== Physical Plan ==")[1].split("Filter")[0]


def test_descending_order_and_no_rows(spark, split_all):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("a", 3, 0.5), ("a", 4, 0.9)], "g string, k int, s double")
    made = scans.Ordered.of(df, ["g"], ["-s", "k"]).running(sums={"n": F.lit(1)}).done()
    assert {r.k: r.n for r in made.collect()} == {4: 1, 1: 2, 3: 3, 2: 4}
    assert scans.Ordered.of(df.limit(0), ["g"], ["k"]).running(sums={"n": F.lit(1)}).done().count() == 0


def test_whole_tables_have_no_key(spark, split_all):
    df = spark.range(700).repartition(3)
    made = scans.Ordered.of(df, [], ["-id"]).running(sums={"n": F.lit(1), "s": F.col("id")}).done()
    assert all(r.n == 700 - r.id and r.s == sum(range(r.id, 700)) for r in made.collect())


def test_runs_and_embargo_of_one_prefix(spark, split_all):
    rng = random.Random(3)
    idx = sorted(rng.sample(range(9000), 3000))
    made = sequences.segment_runs(spark.createDataFrame([("p", i) for i in idx], "prefix string, idx int"), "prefix", "idx", max_gap=6, max_run=40)
    made = sequences.embargo(made, ["prefix", "island", "chunk"], "idx")
    got = {r.idx: (r.island, r.chunk, r.dropped) for r in made.collect()}
    want, island, place, last = {}, 0, 0, None
    for i in idx:
        if last is not None and i - last > 6:
            island, place = island + 1, 0
        want[i], last, place = (island, place // 40), i, place + 1
    for segment in set(want.values()):
        own = [i for i in idx if want[i] == segment]
        for n, i in enumerate(own):
            assert got[i] == (*segment, len(own) > 16 and n >= len(own) - 8)


def test_greedy_fill_of_one_source(spark, split_all):
    rng = random.Random(4)
    groups = [("s", f"g{i}", rng.randint(0, 30), rng.random()) for i in range(2000)]
    made = splits.greedy_fill(spark.createDataFrame(groups, "source string, grp string, n int, r double"), "source", F.col("r"), "n", 0.27, ["grp"])
    got, before, total = {r.grp: r.split for r in made.collect()}, 0, sum(g[2] for g in groups)
    for _, grp, n, _ in sorted(groups, key=lambda g: (g[3], g[1])):
        assert got[grp] == ("val" if before < 0.27 * total else "train")
        before += n


def test_curve_of_one_class(spark, split_all):
    rng = random.Random(5)
    rows = [("c", round(rng.random(), 2), i, rng.random() < 0.4) for i in range(1500)]
    curve = evaluation.precision_recall(spark.createDataFrame(rows, "c string, score double, id int, hit boolean"), ["c"], ["-score", "id"], F.col("hit"))
    order, tp, want = sorted(rows, key=lambda r: (-r[1], r[2])), 0, []
    for n, r in enumerate(order, 1):
        tp += r[3]
        want.append((r[2], n, tp / n, tp / sum(x[3] for x in rows)))
    best = 0.0
    got = {r.id: r for r in curve.collect()}
    for i, n, precision, recall in reversed(want):
        best = max(best, precision)
        assert (got[i]["rank"], got[i].precision, got[i].recall, got[i].envelope) == (n, precision, recall, best)
