"""Quantiles found by selection equal those of all values at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_percentile(spark, seed, monkeypatch):
    monkeypatch.setattr(quantiles, "CELLS", [8, 16, 64][seed])
    rng = random.Random(seed)
    kinds = {
        "even": lambda: rng.random(), "ties": lambda: float(rng.randint(0, 3)), "tails": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        "same": lambda: 5.5, "few": lambda: rng.gauss(0, 1), None: lambda: rng.choice([None, -0.0, 0.0, rng.gauss(0, 1)]), "none": lambda: None,
    }
    rows = [(g, f()) for g, f in kinds.items() for _ in range(9 if g == "few" else 1500)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    want = {r.g: (r.n, r.q) for r in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    got = {r.g: (r.n, r.q) for r in quantiles.percentiles(df, ["g"], F.col("x"), PROBS, group_values=40).collect()}
    assert got == want


def test_whole_tables_other_aggregates_and_no_rows(spark):
    df = spark.range(3001).select((F.col("id") * 7 % 3001).alias("x"))
    made = quantiles.percentiles(df, [], F.col("x"), [0.5, 0.9], group_values=100, aggregates=[F.sum("x").alias("s")]).first()
    assert (made.n, made.q, made.s) == (3001, [1500.0, 2700.0], 3001 * 1500)
    none = quantiles.percentiles(df.limit(0), [], F.col("x"), [0.5]).first()
    assert none.n == 0 and none.q is None
    assert quantiles.percentiles(df.limit(0), ["x"], F.col("x"), [0.5]).count() == 0
