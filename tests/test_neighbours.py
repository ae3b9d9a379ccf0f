"""Nearest codes by growing radius against all pairs."""

from __future__ import annotations

import random

import pytest

from kerbside.operators import graph


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(queries: list, corpus: list, within: int = 64) -> dict:
    out = {}
    for q, a in queries:
        near = min(((bin((a ^ b) & (2**64 - 1)).count("1"), k) for k, b in corpus if b is not None and k != q), default=None) if a is not None else None
        if near and near[0] <= within:
            out[q] = near[::-1]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(3)]
    codes = base + near + [base[0]] * 30 + [b & 0xFFFF for b in base[:10]] + [0]
    out = [(i, signed(c)) for i, c in enumerate(codes)] + [(9000, None), (9001, None)]
    rng.shuffle(out)
    return out


def found(df) -> dict:
    got = df.collect()
    assert len({r.query for r in got}) == len(got)
    return {r.query: (r.match, r.distance) for r in got}


@pytest.mark.parametrize("share", [100.0, 0.5, 0.0])
def test_nearest_of_all_rows(spark, rows, share):
    df = spark.createDataFrame(rows, "id bigint, code bigint").repartition(3)
    made = graph.nearest_by_radius(df, df, "id", "code", share=share, block=40)
    assert found(made) == brute(rows, rows)
    if share > 1:
        assert "NestedLoop" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("within", [0, 4, 6])
def test_within_a_radius_of_another_table(spark, rows, within):
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    queries, corpus = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    made = graph.nearest_by_radius(df.where("id % 3 = 0"), df.where("id % 3 <> 0"), "id", "code", within=within)
    assert found(made) == brute(queries, corpus, within)


def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    assert found(graph.nearest_by_radius(df, df.limit(0), "id", "code", within=6)) == {}
    assert found(graph.nearest_by_radius(df.limit(0), df, "id", "code")) == {}
    alone = df.where("id = 0")
    assert found(graph.nearest_by_radius(alone, alone, "id", "code")) == {}


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_of_a_query_set_and_all_rows_stay_in_their_task(spark, rows, block):
    df = spark.createDataFrame(rows, "id bigint, code bigint").repartition(3)
    made = graph.compared(df.where("id % 5 = 0"), df, "id", "code", best=2, block=block)
    assert "NestedLoop" not in made._jdf.queryExecution().toString()
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.query, r.place)):
        got.setdefault(r.query, []).append((r.distance, r.match))
    near = lambda q, a: sorted((bin((a ^ b) & (2**64 - 1)).count("1"), k) for k, b in rows if b is not None and k != q)[:2]
    assert got == {q: near(q, a) for q, a in rows if q % 5 == 0 and a is not None}
    assert {r.place for r in made.collect()} == {0, 1}


def test_codes_without_neighbours_are_compared_in_place(spark):
    rng = random.Random(3)
    rows = [(i, signed(rng.getrandbits(64))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    made = graph.nearest_by_radius(df, df, "id", "code")
    assert "CoGroups" in made._jdf.queryExecution().toString()
    some = rows[::60]
    assert {k: v for k, v in found(made).items() if k % 60 == 0} == brute(some, rows)


def test_both_sides_of_a_search_share_their_codes(spark, monkeypatch):
    import __spark_entry__

    seen = []
    monkeypatch.setattr(graph, "nearest_by_radius", lambda queries, corpus, *args, **options: seen.extend([queries, corpus]) or queries)
    __spark_entry__.queries()["hamming_nn_within"](spark, __spark_entry__.SMOKE_DIR)
    assert all("Generate" not in side._jdf.queryExecution().optimizedPlan().toString() for side in seen) and len(seen) == 2
