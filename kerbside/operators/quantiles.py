"""Exact quantiles of groups of any size.

``percentile`` keeps all distinct values of a group in one task.  For large groups
the wanted ranks are searched instead: a sketch of the values names a narrow
interval around each rank, one exact count says how many values lie below and
inside it, and the next pass looks inside only, until what is left fits in one
task.  The sketch only proposes; the counts decide, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.storage import cut

#: Values of a group that one task may hold, and intervals that a pass distinguishes.
GROUP_VALUES, CELLS = 1_000_000, 256


def percentiles(df: DataFrame, by: Sequence[str], value: Column, probs: Sequence[float], group_values: int | None = None, aggregates: Sequence[Column] = ()) -> DataFrame:
    """(*by, n, q, *aggregates): the number of values that are not null, their percentiles as an array, and whatever else is asked of the group.

    Between two values percentiles are interpolated, as ``percentile`` does.  A
    group without values has n = 0 and a null q.  Groups of up to
    ``group_values`` go to ``percentile`` itself.  Without ``by`` there is one row.
    """
    limit = GROUP_VALUES if group_values is None else group_values
    rows = df.withColumn("_v", value.cast("double") + F.lit(0.0))
    whole = F.percentile("_v", F.array(*map(F.lit, map(float, probs)))).alias("q")
    if rows.groupBy(*by).agg(F.count("_v").alias("n")).where(F.col("n") > limit).isEmpty():
        return rows.groupBy(*by).agg(F.count("_v").alias("n"), whole, *aggregates)
    sizes = cut(rows.groupBy(*by).agg(F.count("_v").alias("n"), *aggregates))
    wide = sizes.withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0).alias("_")))
    values = rows.where("_v is not null").select((F.struct(*by) if by else F.struct(F.lit(0).alias("_"))).alias("_g"), "_v")
    # at most one large group for every ``limit`` rows
    large = F.broadcast(wide.where(F.col("n") > limit).select("_g"))
    small = values.join(large, "_g", "left_anti").groupBy("_g").agg(whole)
    q = small.unionByName(_searched(values.join(large, "_g"), wide.where(F.col("n") > limit), probs, limit))
    return wide.join(q, "_g", "left").select(*by, "n", "q", *[c for c in sizes.columns if c not in ("n", *by)])


def _searched(values: DataFrame, sizes: DataFrame, probs: Sequence[float], limit: int) -> DataFrame:
    """(_g, q) of large groups."""
    places = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")
    none = F.lit(None).cast("double")
    # ranks from 0; of the values with them, below and inside the interval from lo to hi
    state = sizes.select("_g", "n", places).withColumn("at", F.col("p") * (F.col("n") - 1))
    state = state.select("_g", "i", "at", F.floor("at").alias("r0"), F.ceil("at").alias("r1"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(False).alias("stuck"))
    state = cut(state)
    grid = F.array(*[F.lit(k / CELLS) for k in range(CELLS + 1)])
    open_ = (F.col("inside") > limit) & ~F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)) & ~F.col("stuck")

    def inside(which: DataFrame) -> DataFrame:
        # a row per large group and percentile
        near = F.coalesce(F.col("_v") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("_v") <= F.col("hi"), F.lit(True))
        return values.join(F.broadcast(which), "_g").where(near)

    while not state.where(open_).isEmpty():
        going = state.where(open_)
        sketch = inside(going.select("_g", "i", "lo", "hi")).groupBy("_g", "i").agg(F.percentile_approx("_v", grid, 20 * CELLS).alias("s"))
        share = lambda r: (r - F.col("below")) / F.col("inside") * CELLS
        first = F.greatest(F.floor(share(F.col("r0"))) - 1, F.lit(0)).cast("int")
        last = F.least(F.ceil(share(F.col("r1") + 1)) + 1, F.lit(CELLS)).cast("int")
        ends = cut(going.join(sketch, ["_g", "i"]).select("_g", "i", "lo", "hi", F.get("s", first).alias("a"), F.get("s", last).alias("b")))
        counted = inside(ends).groupBy("_g", "i").agg(F.count_if(F.col("_v") < F.col("a")).alias("c"), F.count_if(F.col("_v") <= F.col("b")).alias("d"), F.first("a").alias("a"), F.first("b").alias("b"))
        left, right = F.col("r0") >= F.col("below") + F.col("c"), F.col("r1") < F.col("below") + F.col("d")
        now = F.when(right, F.col("d")).otherwise(F.col("inside")) - F.when(left, F.col("c")).otherwise(F.lit(0))
        closer = going.join(counted, ["_g", "i"]).select(
            "_g", "i", "at", "r0", "r1", F.when(left, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(right, F.col("b")).otherwise(F.col("hi")).alias("hi"),
            F.when(left, F.col("below") + F.col("c")).otherwise(F.col("below")).alias("below"), now.alias("inside"), (now >= F.col("inside")).alias("stuck"),
        )
        state = cut(state.where(~open_).unionByName(closer))
    same = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    # up to ``limit`` values each, in order
    lists = inside(state.where(~same).select("_g", "i", "r0", "r1", "lo", "hi", "below")).groupBy("_g", "i").agg(F.sort_array(F.collect_list("_v")).alias("l"), F.first("below").alias("k"))
    pair = state.join(lists, ["_g", "i"], "left")
    of = lambda r: F.when(same, F.col("lo")).otherwise(F.get("l", (F.col(r) - F.col("k")).cast("int")))
    pair = pair.select("_g", "i", "at", "r0", "r1", of("r0").alias("x"), of("r1").alias("y"))
    between = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.col("r1") - F.col("at")) * F.col("x") + (F.col("at") - F.col("r0")) * F.col("y"))
    return pair.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))), lambda e: e["q"]).alias("q"))
