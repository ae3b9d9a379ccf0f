"""Running values over ordered groups, however large one group is.

A window sorts each group in one task.  Where a group is too large for that, its
rows are range-partitioned by (group, order) instead and kept; every partition
makes its own running values and a summary of each group it holds (sum, maximum,
last value); the summaries before a partition are scanned, and as a partition can
continue only one group of the partitions before it, what it has to add is one row.
The same from the other end gives values that look ahead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.storage import cut

#: Groups of up to so many rows are sorted in one task, by an ordinary window.
GROUP_ROWS = 1_000_000


@dataclass(frozen=True)
class Ordered:
    """Rows in groups ``by``, in ``order``: names, with a minus in front for descending.

    Nulls come first, or last where the order descends.  Rows that are equal in
    group and order have to fit in one partition, so the order should end in a key.
    """

    rows: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    part: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, by: Sequence[str], order: Sequence[str], group_rows: int | None = None) -> Ordered:
        """Groups by ``by``; the rows are dealt by range and kept if a group has more than ``group_rows``."""
        group_rows = GROUP_ROWS if group_rows is None else group_rows
        size = df.groupBy(*by).count().agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
        made = cls(df, tuple(by), tuple(order))
        if (size["largest"] or 0) <= group_rows:
            return made
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size["all"] // GROUP_ROWS) if GROUP_ROWS else 0)
        kept = cut(df.repartitionByRange(parts, *by, *made._columns()).withColumn("_scan_part", F.spark_partition_id()))
        return replace(made, rows=kept, part=("_scan_part",))

    def _columns(self, back: bool = False) -> list[Column]:
        down = [c.startswith("-") != back for c in self.order]
        return [F.col(c.removeprefix("-")).desc() if d else F.col(c.removeprefix("-")).asc() for c, d in zip(self.order, down, strict=True)]

    def with_columns(self, columns: Mapping[str, Column]) -> Ordered:
        return replace(self, rows=self.rows.withColumns(columns))

    def running(self, sums: Mapping[str, Column] | None = None, tops: Mapping[str, Column] | None = None, lags: Mapping[str, Column] | None = None, back: bool = False) -> Ordered:
        """Add sums and maxima of a group's rows up to each one, and the value of the row before; ``back``: from the end of the group."""
        sums, tops, lags = dict(sums or {}), dict(tops or {}), dict(lags or {})
        order = Window.partitionBy(*self.part, *self.by).orderBy(*self._columns(back))
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        made = {k: F.sum(v).over(upto) for k, v in sums.items()} | {k: F.max(v).over(upto) for k, v in tops.items()} | {k: F.lag(v).over(order) for k, v in lags.items()}
        if not self.part:
            return replace(self, rows=self.rows.withColumns(made))
        own = {f"_scan_own_{k}": v for k, v in lags.items()}
        local = self.rows.withColumns({**made, **own, "_scan_first": F.row_number().over(order) == 1, "_scan_last": F.lead(F.lit(1)).over(order).isNull()})
        before = Window.partitionBy(*self.by).orderBy(F.col("_scan_part").desc() if back else F.col("_scan_part")).rowsBetween(Window.unboundedPreceding, -1)
        from_before = {k: F.sum(k).over(before) for k in sums} | {k: F.max(k).over(before) for k in tops} | {k: F.last(f"_scan_own_{k}").over(before) for k in lags}
        # one row per group and partition; those that go on from another partition are one per partition
        carried = local.where("_scan_last").select("_scan_part", *self.by, *[v.alias(f"_scan_c_{k}") for k, v in from_before.items()], F.count(F.lit(1)).over(before).alias("_scan_n")).where("_scan_n > 0")
        carried = carried.withColumnsRenamed({c: f"_scan_of{c}" for c in ("_scan_part", *self.by)})
        same = F.col("_scan_part") == F.col("_scan_of_scan_part")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_scan_of{c}"))
        both = local.join(F.broadcast(carried), same, "left")
        whole = {k: F.coalesce(F.col(k) + F.col(f"_scan_c_{k}"), k, f"_scan_c_{k}") for k in sums} | {k: F.greatest(k, f"_scan_c_{k}") for k in tops}
        whole |= {k: F.when(F.col("_scan_first"), F.col(f"_scan_c_{k}")).otherwise(F.col(k)) for k in lags}
        return replace(self, rows=both.select(*[c for c in self.rows.columns if c not in whole], *[v.alias(k) for k, v in whole.items()]))

    def done(self) -> DataFrame:
        return self.rows.drop(*self.part)
