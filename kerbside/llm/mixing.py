"""Mixing sources to target weights over a domain-language-source tree.

A token budget goes down the tree.  Among siblings it is dealt by weight, and
nobody gets more than the leaves below can give (their tokens times the largest
number of epochs).  What a child cannot use goes to its siblings by weight; only
what a whole subtree cannot use reaches the siblings of its ancestors, because a
node's capacity is that of its subtree.  Each leaf then takes whole epochs and,
for the rest, a prefix of one more epoch in its own seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm._common import WORD_RE, free_names, own, stored
from kerbside.llm.sharding import unit_hash

#: A plan of more leaves than this is joined by shuffle instead of broadcast.
BROADCAST_LEAVES = 100_000
#: Parts of an epoch's order; only the part in which the prefix ends is sorted.
PARTS = 256


@dataclass(frozen=True)
class MixTree:
    """levels: names from the root down; weights: by path, names joined by "/"; others weigh ``default``."""

    weights: Mapping[str, float] = field(default_factory=dict)
    levels: Sequence[str] = ("domain", "lang", "source")
    default: float = 1.0

    def weight(self, depth: int) -> Column:
        path = F.concat_ws("/", *self.levels[: depth + 1])
        out = F.lit(float(self.default))
        for name, weight in self.weights.items():
            if name.count("/") == depth:
                out = F.when(path == name, F.lit(float(weight))).otherwise(out)
        return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _dealt(children: DataFrame, parents: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add ``got`` to rows with ``weight``, ``capacity`` and the parents' ``budget``.

    Children are ordered by capacity per weight.  One is full if the budget is
    enough to raise all to its level; the others share what the full ones leave.
    """
    level = F.col("capacity") / F.col("weight")
    by = Window.partitionBy(*(parents or [F.lit(0)])).orderBy("_level", *names)
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*(parents or [F.lit(0)]))
    live = children.where("capacity > 0").withColumn("_level", level)
    live = live.withColumn(
        "_full",
        F.coalesce(F.sum("capacity").over(before), F.lit(0.0)) + F.col("_level") * F.sum("weight").over(onward) <= F.col("budget") + 1e-6,
    )
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0.0))
    share = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    return live.withColumn("got", F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("weight") * left / share)).drop("_level", "_full")


def leaf_budgets(leaves: DataFrame, tree: MixTree, budget: float, max_epochs: int) -> DataFrame:
    """(levels, tokens) to (levels, tokens, leaf_budget): whole tokens per leaf."""
    levels = list(tree.levels)
    live = leaves
    for depth in range(len(levels)):
        live = live.withColumn(f"_w{depth}", tree.weight(depth))
    usable = F.lit(True)
    for depth in range(len(levels)):
        usable = usable & (F.col(f"_w{depth}") > 0)
    live = live.withColumn("capacity", F.when(usable, F.col("tokens") * float(max_epochs)).otherwise(0.0))
    plan = None
    for depth in range(len(levels)):
        names, parents = levels[: depth + 1], levels[:depth]
        rows = live.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.first(f"_w{depth}").alias("weight"))
        rows = rows.withColumn("budget", F.lit(float(budget))) if plan is None else rows.join(plan, parents)
        plan = _dealt(rows, parents, names).select(*names, F.col("got").alias("budget"))
    return leaves.join(plan, levels).select(*levels, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("leaf_budget"))


def mix(
    df: DataFrame,
    tree: MixTree,
    domain: Column,
    key: str = "doc_id",
    text: str = "text",
    share: float = 0.8,
    max_epochs: int = 2,
    seed: int = 17,
    tokens: Column | None = None,
) -> DataFrame:
    """The mixture: key, domain, lang, source, n_tokens, epoch (from 0), leaf_budget, ``_text``.

    One row per chosen row of ``df`` and epoch.  The budget is ``share`` of all
    tokens, which are words unless ``tokens`` gives a row's number of them (a
    null there is 0); ``lang`` and ``source`` are columns of ``df`` and a
    null there, or in ``domain``, is ``unknown``.  A leaf takes its prefix until
    the tokens before a row reach the budget, in the order of a hash of seed,
    epoch and key, then of key and text.  A null text has no token; leaves
    without tokens, and those of weight 0, give nothing.  Repeated rows count
    each, ties in the hash go by key and text, and an empty table gives none.  Texts
    are counted whole.  The order is cut into hash ranges whose sums tell where the prefix
    ends, so only one range of a leaf is sorted, and no text is shuffled:
    ``_text`` is its hash.
    """
    levels = list(tree.levels)
    named = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    rows = stored(
        df.select(
            F.col(key).alias("_key"),
            *[F.coalesce(named.get(x, F.col(x)).cast("string"), F.lit("unknown")).alias(x) for x in levels],
            (word_count(F.col(text)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")).alias("n_tokens"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
        ),
        "mix-rows",
    )
    leaves = stored(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total, count = leaves.agg(F.sum("tokens"), F.count("*")).first()
    plan = stored(leaf_budgets(leaves, tree, share * (total or 0), max_epochs), "mix-plan")
    plan = F.broadcast(plan) if count <= BROADCAST_LEAVES else plan
    whole = F.floor(F.col("leaf_budget") / F.col("tokens")).cast("int")
    placed = (
        rows.join(plan, levels)
        .withColumn("_epochs", whole)
        .withColumn("_rest", F.col("leaf_budget") - F.col("_epochs") * F.col("tokens"))
        .withColumn("_h", unit_hash(F.concat(F.lit(f"{seed}:"), F.col("_epochs").cast("string"), F.lit(":"), F.coalesce(F.col("_key").cast("string"), F.lit("")))))
        .withColumn("_part", F.floor(F.col("_h") * PARTS).cast("int"))
    )
    parts = placed.groupBy(*levels, "_part").agg(F.sum("n_tokens").alias("_sum"))
    order = Window.partitionBy(*levels).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(order), F.lit(0)))
    parts = F.broadcast(parts) if count * PARTS <= BROADCAST_LEAVES else parts
    open_ = placed.where("_rest > 0").join(parts, [*levels, "_part"]).where(F.col("_start") < F.col("_rest"))
    columns = [F.col("_key").alias(key), *levels, "n_tokens", "epoch", "leaf_budget", "_text"]
    sure = open_.where(F.col("_start") + F.col("_sum") <= F.col("_rest")).withColumn("epoch", F.col("_epochs")).select(*columns)
    inside = Window.partitionBy(*levels).orderBy("_h", "_key", "_text").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        open_.where(F.col("_start") + F.col("_sum") > F.col("_rest"))
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where(F.col("_before") < F.col("_rest"))
        .withColumn("epoch", F.col("_epochs"))
        .select(*columns)
    )
    full = placed.where("_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1))).select(*columns)
    return full.unionByName(sure).unionByName(edge)


def mixed_documents(
    df: DataFrame, tree: MixTree, domain: Column, key: str = "doc_id", text: str = "text", share: float = 0.8, seed: int = 17, tokens: Column | None = None
) -> DataFrame:
    """The rows of ``df``, all columns, that a mixture of one epoch at most takes, once each.

    Rows equal in key and text are taken together.
    """
    mark, k, t = free_names(df, "_mix_mark", "_mix_key", "_mix_text")
    chosen = mix(df, tree, domain, key, text, share, 1, seed, tokens).select(F.col(key).alias(k), F.col("_text").alias(t)).distinct()
    columns = own(df)
    marked = df.select(*columns, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(mark))
    return marked.join(chosen, F.col(key).eqNullSafe(F.col(k)) & (F.col(mark) == F.col(t)), "left_semi").select(*columns)
