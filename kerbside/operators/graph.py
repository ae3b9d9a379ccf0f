"""Duplicate groups: exact, by banded hashes, and as connected components."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.hashing import hamming
from kerbside.storage import cut


def exact_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Groups of two rows and more with the same content: smallest key and size."""
    return df.groupBy(F.md5(content).alias("digest")).agg(F.min(key).alias("first_key"), F.count("*").alias("n")).where("n > 1")


def band_pairs(df: DataFrame, key: str, code: str, bits: int = 64, blocks: int | None = None, within: int = 3) -> DataFrame:
    """Pairs (a, b) with a < b whose codes differ in at most ``within`` bits, with their ``distance``.

    A code is cut into ``blocks`` (twice ``within``, where none is given).  As many
    differing bits leave all but ``within`` blocks equal, so pairs meet under
    every choice of that many blocks, and nothing is lost.  The keys are half a
    code long, so buckets stay small as the table grows.  Rows with equal codes
    are paired with the smallest of them alone, and codes are compared once each.
    """
    blocks = 2 * within if blocks is None else blocks
    if not within < blocks <= bits:
        raise ValueError("there must be more blocks than differing bits, and no more than bits")
    edges = [bits * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("_h", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    codes = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("_h")).agg(F.min(key).alias("_k"))
    chosen = list(combinations(range(blocks), blocks - within))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(*[part[j] for j in some]).alias("v")) for i, some in enumerate(chosen)])
    placed = codes.withColumn("_p", F.explode(keys)).select("_k", "_h", "_p.i", "_p.v")
    other = placed.select("i", "v", F.col("_k").alias("b"), F.col("_h").alias("_g"))
    near = (
        placed.join(other, ["i", "v"])
        .where((F.col("_k") < F.col("b")) & (hamming(F.col("_h"), F.col("_g")) <= within))
        .select(F.col("_k").alias("a"), "b", hamming(F.col("_h"), F.col("_g")).alias("distance"))
        .dropDuplicates(["a", "b"])
    )
    same = df.select(F.col(key).alias("b"), F.col(code).alias("_h")).join(codes, "_h").where("b > _k")
    return near.unionByName(same.select(F.col("_k").alias("a"), "b", F.lit(0).alias("distance")))


def _fewest_bits(q: DataFrame, c: DataFrame, best: int, block: int) -> DataFrame:
    """(query, match, distance): per row of ``q`` (query, _q) and block of ``c`` (_k, _c, _not) the ``best`` rows with the fewest differing bits.

    Rows with ``_not`` equal to the query are left out; of equals the smallest _k comes first.  Both
    sides are cut into blocks of about ``block`` rows, and a task holds one of each; a row is sent
    once per block of the other side, and what a task gives back is ``best`` rows a query.
    """
    kinds, size = dict(q.dtypes) | dict(c.dtypes), c.count()
    across, down = max(1, -(-q.count() // block)), max(1, -(-size // block), min(32, size // 4096))
    place = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(4 * across * down, 4096)
    q = q.select("*", place("query", across).alias("_i"), each(down).alias("_j")).repartition(tasks, "_i", "_j")
    c = c.select("*", place("_k", down).alias("_j"), each(across).alias("_i")).repartition(tasks, "_i", "_j")

    def nearest(asked, known):
        import numpy as np
        import pandas as pd

        known = known.sort_values("_k", kind="stable")
        keys, codes, barred = (known[x].to_numpy() for x in ("_k", "_c", "_not"))
        by_barred = np.argsort(barred, kind="stable")
        lo, hi = (np.searchsorted(barred[by_barred], asked["query"].to_numpy(), side) for side in ("left", "right"))
        names, wanted, out = asked["query"].to_numpy(), asked["_q"].to_numpy(), []
        # bits of negative numbers count too
        codes, wanted = (x.astype(np.int64).view(np.uint64) for x in (codes, wanted))
        for a in range(0, len(wanted) if len(codes) else 0, 64):
            some = wanted[a : a + 64]
            bits = np.empty((len(some), len(codes)), np.uint8)
            for b in range(0, len(codes), 4096):
                np.bitwise_count(some[:, None] ^ codes[None, b : b + 4096], out=bits[:, b : b + 4096])
            for i in range(len(some)):
                bits[i, by_barred[lo[a + i] : hi[a + i]]] = 255
            for _ in range(min(best, len(codes))):
                at = bits.argmin(1)
                least = bits[np.arange(len(some)), at]
                real = least < 255
                out.append((names[a : a + 64][real], keys[at[real]], least[real]))
                bits[np.arange(len(some)), at] = 255
        made = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query", "match", "distance"), made, strict=True)))

    return q.groupBy("_i", "_j").cogroup(c.groupBy("_i", "_j")).applyInPandas(nearest, f"query {kinds['query']}, match {kinds['_k']}, distance int")


def compared(queries: DataFrame, corpus: DataFrame, key: str, code: str, best: int = 1, block: int = 100_000) -> DataFrame:
    """Per query the ``best`` corpus rows with the fewest differing bits, smaller keys first: query, place, match, distance.

    A stated query set against all rows: blocks of about ``block`` queries meet
    blocks of the corpus, a pair of blocks in a task, so any number of them works and no pair leaves its task.
    """
    q = queries.where(F.col(code).isNotNull()).select(F.col(key).alias("query"), F.col(code).alias("_q"))
    c = corpus.where(F.col(code).isNotNull()).select(F.col(key).alias("_k"), F.col(code).alias("_c"), F.col(key).alias("_not"))
    found = _fewest_bits(q, c, best, block).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "match"))), 1, best).alias("_b"))
    return found.select("query", F.posexplode("_b").alias("place", "_f")).select("query", "place", "_f.match", "_f.distance")


def nearest_codes(queries: DataFrame, corpus: DataFrame, key: str, code: str, within: int | None = None, block: int = 100_000) -> DataFrame:
    """Per query the corpus row with the fewest differing bits, the smallest key of equals."""
    out = compared(queries, corpus, key, code, 1, block).drop("place")
    return out if within is None else out.where(F.col("distance") <= within)


def _near_blocks(code: str, edges: Sequence[int], flips: Sequence[int]) -> Column:
    """Array of (i, v): every block of the code with every choice of so many of its bits turned round."""

    def turned(i: int, lo: int, hi: int) -> Column:
        part = F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        masks = ",".join(str(sum(1 << b for b in some)) for n in flips for some in combinations(range(hi - lo), n))
        masks = F.split(F.lit(masks), ",").cast("array<bigint>")  # one literal once it is folded
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("i"), part.bitwiseXOR(m).alias("v")))

    return F.flatten(F.array(*[turned(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]))


def nearest_by_radius(queries: DataFrame, corpus: DataFrame, key: str, code: str, bits: int = 64, within: int | None = None, share: float = 0.001, block: int = 100_000) -> DataFrame:
    """query, match, distance: for every query the other corpus row with the fewest differing bits, the smallest key of equals.

    Exact, and without comparing all pairs.  Codes are cut into m blocks of about
    as many bits as it takes to number them.  If two codes differ in less than
    m (s + 1) bits, some block differs in s at most, so after the blocks that
    differ in up to 1, 2 .. s bits have been looked up, a best match at less than
    m (s + 1) is final and its query is done; only the others go on to s + 1.
    Half of the s bits are turned round on either side, which keeps both small.
    With ``within`` the search ends there, and queries without such a match have no row.
    When the blocks that the next step turns round and the pairs that would meet are more than
    ``share`` of all pairs, the codes still open are compared with all others, in blocks of
    ``block``: a row that is shuffled and joined costs about as much as a thousand compared in place.

    Equal codes are searched once.  A key has one code; null codes match nothing.
    """
    q = queries.where(F.col(code).isNotNull()).select(F.col(key).alias("query"), F.col(code).alias("_q"))
    c = corpus.where(F.col(code).isNotNull()).select(F.col(key).alias("_k"), F.col(code).alias("_h"))
    q, c = cut(q), cut(c)
    first = c.groupBy("_h").agg(F.min("_k").alias("_k1"), F.max("_k").alias("_max"))
    # a row whose code others have too matches the smallest of them, which for the smallest itself is the second
    second = c.join(first.where("_max <> _k1").select(F.col("_h"), "_k1"), "_h").where("_k <> _k1").groupBy("_h").agg(F.min("_k").alias("_k2"))
    codes = cut(first.drop("_max").join(second, "_h", "left"))
    equal = q.join(codes.withColumnRenamed("_h", "_q"), "_q", "left")
    equal = cut(equal.select("query", "_q", F.when(F.col("_k1") != F.col("query"), F.col("_k1")).otherwise(F.col("_k2")).alias("match")))
    out = equal.where("match is not null").select("query", "match", F.lit(0).alias("distance"))
    waiting = equal.where("match is null").select("query", "_q")
    none = F.lit(None).cast(f"struct<distance:int,match:{dict(codes.dtypes)['_k1']}>")
    state, count = cut(waiting.select("_q").distinct().withColumn("_b", none)), codes.count()
    blocks = max(2, bits // max(16, (max(count, 2) - 1).bit_length()))
    edges = [bits * i // blocks for i in range(blocks + 1)]
    widest = max(hi - lo for lo, hi in zip(edges, edges[1:], strict=False))
    found = F.min(F.struct(hamming(F.col("_q"), F.col("_h")).alias("distance"), F.col("_k1").alias("match"))).alias("_b")
    answers = None
    # blocks that are equal or differ in one bit are looked up together
    for s in range(1, widest + 1):
        open_ = state.select("_q")
        if state.isEmpty():
            break
        # a pair whose block differs in s bits meets under every choice of the half that is turned round
        left = open_.count()
        turned = blocks * (math.comb(widest, s - s // 2) * left + math.comb(widest, s // 2) * count)
        if turned + blocks * math.comb(widest, s) * math.comb(s, s // 2) / 2**widest * left * count > share * left * count:
            if count < 2:
                break
            met = _fewest_bits(open_.select(F.col("_q").alias("query"), "_q"), codes.select(F.col("_k1").alias("_k"), F.col("_h").alias("_c"), F.col("_h").alias("_not")), 1, block)
            made = met.groupBy(F.col("query").alias("_q")).agg(F.min(F.struct("distance", "match")).alias("_b"))
            answers = made if answers is None else answers.unionByName(made)
            break
        probes = open_.select("_q", F.inline(_near_blocks("_q", edges, [0, 1] if s == 1 else [s - s // 2])))
        index = codes.select("_h", "_k1", F.inline(_near_blocks("_h", edges, [s // 2])))
        pairs = probes.join(index, ["i", "v"]).where("_q <> _h")
        # what lies farther than asked for need not be gathered
        pairs = pairs if within is None else pairs.where(hamming(F.col("_q"), F.col("_h")) <= within)
        seen = pairs.groupBy("_q").agg(found)
        state = cut(state.unionByName(seen).groupBy("_q").agg(F.min("_b").alias("_b")))
        final = F.coalesce(F.col("_b.distance") < blocks * (s + 1), F.lit(False))
        answers = state.where(final) if answers is None else answers.unionByName(state.where(final))
        if within is not None and blocks * (s + 1) > within:
            break
        state = state.where(~final)
    if answers is not None:
        out = out.unionByName(waiting.join(answers, "_q").select("query", "_b.match", "_b.distance"))
    return out if within is None else out.where(F.col("distance") <= within)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable, of edges (a, b).

    Labels go along edges and jump to their label's label, so chains halve; each
    round ends in a checkpoint, and the loop ends when no label changed.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_m"))
        moved = labels.join(seen, "node").select("node", "component", F.least("component", "_m").alias("_m"))
        up = labels.select(F.col("node").alias("_m"), F.col("component").alias("_up"))
        after = cut(moved.join(up, "_m", "left").select("node", F.least("_m", F.coalesce("_up", F.col("_m"))).alias("_new"), "component"))
        changed = not after.where("_new <> component").isEmpty()
        labels = after.select("node", F.col("_new").alias("component"))
        if not changed:
            return labels


def merge_groups(members: DataFrame, labels: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """Replace the group of each member by the smallest group of its component; members without one keep theirs.

    The smallest group of a component is an aggregate over the labelled members
    and goes back to their keys, so members without a component, most of them, are never dealt by it.
    """
    placed = members.select(F.col(key), F.struct(*group).alias("_g")).join(labels.withColumnRenamed("node", key), key)
    least = placed.groupBy("component").agg(F.min("_g").alias("_least"))
    named = labels.withColumnRenamed("node", key).join(least, "component").select(key, "_least")
    merged = members.join(named, key, "left").withColumn("_g", F.coalesce("_least", F.struct(*group)))
    return merged.select(*[c for c in members.columns if c not in group], *[F.col(f"_g.{g}").alias(g) for g in group])


def holding(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, run: int = 5, small: int = 10_000) -> DataFrame:
    """Keys of the documents that contain the text of an item, each once.

    An item's inner words stand whole in a document that contains it, so a run
    of up to ``run`` of them (its anchor) is sought among the document's runs by
    hash, and what is found is compared with ``contains``.  Items without an
    inner word have no anchor; they are broadcast in blocks of about ``small`` and compared with each document.
    """
    known = items.where(F.col(item).isNotNull()).select(F.col(item).alias("_item")).distinct()
    known = cut(known.select("_item", *[c.alias(n) for c, n in ((F.size(inner_of("_item", run)), "_m"), (F.xxhash64(inner_of("_item", run)), "_h"))]))
    sizes = sorted(r["_m"] for r in known.where("_m > 0").select("_m").distinct().collect())
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    listed = own.withColumn("_w", F.filter(F.split("_text", r"\s+"), lambda w: w != ""))

    def runs_of(m: int) -> Column:
        at = F.sequence(F.lit(1), F.size("_w") - (m - 1))
        made = F.transform(at, lambda i: F.struct(F.lit(m).alias("_m"), F.xxhash64(F.slice("_w", i, m)).alias("_h")))
        return F.when(F.size("_w") >= m, made).otherwise(F.array().cast("array<struct<_m:int,_h:bigint>>"))

    runs = [runs_of(m) for m in sizes]
    found = docs.select(F.col(key)).limit(0)
    if runs:
        places = listed.select("_key", F.explode(F.flatten(F.array(*runs))).alias("_r")).select("_key", "_r.*")
        anchors = known.where("_m > 0").select("_m", "_h")
        few = anchors.limit(small + 1).count() <= small
        likely = places.join(F.broadcast(anchors.distinct()) if few else anchors.distinct(), ["_m", "_h"]).distinct()
        pairs = likely.join(known, ["_m", "_h"]).join(own, "_key")
        found = found.union(pairs.where(F.col("_text").contains(F.col("_item"))).select("_key"))
    bare = known.where("_m = 0").select("_item")
    blocks = -(-bare.count() // small)
    for n in range(blocks):
        some = bare.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == n)
        found = found.union(own.join(F.broadcast(some), F.col("_text").contains(F.col("_item")), "left_semi").select("_key"))
    return found.distinct()


def inner_of(item: str, run: int) -> Column:
    """The first ``run`` words of a text but its first and last, which may be parts of words."""
    words = F.filter(F.split(F.col(item), r"\s+"), lambda w: w != "")
    return F.slice(words, F.lit(2), F.least(F.lit(run), F.greatest(F.size(words) - 2, F.lit(0))))
