"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Under every permutation both the smallest and the largest value of a document's
shingles are kept, so half the hash evaluations give the same number of
signature values; either value of two documents agrees with the probability of
their Jaccard similarity.  Bands of values propose pairs in two steps:

1. In every bucket each document is paired with the smallest one.  Pairs that
   the full sets confirm are joined to components.
2. In buckets that still hold several components, documents outside the
   component of the bucket's smallest one are compared with all others of
   another component, block by block, and again confirmed on the full sets.

So no link that the bands propose is lost unless it lies inside a component
that is joined already, and the pairs of a large group are never emitted.
Documents with equal shingle sets are one node from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm._common import free_names, own, split_join, stored
from kerbside.llm._components import connected_components

#: 80 permutations give 160 values, 32 bands of 5: at a similarity of 0.8 a pair is missed 3 times in a million.
PERMUTATIONS, BAND_ROWS, SEED = 80, 5, 20240229
#: Pairs whose signatures agree in fewer values are not looked at; over five standard deviations below 0.8.
LEAST_AGREEMENT = 0.62
#: Shingles that one block of a bucket holds, about.
BLOCK_SHINGLES = 400_000


def node_id(key: Column, text: Column) -> Column:
    """The key as a long; rows without a key get a number of 2**62 or more from their text, so that any usual key is smaller."""
    return F.coalesce(key.cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2))


def _whole_key(df: DataFrame, key: str) -> None:
    kind = df.select(F.col(key)).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"the key {key!r} must be an integer column, not {kind.simpleString()}")


def signatures(sets: list, permutations: int = PERMUTATIONS, seed: int = SEED):
    """Values of non-empty hash arrays: column 2i the minimum and 2i+1 the maximum under permutation i."""
    import numpy as np

    from kerbside.llm._shingles import permutations as draw

    a, b = (x[:, 0] for x in draw(permutations, seed))
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(permutations if sets else 0):
        v = ((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * i] = np.minimum.reduceat(v, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(v, starts)
    return out


def band_keys(values, rows: int = BAND_ROWS):
    """One 64-bit key per document and band."""
    import numpy as np

    from kerbside.llm._shingles import mixed

    bands = values.shape[1] // rows
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(values), bands)).copy()
    part = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    for j in range(rows):
        h = mixed((h ^ part[:, :, j]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, text, keyed) to (node, keyed, n, set_key, bands, signature); the last three are null for empty sets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from kerbside.llm._shingles import shingles, word_hashes

        def sign(raw: list):
            keys, bands, sigs = [], [], []
            some = [h for h in raw if len(h)]
            values = signatures(some)
            made = iter(zip(band_keys(values), values.astype(np.uint8), strict=True)) if some else iter(())
            sizes = []
            for h in raw:
                own = np.unique(h)
                sizes.append(len(own))
                if len(own):
                    band, sig = next(made)
                    keys.append(hashlib.md5(own.tobytes()).digest())
                    bands.append(band)
                    sigs.append(sig.tobytes())
                else:
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
            return sizes, keys, bands, sigs

        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at, raw, held = 0, [], 0
            for i, value in enumerate(texts):
                raw.append(shingles(word_hashes(value.as_py()), shingle))
                held += len(raw[-1])
                if held > 200_000 or i == len(texts) - 1:
                    sizes, keys, bands, sigs = sign(raw)
                    yield pa.RecordBatch.from_arrays(
                        [nodes[at : i + 1], batch.column(2)[at : i + 1], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                        names=["node", "keyed", "n", "set_key", "bands", "signature"],
                    )
                    at, raw, held = i + 1, [], 0

    return rows.mapInArrow(run, "node bigint, keyed boolean, n bigint, set_key binary, bands array<bigint>, signature binary")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, text) to (node, shingles): the sorted set as bytes of 64-bit numbers."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from kerbside.llm._shingles import shingles, word_hashes

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made, at, held = [], 0, 0
            for i, value in enumerate(texts):
                made.append(np.unique(shingles(word_hashes(value.as_py()), shingle)).tobytes())
                held += len(made[-1])
                if held > 16_000_000 or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : i + 1], pa.array(made, pa.binary())], names=["node", "shingles"])
                    made, at, held = [], i + 1, 0

    return rows.mapInArrow(run, "node bigint, shingles binary")


def _similar(x, y, percent: int) -> bool:
    """Whether two sorted arrays of distinct numbers have at least this Jaccard percentage."""
    import numpy as np

    n = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n - shared)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept, and ``_node``.

    ``key`` is an integer column of any width, negative numbers too; another
    type is a TypeError.  Texts are compared by their sets of distinct
    ``shingle``-word runs (A-Z in lower case); two are linked if
    100 * intersection >= ``percent`` * union.  component_id is the smallest key
    reachable by links.  A null, empty or wordless text has no shingle and no
    link.  Rows with equal keys are one document for the links, each with the
    ``n_shingles`` of its own text.  Rows without a key keep a null key; they
    stand as a number of 2**62 or more made from their text, which is their
    component_id where nothing smaller is linked, and ``kept`` tells whether
    that number is theirs.  Texts of any length are read whole.  Other columns
    are ignored, whatever their names; an empty table gives an empty table.
    """
    _whole_key(df, key)
    docs = df.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select(node_id(F.col(key), F.col("text")).alias("node"), "text", F.col(key).isNotNull().alias("keyed"))
    base = stored(_signed(docs, shingle), "signatures")
    full_sets = base.where("n > 0")
    classes = stored(full_sets.groupBy("set_key").agg(F.min("node").alias("class_id"), F.count("*").alias("_rows")), "classes")
    # one row per class of equal sets
    leaders = classes.select(F.col("set_key").alias("k"), "class_id")
    firsts = full_sets.join(leaders, (F.col("set_key") == F.col("k")) & (F.col("node") == F.col("class_id")), "left_semi").drop("keyed")
    firsts = stored(firsts.dropDuplicates(["node", "set_key"]), "firsts")
    entries = firsts.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("_rows"))
    shared = stored(shared.where("lo < hi").select("band", "lo", "_rows"), "bands")
    buckets = stored(split_join(entries, shared, "band").select("band", "node", "lo"), "buckets")

    facts = firsts.select("node", "n", "signature")
    stars = stored(buckets.where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    pairs = stored(_agreeing(stars, facts, percent), "pairs")
    involved = buckets.select("node").distinct()
    sets = stored(_sets(docs.join(involved, "node", "left_semi").select("node", "text"), shingle), "sets")
    first = stored(_confirmed(pairs, sets, percent), "links")
    labels = connected_components(first)
    rest = stored(_remaining(buckets, labels, firsts.select("node", "n", "bands", "signature"), sets, percent), "more-links")
    if not rest.isEmpty():
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))
    # components are attached to classes, which are evenly dealt, and classes to rows, where the large ones are broadcast
    named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = stored(named.select("set_key", F.coalesce("component", "class_id").alias("component_id"), "_rows"), "named-classes")
    rows = full_sets.select("node", "keyed", "n", "set_key")
    none = base.where("n = 0").select("node", "keyed", "n", F.col("node").alias("component_id"))
    placed = split_join(rows, named, "set_key").drop("set_key").unionByName(none)
    return placed.select(
        F.when(F.col("keyed"), F.col("node")).cast(df.select(F.col(key)).schema[0].dataType).alias(key), F.col("n").alias("n_shingles"), "component_id",
        (F.col("node") == F.col("component_id")).alias("kept"), F.col("node").alias("_node"),
    )


def _agreeing(stars: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""

    @F.pandas_udf("boolean")
    def agree(x, y):
        import numpy as np
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=bool)
        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((left == right).mean(1) >= LEAST_AGREEMENT)

    of = lambda s: facts.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("signature").alias(f"s{s}"))
    # a node is b in as many stars as there are bands at most, but a in as many as there are other nodes
    weighed = stored(stars.groupBy("a").agg(F.count("*").alias("_rows")).join(of("a"), "a"), "hubs")
    both = split_join(stars, weighed, "a").join(of("b"), "b")
    return both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(agree("sa", "sb")).select("a", "b", "nb")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with nb shingles of b, that are similar by their full sets.

    A node a whose partners hold more than BLOCK_SHINGLES is a hub: its partners
    are dealt to parts of about that size, and each part gets its set once.
    """

    @F.pandas_udf("boolean")
    def similar(x, y):
        import numpy as np
        import pandas as pd

        return pd.Series([_similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)], dtype=bool)

    def against(hub, part):
        import numpy as np

        own = [np.frombuffer(x, np.uint64) for x in hub["sa"]]  # one, but for a key that stands with several texts
        return part.loc[[any(_similar(x, np.frombuffer(y, np.uint64), percent) for x in own) for y in part["sb"]], ["a", "b"]]

    of = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"))
    load = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / F.lit(BLOCK_SHINGLES)).cast("int").alias("parts"), F.count("*").alias("_rows"))
    load = stored(load, "hub-loads")
    dealt = split_join(pairs.select("a", "b"), load, "a")
    few = dealt.where("parts <= 1").select("a", "b").join(of("b"), "b").join(of("a"), "a").where(similar("sa", "sb")).select("a", "b")
    many = dealt.where("parts > 1").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b").join(of("b"), "b")
    hubs = load.where("parts > 1").select("a", "parts").join(of("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "sa")
    found = hubs.groupBy("a", "part").cogroup(many.groupBy("a", "part")).applyInPandas(against, "a bigint, b bigint")
    return few.unionByName(found).distinct()


def _remaining(buckets: DataFrame, labels: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components in buckets that hold several."""
    named = stored(buckets.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "named-buckets")
    mixed = named.groupBy("band").agg(F.min("component").alias("main"), F.max("component").alias("_hi"), F.count("*").alias("_rows")).where("main < _hi")
    own = stored(split_join(named, stored(mixed.select("band", "main", "_rows"), "mixed-bands"), "band"), "mixed-buckets")
    # blocks of about equal numbers of shingles; every two blocks of a bucket meet once.  They are dealt as numbers
    # alone; what is compared is attached to them after that.
    sized = stored(own.join(facts.select("node", "n"), "node"), "sized-buckets")
    load = sized.groupBy("band").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("_rows"))
    dealt = (
        split_join(sized, stored(load, "bucket-loads"), "band")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "main")
    )
    dealt = dealt.join(facts.drop("n").join(sets, "node"), "node")

    def compare(pdf):
        import numpy as np
        import pandas as pd

        found: list[tuple[int, int]] = []
        band, i, j = int(pdf["band"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        node, comp, block = (pdf[c].to_numpy() for c in ("node", "component", "block"))
        apart = comp != pdf["main"].to_numpy()
        if not apart.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), -1)
        keys = np.stack([np.asarray(x, np.int64) for x in pdf["bands"]])
        at = int((keys[0] == band).argmax())
        full = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        size = np.array([len(x) for x in full])
        label = {}

        def root(c: int) -> int:
            while label.get(c, c) != c:
                c = label[c]
            return c

        for f in np.flatnonzero(apart):
            ok = (comp != comp[f]) & (100 * np.minimum(size, size[f]) >= percent * np.maximum(size, size[f]))
            ok &= ~apart | (node > node[f])  # two outsiders meet once
            if i != j:
                ok &= block != block[f]
            some = np.flatnonzero(ok)
            # a pair that shares an earlier band is seen there
            some = some[~(keys[some, :at] == keys[f, :at]).any(1)] if at else some
            some = some[(sig[some] == sig[f]).mean(1) >= LEAST_AGREEMENT]
            for m in some:
                if root(int(comp[f])) != root(int(comp[m])) and _similar(full[f], full[m], percent):
                    found.append((int(node[f]), int(node[m])))
                    x, y = root(int(comp[f])), root(int(comp[m]))
                    label[max(x, y)] = min(x, y)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("band", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, all columns, that stay: one row of each component.

    That is the row with the smallest key; of several rows with this key one
    stays, of the text with the smallest hash.  Rows without shingles (null,
    empty, wordless) stay, one per key; rows without a key stay once per text.
    """
    node, mark = free_names(df, "_kept_node", "_kept_mark")
    kept = near_duplicates(df, key, text, shingle, percent).where("kept").select(F.col("_node").alias(node)).distinct()
    columns = own(df)
    # the text's hash comes first, so that a projection before the join may drop no text
    marked = df.select(*columns, node_id(F.col(key), F.col(text)).alias(node), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(mark))
    least = marked.join(kept, node, "left_semi").groupBy(node).agg(F.min(mark).alias(mark))
    return marked.join(least, [node, mark], "left_semi").dropDuplicates([node, mark]).select(*columns)
