"""Hard negatives by inner product, found with a table of distances to pivots.

Vectors get one more component, so that all have the same length M; the inner
product with a query is then (M² + |q|² - d²) / 2 of a Euclidean distance d.
The distance of every row to each pivot is stored beside it.  By the triangle
inequality the distances of row and query to one pivot bound d from both sides,
so each pivot brackets the score; only rows whose bracket reaches what is still
wanted have their score computed, exactly.

Rows lie in blocks of neighbours around a pivot, and a block whose intervals
rule it out is skipped whole.  The queries (anchors) are read in parts of bounded
size; every part is held against all blocks, and each task keeps only the best
few rows per anchor.  No rows are paired by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm._common import discard, shared_dir, stored

#: Rows of a block, and rows that are put in order together before they are cut into blocks.
BLOCK_ROWS, GATHERED_ROWS = 1024, 16384
#: Above this the products of whole numbers are not exact in doubles; Python's integers take over.
EXACT = float(1 << 52)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
BLOCK = "id array<bigint>, label array<bigint>, dims int, vectors binary, squares binary, distances binary"


def prepared(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vec) of the rows that take part: label and vector there, every component finite; repeated rows once.

    Rows are grouped by all their values, with a partial aggregate first, so a row that is repeated often meets nobody in bulk.
    """
    vec = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), vec.alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(sound, F.lit(False))).distinct()


def _matrix(arrays, dims: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors have zeros at the end."""
    lengths = np.diff(arrays.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = arrays.flatten().to_numpy()
    return out


def _distances(vectors: np.ndarray, squares: np.ndarray, top: float, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows, made as long as ``top`` by one more component, to pivots that have it already."""
    own = np.sqrt(np.maximum(top - squares, 0.0))
    inner = vectors @ pivots[:, :-1].T + own[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(2 * top - 2 * inner, 0.0)).astype(np.float32)


def choose_pivots(vectors: np.ndarray, top: float, count: int) -> np.ndarray:
    """``count`` of the vectors, each as far as can be from those before it, with their added component."""
    if not len(vectors):
        return np.zeros((0, vectors.shape[1] + 1))
    long = np.hstack([vectors, np.sqrt(np.maximum(top - (vectors**2).sum(1), 0.0))[:, None]])
    chosen, near = [0], np.full(len(long), np.inf)
    while len(chosen) < min(count, len(long)):
        near = np.minimum(near, ((long - long[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(near.argmax()))
    return long[chosen]


def pivot_blocks(rows: DataFrame, pivots: np.ndarray, top: float, dims: int) -> DataFrame:
    """Rows in blocks of neighbours, with their distances to the pivots; rows are not moved between partitions."""
    import pyarrow as pa

    def pack(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHERED_ROWS:
                yield from cut(held)
                held, size = [], 0
        if size:
            yield from cut(held)

    def cut(held: list) -> Iterator:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = _matrix(table["vec"].combine_chunks(), dims)
        squares = (vectors**2).sum(1)
        far = _distances(vectors, squares, top, pivots)
        ids, label = table["id"], table["label"].to_numpy()
        rank = ids.fill_null(_MOST).to_numpy()
        order = np.lexsort((rank, far.min(1), far.argmin(1))) if far.shape[1] else np.argsort(rank, kind="stable")
        for at in (order[i : i + BLOCK_ROWS] for i in range(0, len(order), BLOCK_ROWS)):
            columns = [
                pa.array([ids.take(pa.array(at)).to_pylist()], pa.list_(pa.int64())), pa.array([label[at].tolist()], pa.list_(pa.int64())), pa.array([dims], pa.int32()),
                *(pa.array([np.ascontiguousarray(x[at]).tobytes()], pa.binary()) for x in (vectors, squares, far)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "dims", "vectors", "squares", "distances"])

    return rows.select("id", "label", "vec").mapInArrow(pack, BLOCK)


class _Block:
    def __init__(self, batch, i: int):
        ids = batch.column("id")[i].values
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.label = batch.column("label")[i].values.to_numpy()
        n = len(self.id)
        self.vectors, self.squares = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in ("vectors", "squares"))
        self.vectors = self.vectors.reshape(n, batch.column("dims")[i].as_py())
        self.far = np.frombuffer(batch.column("distances")[i].as_py(), np.float32).reshape(n, -1)


class _Anchors:
    """A part of the queries: identities, vectors, distances to the pivots, and what scores they still look for."""

    def __init__(self, rows: list, top: float, dims: int, pivots: np.ndarray):
        self.id, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("id", "label"))
        self.vectors = np.zeros((len(rows), dims))
        for i, r in enumerate(rows):
            self.vectors[i, : len(r["vec"])] = r["vec"]
        self.squares = (self.vectors**2).sum(1)
        self.top, self.exact = top, top < EXACT
        # a query has a zero where rows have their added component
        self.far = np.sqrt(np.maximum(top + self.squares[:, None] - 2 * self.vectors @ pivots[:, :-1].T, 0.0)).astype(np.float32)
        #: what rounding can do to a bracket, generously
        self.slack = 1.0 + 1e-5 * (top + self.squares)

    def brackets(self, block: _Block, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the pivots leave possible, for anchors ``of`` and each row."""
        low = np.zeros((len(of), len(block.id)), np.float32)
        high = np.full_like(low, np.inf)
        for p in range(self.far.shape[1]):
            mine, its = self.far[of, p][:, None], block.far[:, p]
            np.maximum(low, np.abs(mine - its), out=low)
            np.minimum(high, mine + its, out=high)
        both, slack = (self.top + self.squares[of])[:, None], self.slack[of][:, None]
        return (both - np.square(high, dtype=np.float64)) / 2 - slack, (both - np.square(low, dtype=np.float64)) / 2 + slack

    def reachable(self, block: _Block, wanted: np.ndarray) -> np.ndarray:
        """Anchors for which some row of the block may score ``wanted`` or more, by the block's intervals alone."""
        if not self.exact or not self.far.shape[1] or not len(block.id):
            return np.arange(len(self.id))
        low = np.maximum(np.maximum(block.far.min(0) - self.far, self.far - block.far.max(0)), 0.0).max(1).astype(np.float64)
        return np.flatnonzero((self.top + self.squares - low**2) / 2 + self.slack >= wanted)

    def scores(self, block: _Block, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(self.vectors[of] @ block.vectors[rows].T).astype(np.int64)
        whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
        return np.clip(whole(self.vectors[of]) @ whole(block.vectors[rows]).T, _LEAST, _MOST).astype(np.int64)

    def is_self(self, block: _Block, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors' own rows."""
        order = np.argsort(self.id[of], kind="stable")
        ids = self.id[of][order]
        first, last = np.searchsorted(ids, block.id, "left"), np.searchsorted(ids, block.id, "right")
        pairs = [(order[k], r) for r in np.flatnonzero((last > first) & ~block.no_id) for k in range(first[r], last[r])]
        pairs = [(a, r) for a, r in pairs if self.label[of[a]] == block.label[r] and np.array_equal(self.vectors[of[a]], block.vectors[r])]
        return tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


class _Best:
    """The best ``k`` rows of each slot: higher scores first, then smaller ids, those without an id last."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.no_id, self.id = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        self.floor = np.full(slots, _LEAST, np.int64)

    def add(self, slot, score, no_id, key) -> None:
        slot, score, no_id, key = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.no_id, no_id), (self.id, key)))
        order = np.lexsort((key, no_id, ~score, slot))
        slot = slot[order]
        start = np.flatnonzero(np.concatenate([[True], np.diff(slot) > 0])) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        keep = order[place < self.k]
        self.slot, self.score, self.no_id, self.id = slot[place < self.k], score[keep], no_id[keep], key[keep]
        full = place == self.k - 1
        self.floor[slot[full]] = score[order[full]]

    def batch(self, names: list[str], **more):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(self.slot), pa.array(self.score), pa.array(self.id, mask=self.no_id)], names=names)


def _sought(blocks: DataFrame, slots: int, k: int, search) -> DataFrame:
    """The best ``k`` (slot, score, id) over all blocks; each task sends its own best only."""

    def run(batches: Iterator) -> Iterator:
        best = _Best(slots, k)
        for batch in batches:
            for i in range(batch.num_rows):
                search(best, _Block(batch, i))
        yield best.batch(["slot", "score", "id"])

    found = blocks.mapInArrow(run, "slot bigint, score bigint, id bigint")
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(blocks: DataFrame, anchors: _Anchors, count: int) -> DataFrame:
    """(slot, score, id, rank): the best ``count`` other rows of each anchor's label; the slot is the anchor's number."""

    def search(best: _Best, block: _Block) -> None:
        of = anchors.reachable(block, best.floor)
        of = of[np.isin(anchors.label[of], block.label)]
        if not len(of):
            return
        open_ = anchors.label[of][:, None] == block.label
        if anchors.exact:
            open_ &= anchors.brackets(block, of)[1] >= best.floor[of][:, None]
        open_[anchors.is_self(block, of)] = False
        take(best, block, of, open_, anchors.scores, lambda score: score >= best.floor[of][:, None])

    return _sought(blocks, len(anchors.id), count, search)


def take(best: _Best, block: _Block, of: np.ndarray, open_: np.ndarray, scores, wanted) -> None:
    """Exact scores of the survivors, and the wanted ones of them into ``best``."""
    rows = np.flatnonzero(open_.any(0))
    if not len(rows):
        return
    exact = scores(block, of, rows)
    a, r = np.nonzero(open_[:, rows] & wanted(exact))
    best.add(of[a], exact[a, r], block.no_id[rows[r]], block.id[rows[r]])


def negatives_of(blocks: DataFrame, anchors: _Anchors, positives: list, slots: int, count: int, low: int, high: int) -> DataFrame:
    """(slot, score, id, rank): the best ``count`` rows of other labels for each positive; slot = anchor * slots + its rank - 1.

    ``low`` and ``high`` are the least and greatest share of the positive's score, in percent.
    """
    n = len(anchors.id)
    least, most = np.full((n, slots), _MOST, np.int64), np.full((n, slots), _LEAST, np.int64)
    for r in positives:
        at = r["slot"], r["rank"] - 1
        least[at] = min(max(-((-low * r["score"]) // 100), _LEAST), _MOST)
        most[at] = min(max((high * r["score"]) // 100, _LEAST), _MOST)

    def search(best: _Best, block: _Block) -> None:
        floor = np.where(least > most, _MOST, np.maximum(best.floor.reshape(n, slots), least))
        lowest, highest = floor.min(1), np.where(least > most, _LEAST, most).max(1)
        of = anchors.reachable(block, lowest)
        of = of[lowest[of] < _MOST]
        if not len(of):
            return
        open_ = anchors.label[of][:, None] != block.label
        if anchors.exact:
            down, up = anchors.brackets(block, of)
            open_ &= (up >= lowest[of][:, None]) & (down <= highest[of][:, None])
        rows = np.flatnonzero(open_.any(0))
        if not len(rows):
            return
        exact, open_ = anchors.scores(block, of, rows), open_[:, rows]
        found = []
        for j in range(slots):
            a, r = np.nonzero(open_ & (exact >= floor[of, j][:, None]) & (exact <= most[of, j][:, None]))
            found.append((of[a] * slots + j, exact[a, r], block.no_id[rows[r]], block.id[rows[r]]))
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return _sought(blocks, n * slots, count, search)


def mine(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    pivots: int = 16,
    pivot_sample: int = 2048,
    anchors_a_part: int = 2048,
) -> DataFrame:
    """For each anchor and each of its best ``positives``: up to ``negatives`` rows of other labels that score between
    ``low`` and ``high`` percent of the positive, as (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are whole numbers, so scores are; those beyond a long count as its ends.  ``anchor`` is a
    condition on the column ``id``.  Higher scores come first, ties by smaller keys, rows without a key last; such rows
    are never anchors.  Rows without label or vector, or with a component that is null or not
    finite, take no part.  A vector that is shorter than others has zeros at its end; an empty one scores 0 with all.
    Rows equal in key, label and vector count once; rows that share only the key are different rows, and
    each may be an anchor, a positive or a negative.  Other columns are not looked at, whatever their names;
    an empty table gives an empty one.

    The pivots are chosen from ``pivot_sample`` rows by a hash; they decide how much work is spared, never what is
    found.  The work grows with anchors times blocks that the intervals do not rule out.  What reaches the driver at a
    time is a part of the anchors (about ``anchors_a_part``) with its positives.
    """
    spark = df.sparkSession
    rows = stored(prepared(df, key, vector, label), "negatives-rows")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.max(square).alias("top"), F.max(F.size("vec")).alias("dims"), F.count(F.when(anchor, 1)).alias("anchors")).first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not facts["anchors"]:
        discard(rows)
        return spark.createDataFrame([], result)
    top, dims = float(facts["top"]), max(facts["dims"], 1)
    exact = top < EXACT
    sample = rows.orderBy(F.xxhash64("id", "label", "vec"), "id").limit(pivot_sample).select("vec").toArrow()["vec"].combine_chunks()
    some = choose_pivots(_matrix(sample, dims), top, pivots) if exact else np.zeros((0, dims + 1))
    blocks = stored(pivot_blocks(rows, some, top if exact else 0.0, dims), "negatives-blocks")
    parts = -(-facts["anchors"] // anchors_a_part)
    whose = F.pmod(F.xxhash64("id", "label", "vec"), F.lit(parts))
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-negatives-{uuid.uuid4().hex}"
    for part in range(parts):
        # bounded: an even share of the anchors by a hash of distinct rows
        some_rows = rows.where(anchor & (whose == part)).collect()
        if not some_rows and part:
            continue
        anchors = _Anchors(some_rows, top if exact else EXACT, dims, some)
        good = positives_of(blocks, anchors, positives).collect()
        found = negatives_of(blocks, anchors, good, positives, negatives, low, high)
        known = spark.createDataFrame(
            [(r["slot"] * positives + r["rank"] - 1, int(anchors.id[r["slot"]]), r["id"], r["score"]) for r in good],
            "slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
        )
        # a row per anchor and positive of this part
        found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(known), "slot").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        ).write.parquet(f"{path}/part={part}")
    discard(rows, blocks)
    return spark.read.schema(result + ", part int").parquet(path).drop("part")
