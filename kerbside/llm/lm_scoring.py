"""Masked pseudo-likelihood of documents under a window network in numpy.

The network sees the two words on either side of a hidden word and predicts it.
A document's score is the sum of the log-probabilities of all its words, each
given both sides.

The last layer is a binary tree over words (a Huffman code of their counts in
the whole corpus): a word's probability is the product of the turns on its way
from the root, each a logistic function of the hidden layer.  So the
``WORDS`` most frequent words have outputs of their own, and a word costs as
many products as its code has bits, about a dozen.  All other words go to
``RARE`` leaves by hash, and there a word has its share of the leaf's count in
the corpus; one count more in every such leaf is held for words that the corpus
does not have.  Probabilities of all words sum to one, and before training they
are the corpus's relative frequencies.

Training deals the documents to groups by a hash of key and text, and orders
them by it, so the result does not depend on partitions.  Each group is one
task, which takes steps on every position of its documents.  Groups of one
round start alike; after it, each row of parameters becomes the mean over the
groups that used it, weighed by their uses and summed in the order of groups.
Every group works in one round, so every word of every document is a target once.
The number of groups follows the square root of the number of words: tasks and
the exchange of parameters both grow slower than the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm._common import discard, stored

#: Leaves of single words, at most, and leaves that share all other words.
WORDS, RARE = 1 << 18, 64
#: Most frequent words with an input vector of their own; the others share vectors by hash.
INPUTS, SHARED = 1 << 14, 1 << 10
OFFSETS = (-2, -1, 1, 2)
#: Nodes nearest to the root by weight, whose odds are taken as one matrix product.
UPPER = 64
WIDTH, HIDDEN = 16, 16
#: Hidden values that the nodes beyond the upper ones see, the last of all.
NARROW = 8
#: Positions of a training step, about.
BATCH = 4096
#: Words a group would have if the corpus were one group.
GROUP_WORDS = 200_000
#: Rows of parameters that travel together.
BLOCK = 2048
RATE = 0.2
#: Spark's seed of xxhash64, so that both sides give a word the same hash.
HASH_SEED = 42


def huffman(weights):
    """Code of leaves with the given positive weights, largest first: (at, nodes, right, bias).

    The way to leaf i is nodes[at[i] : at[i + 1]], from the root (node 0) down;
    ``right`` tells which turn it takes, and ``bias`` has for each node the log
    odds of a right turn by the weights.
    """
    import numpy as np

    n = len(weights)
    weight = np.concatenate([np.asarray(weights, float)[::-1], np.zeros(max(n - 1, 0))]).tolist()  # leaves, smallest first, then inner nodes
    parent, leaf, inner = [0] * len(weight), 0, n
    for made in range(n, len(weight)):
        for _ in range(2):
            # of equals the leaf goes first
            if inner >= made or (leaf < n and weight[leaf] <= weight[inner]):
                child, leaf = leaf, leaf + 1
            else:
                child, inner = inner, inner + 1
            parent[child] = made
            weight[made] += weight[child]
    parent, weight = np.array(parent), np.array(weight)
    root = len(weight) - 1
    second = np.zeros(len(weight), bool)  # of two siblings, the one made later turns right
    order = np.lexsort((np.arange(root), parent[:root]))
    second[order[1::2]] = True
    bias = np.log(weight[order[1::2]] / weight[order[::2]])[::-1] if n > 1 else np.zeros(0)
    now, ways, turns = np.arange(n), [], []
    while (now < root).any():
        up = now < root
        ways.append(np.where(up, root - parent[now], -1))
        turns.append(second[now])
        now = np.where(up, parent[now], root)
    ways = np.array(ways[::-1]).reshape(-1, n).T[::-1]  # one line per leaf, root first
    turns = np.array(turns[::-1]).reshape(-1, n).T[::-1]
    real = ways >= 0
    at = np.concatenate([[0], np.cumsum(real.sum(1))])
    return at, ways[real].astype(np.int32), turns[real], bias.astype(np.float32)


@dataclass(frozen=True)
class Vocabulary:
    """words: those with leaves of their own, most frequent first, and their counts; totals: counts of the rare leaves."""

    words: list
    counts: object
    totals: tuple
    #: Words of the corpus, and distinct ones without a leaf of their own.
    size: int = 0
    others: int = 0

    def tables(self) -> dict:
        """Arrays that say all about word numbers: ``inputs``, the input vector of each, the edge of a text as the last; ``start``,
        ``upper`` and ``size``, where in ``turns`` the way to its leaf begins, its nodes near the root, and all of them;
        ``turns``, nodes times two, one more for a turn to the right; ``bias`` by node."""
        import numpy as np
        from xxhash import xxh64_intdigest

        shared = [INPUTS + xxh64_intdigest(w, HASH_SEED) % SHARED for w in self.words[INPUTS:]]
        inputs = np.concatenate([np.arange(min(INPUTS, len(self.words))), shared, INPUTS + SHARED + np.arange(RARE + 1)]).astype(np.int32)
        weights = np.concatenate([self.counts, np.array(self.totals) + 1])
        order = np.argsort(-weights, kind="stable")
        at, nodes, right, bias = huffman(weights[order])
        # nodes are numbered from the heaviest on, so on every way the upper ones come first
        upper = np.add.reduceat((nodes < UPPER).astype(np.int64), at[:-1]) if len(nodes) else np.zeros(len(order), np.int64)
        out = {"inputs": inputs, "bias": bias, "turns": nodes * 2 + right.astype(np.int32)}
        for name, by_weight in (("start", at[:-1]), ("size", np.diff(at)), ("upper", upper)):
            out[name] = np.empty(len(order), np.int64)
            out[name][order] = by_weight
        return out


def numbers(words: list, known: dict):
    """Numbers of words (bytes in lower case), and the hashes of those in rare leaves, 0 for the others."""
    import numpy as np
    from xxhash import xxh64_intdigest

    out, h = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words)), np.zeros(len(words), np.uint64)
    new = np.flatnonzero(out < 0)
    h[new] = np.array([xxh64_intdigest(words[i], HASH_SEED) for i in new], np.uint64)
    out[new] = len(known) + (h[new] % np.uint64(RARE)).astype(np.int32)
    return out, h


def first_values(bias, seed: int) -> dict:
    """Parameters before training: rows of input vectors, the first layer (its last row the offsets), and the tree near the root and beyond (the last columns are the offsets)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    tree = lambda b, width: np.hstack([np.zeros((len(b), width)), b[:, None]]).astype(np.float32)
    return {
        "embed": (rng.standard_normal((INPUTS + SHARED + RARE + 1, WIDTH)) * 0.3).astype(np.float32),
        "layer": np.vstack([rng.standard_normal((len(OFFSETS) * WIDTH, HIDDEN)) * 0.2, np.zeros((1, HIDDEN))]).astype(np.float32),
        "upper": tree(bias[:UPPER], HIDDEN),
        "lower": tree(bias[UPPER:], NARROW),
    }


def longest_first(size):
    """Order of runs by their sizes, longest first."""
    import numpy as np

    return np.argsort(-size.astype(np.int16), kind="stable")  # 16 bits are sorted by digits


def layers(size):
    """How many runs have a first line, a second one and so on; with the longest first, these are the runs in front."""
    import numpy as np

    return (len(size) - np.cumsum(np.bincount(size))[:-1]).tolist()


def sums(rows, begin, size, lines=None, few: int = 24):
    """Sums of runs of lines, none empty; ``lines`` has the places in ``rows`` of the lines if they do not lie in order."""
    import numpy as np

    short = np.minimum(size, few)
    order = longest_first(short)
    first, of = begin.take(order), lambda i: rows.take(i if lines is None else lines.take(i), 0)
    out = of(first)
    for k, end in enumerate(layers(short)[1:], 1):  # most runs are short
        out[:end] += of(first[:end] + k)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out = out.take(back, 0)
    live = np.flatnonzero(size > few)
    if len(live):
        many = size.take(live) - few
        at = np.cumsum(many) - many
        out[live] += np.add.reduceat(of(np.arange(many.sum()) + np.repeat(begin.take(live) + few - at, many)), at)
    return out


def spans(ends: list):
    """Where layers that lie one after the other begin and end, and how many runs they have."""
    return [(b - end, b, end) for b, end in zip(accumulate(ends), ends, strict=True)]


def squashed(z, offsets):
    """Hidden layer of sums of inputs, which are overwritten, with a last column of ones."""
    import numpy as np

    h = np.ones((len(z), HIDDEN + 1), np.float32)
    z += offsets
    h[:, :-1] = np.tanh(z, out=z)
    return h


class Network:
    """The window network on word numbers; ``tables`` from Vocabulary.tables."""

    def __init__(self, tables: dict, values: dict) -> None:
        import numpy as np

        self.tables, self.values = tables, values
        self.beyond = (tables["size"] - tables["upper"]).astype(np.int16)  # turns of each way beyond the upper nodes

    def stream(self, texts: list):
        """Input vectors of texts (word numbers) one after the other, with two edges before, between and after them."""
        import numpy as np

        edge = np.full(2, len(self.tables["inputs"]) - 1, np.int32)
        return self.tables["inputs"].take(np.concatenate([edge, *(x for t in texts for x in (t, edge))]))

    def ways(self, leaves):
        """Places with a leaf (none at -1), those with the most turns beyond the upper nodes first, and their ways, near the root and beyond:
        nodes and turns (1 right, -1 left) of each, then the places of the upper ones.  Of the lower ones all first
        turns come first and so on; with them go the ends of these layers."""
        import numpy as np

        own = np.flatnonzero(leaves >= 0)
        mine = leaves.take(own)
        order = longest_first(self.beyond.take(mine))
        own, mine = own.take(order), mine.take(order)
        start, upper = self.tables["start"].take(mine), self.tables["upper"].take(mine)
        ends, far = layers(self.beyond.take(mine)), start + upper
        near = np.repeat(start - (np.cumsum(upper) - upper), upper)
        near += np.arange(len(near))
        far = np.concatenate([far[:end] + k for k, end in enumerate(ends)] or [far[:0]])
        near, far = (self.tables["turns"].take(flat) for flat in (near, far))
        turn = lambda x: ((x & 1) * 2 - 1).astype(np.float32)
        return own, (near >> 1, turn(near), np.repeat(own, upper)), (far >> 1, turn(far), ends)

    def hidden(self, wide):
        """Inputs and hidden layer of all places of a stream but the two at either end; the layer has a last column of ones."""
        import numpy as np

        layer, n = self.values["layer"], len(wide) - 4
        e = self.values["embed"].take(wide, 0)
        x = np.concatenate([e[2 + o : 2 + o + n] for o in OFFSETS], 1)
        return x, squashed(x @ layer[:-1], layer[-1])

    def odds(self, h, own, upper, lower, parts: list):
        """Log odds of the turns of both parts, the places of the first among all odds, and for the second the hidden values and the nodes beside
        the turns.  ``parts``: places whose upper odds are one matrix product, as its rounding depends on how many there are."""
        import numpy as np

        near, mine = self.values["upper"], h[:, HIDDEN - NARROW :].take(own, 0)
        top = np.empty((len(h), len(near)), np.float32)
        for a, b in parts:
            np.matmul(h[a:b], near.T, out=top[a:b])
        place = upper[2] * len(near)
        place += upper[0]
        theirs = self.values["lower"].take(lower[0] - UPPER, 0)
        met = np.empty_like(theirs)
        for a, b, end in spans(lower[2]):
            np.multiply(theirs[a:b], mine[:end], out=met[a:b])
        low = met[:, 0].copy()
        for j in range(1, NARROW + 1):  # always in this order, whatever the number of turns
            low += met[:, j]
        low *= lower[1]
        return top.ravel().take(place) * upper[1], low, place, mine, theirs

    def costs(self, texts: Iterator, block: int = 4096) -> Iterator:
        """Arrays of one value per word, minus its log-probability, for each text (word numbers) in turn.

        Short texts go together; what a word gets does not depend on the texts beside its own.
        """
        import numpy as np

        # what each input vector adds to the hidden layer from each offset
        layer = self.values["layer"]
        adds = np.concatenate([self.values["embed"] @ layer[j * WIDTH : (j + 1) * WIDTH] for j in range(len(OFFSETS))], 1)
        edge = np.full(2, -1, np.int32)

        def flush():
            wide, leaves = self.stream(held), np.concatenate([x for t in held for x in (t, edge)])[:-2]
            begins = accumulate((len(t) + 2 for t in held[:-1]), initial=0)
            parts = [(a, min(a + block, at + len(t))) for at, t in zip(begins, held, strict=True) for a in range(at, at + len(t), block)]
            out = np.zeros(len(leaves))
            while parts:
                at, run = parts[0][0], 1
                while run < len(parts) and parts[run][1] - at <= block:
                    run += 1
                end = parts[run - 1][1]
                now = adds.take(wide[at : end + 4], 0)
                z = now[: end - at, :HIDDEN].copy()  # of the first offset, -2
                for j, o in enumerate(OFFSETS[1:], 1):
                    z += now[2 + o : 2 + o + end - at, j * HIDDEN : (j + 1) * HIDDEN]
                own, upper, lower = self.ways(leaves[at:end])
                top, low, *_ = self.odds(squashed(z, layer[-1]), own, upper, lower, [(a - at, b - at) for a, b in parts[:run]])
                top, low = (np.log(1 + np.exp(np.minimum(-odds, np.float32(60)))) for odds in (top, low))
                out[at:end] = np.bincount(upper[2], top, end - at)
                deep = np.zeros(len(own))
                for a, b, last in spans(lower[2]):
                    deep[:last] += low[a:b]
                out[at:end][own] += deep
                del parts[:run]
            at = 0
            for t in held:
                yield out[at : at + len(t)]
                at += len(t) + 2

        held, size = [], 0
        for ids in texts:
            held.append(ids)
            size += len(ids) + 2
            if size >= 4 * block:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def log_probabilities(self, ids, block: int = 4096):
        """One value per word number of a text."""
        return -next(self.costs(iter([ids]), block))


class Trainer(Network):
    """Adagrad by rows on mini-batches of positions; counts how often a row of parameters was used."""

    def __init__(self, tables: dict, values: dict, rate: float = RATE) -> None:
        import numpy as np

        super().__init__(tables, {k: v.copy() for k, v in values.items()})
        self.power = {k: np.zeros(len(v), np.float32) for k, v in values.items()}
        self.uses = {k: np.zeros(len(v), np.float32) for k, v in values.items()}
        self.rate = rate

    def _move(self, name: str, rows, uses, grad) -> None:
        import numpy as np

        power = self.power[name].take(rows) + grad**2 @ np.full(grad.shape[1], 1 / grad.shape[1], np.float32)
        self.power[name][rows] = power
        grad *= (np.float32(self.rate) / np.sqrt(power + np.float32(1e-8)))[:, None]
        self.values[name][rows] = self.values[name].take(rows, 0) - grad
        self.uses[name][rows] += uses

    def _gathered(self, name: str, places, grad) -> None:
        """Sum the lines of ``grad`` by the row they belong to, and move those rows."""
        import numpy as np

        packed = np.sort(places.astype(np.int64) << 32 | np.arange(len(places)))
        lines, places = packed & 0xFFFFFFFF, packed >> 32
        begin = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        uses = np.diff(begin, append=len(places))
        self._move(name, places[begin], uses, sums(grad, begin, uses, lines))

    def step(self, wide, leaves) -> None:
        """wide: input vectors of a stream; leaves: the word of each place between its ends of two, -1 at an edge."""
        import numpy as np

        n, layer, near = len(leaves), self.values["layer"], self.values["upper"]
        x, h = self.hidden(wide)
        own, upper, lower = self.ways(leaves)
        top, low, place, mine, theirs = self.odds(h, own, upper, lower, [(0, n)])
        # what is missed of each turn's probability, towards the other side
        missed = [-way[1] / (1 + np.exp(np.clip(odds, -30, 30))) for odds, way in ((top, upper), (low, lower))]
        share = np.zeros(n * len(near), np.float32)
        share[place] = missed[0]
        share = share.reshape(n, len(near))
        back = share @ near[:, :-1]
        uses = np.bincount(upper[0], minlength=len(near))
        used = np.flatnonzero(uses)
        grad = share.T @ h
        if len(low):
            gone = np.repeat(missed[1], theirs.shape[1]).reshape(theirs.shape)
            theirs *= gone
            deep = np.zeros_like(mine)
            for a, b, end in spans(lower[2]):
                deep[:end] += theirs[a:b]
                gone[a:b] *= mine[:end]
            back[own, HIDDEN - NARROW :] += deep[:, :-1]
            self._gathered("lower", lower[0] - UPPER, gone)
        if len(used):
            self._move("upper", used, uses[used], grad.take(used, 0))
        back *= 1 - h[:, :-1] ** 2
        inputs, around = back @ layer[:-1].T, np.zeros((n + 4, WIDTH), np.float32)
        for j, o in enumerate(OFFSETS):
            around[2 + o : 2 + o + n] += inputs[:, j * WIDTH : (j + 1) * WIDTH]
        self._move("layer", np.arange(len(layer)), len(own), np.vstack([x.T @ back, np.ones((1, n), np.float32) @ back]))
        self._gathered("embed", wide, around)

    def learn(self, texts: Iterator) -> None:
        """Steps on every position of every text (word numbers), in their order."""
        import numpy as np

        held, size, edge = [], 0, np.full(2, -1, np.int32)

        def flush() -> None:
            wide, leaves = self.stream(held), np.concatenate([x for t in held for x in (t, edge)])[:-2]
            cuts = np.linspace(0, len(leaves), max(1, round(len(leaves) / BATCH)) + 1).astype(int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.step(wide[a : b + 4], leaves[a:b])
            held.clear()

        for ids in texts:
            if len(ids):
                held.append(ids)
                size += len(ids)
            if size >= BATCH:
                flush()
                size = 0
        if size:
            flush()


def word_bound(texts):
    """At least as many words as each of the texts (an Arrow array of bytes) has."""
    import numpy as np
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // 2 + 1


def numbered(texts):
    """Words of texts (an Arrow array of bytes), A-Z in lower case, as numbers by first use: numbers of all texts, the ends of the texts among them, and the words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # the functions of letters go by bytes and leave those beyond ASCII alone, so the bytes need not be valid text
    lower = pc.ascii_lower(texts.cast(pa.binary()).view(pa.string()))
    words = pc.ascii_split_whitespace(lower)
    flat = pc.list_flatten(words)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    ends = np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()].astype(np.int64)
    coded = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
    return coded.indices.to_numpy(), ends, coded.dictionary.view(pa.binary())


def tokenised(df: DataFrame, key: str, text: str, chunk: int = 3_000_000) -> DataFrame:
    """The texts in chunks that could have ``chunk`` words, or one text more: keys, marks (hashes of key and text), texts (of word
    numbers, as bytes), and the words that the numbers stand for (bytes, A-Z in lower case) with their counts."""
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("mark"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(word_bound(batch.column(2)))
            while batch.num_rows:
                many = int(np.searchsorted(ends, chunk - size)) + 1  # as many texts as reach the size of a chunk
                held.append(batch.slice(0, many))
                size += int(ends[min(many, len(ends)) - 1])
                batch, ends = batch.slice(many), ends[many:] - ends[min(many, len(ends)) - 1]
                if size >= chunk:
                    yield made(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks())

    def made(part):
        import numpy as np
        import pyarrow as pa

        keys, marks, texts = (part.column(c).combine_chunks() for c in range(3))
        number, ends, words = numbered(texts)
        ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.concatenate([[0], ends * 4])), pa.py_buffer(number)])
        lists = (keys, marks, ids.cast(pa.binary()), words, pa.array(np.bincount(number, minlength=len(words)).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in lists], names=["keys", "marks", "texts", "words", "counts"])

    return rows.mapInArrow(run, f"keys array<{kind}>, marks array<bigint>, texts array<binary>, words array<binary>, counts array<bigint>")


def count_words(chunks: DataFrame) -> DataFrame:
    """(word, n, h): every word of all chunks, how often it occurs, and its hash."""
    met = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    return met.groupBy("word").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("word"))


def vocabulary(counts: DataFrame, words: int = WORDS) -> Vocabulary:
    """The ``words`` most frequent words, ties by their bytes, and the sums of the others by rare leaf.

    What comes to the driver is one word and count per leaf.
    """
    import numpy as np

    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.col("n").desc(), "word").limit(words).select("word", "n").toArrow()
    sums_ = [0] * RARE
    names, number = top.column("word").to_pylist(), top.column("n").to_numpy()
    if distinct > len(names):
        least, last = int(number[-1]), F.lit(names[-1])
        others = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)))
        for r in others.groupBy(leaf("h").alias("b")).agg(F.sum("n").alias("n")).collect():
            sums_[r["b"]] = r["n"]
    return Vocabulary(names, number.astype(np.int64), tuple(sums_), total or 0, distinct - len(names))


def leaf(h: str) -> Column:
    """Rare leaf of a word's hash; the low bits, so that the sign does not matter."""
    return F.col(h).bitwiseAND(F.lit(RARE - 1)).cast("int")


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: Vocabulary
    values: dict
    #: Counts of all words of the corpus; None where every word has its own leaf.
    counts: DataFrame | None = None



def encoded(chunks: DataFrame, words: Vocabulary, key: str) -> DataFrame:
    """Per text of the chunks: key, _id (the mark), ids (word numbers as bytes), rare (hashes of the words in rare leaves)."""
    shared = chunks.sparkSession.sparkContext.broadcast(words.words)  # WORDS at most
    kind = chunks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            for row in range(batch.num_rows):
                keys, marks, texts, local = (batch.column(c)[row].values for c in range(4))
                number, h = numbers(local.to_pylist(), known)
                ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // 4
                own = np.frombuffer(b"".join(texts.to_pylist()), np.int32)
                ids = number.take(own)
                far = np.flatnonzero(ids >= len(known))
                rare = pa.ListArray.from_arrays(np.searchsorted(far, np.concatenate([[0], ends])).astype(np.int32), pa.array(h.view(np.int64).take(own.take(far))))
                ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.concatenate([[0], ends * 4])), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([keys, marks, ids.cast(pa.binary()), rare], names=[key, "_id", "ids", "rare"])

    return chunks.select("keys", "marks", "texts", "words").mapInArrow(run, f"`{key}` {kind}, _id bigint, ids binary, rare array<bigint>")


def train(rows: DataFrame, words: Vocabulary, rounds: int = 2, group_words: int = GROUP_WORDS, seed: int = 5) -> dict:
    """Parameters after ``rounds`` of parallel training on encoded rows.

    A group is one task and reads its rows in the order of their hash, as
    they stream in; rows that are equal in key and text are in one group.
    """
    import numpy as np

    tables = words.tables()
    values = first_values(tables["bias"], seed)
    if not words.size:
        return values
    context = rows.sparkSession.sparkContext
    groups = max(rounds * 6, math.ceil(math.sqrt(words.size / group_words)))
    groups += -groups % rounds
    dealt = rows.where(F.length("ids") > 0).select(F.pmod(F.shiftrightunsigned("_id", 1), F.lit(groups)).cast("int").alias("_group"), "_id", "ids")
    code = context.broadcast(tables)  # bounded by WORDS
    for number in range(rounds):
        start = context.broadcast(values)  # a bounded number of parameters

        def learn(batches: Iterator, start=start) -> Iterator:
            import pyarrow as pa

            trainer = None

            def texts():
                for batch in batches:
                    for g, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        yield g, np.frombuffer(x.as_py(), np.int32)

            def out(group: int):
                for kind, v in trainer.values.items():
                    used = np.flatnonzero(trainer.uses[kind])
                    for block in np.unique(used // BLOCK):
                        own = used[used // BLOCK == block]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind]), pa.array([int(block)], pa.int32()), pa.array([group], pa.int32()),
                             pa.array([(own % BLOCK).astype(np.int32).tobytes()]), pa.array([trainer.uses[kind][own].tobytes()]), pa.array([v[own].tobytes()])],
                            names=["kind", "block", "group", "rows", "uses", "values"],
                        )

            for group, part in groupby(texts(), key=lambda x: x[0]):
                trainer = Trainer(code.value, start.value)
                trainer.learn(ids for _, ids in part)
                yield from out(group)

        mine = dealt.where(F.col("_group") % rounds == number)
        spread = mine.repartitionById(groups // rounds, F.floor(F.col("_group") / rounds).cast("int"))
        made = spread.sortWithinPartitions("_group", "_id").select("_group", "ids").mapInArrow(
            learn, "kind string, block int, group int, rows binary, uses binary, values binary"
        )
        values = _averaged(made, values)
        start.unpersist()
    return values


def _averaged(made: DataFrame, values: dict) -> dict:
    """Rows of parameters as means over groups, summed block by block in the order of groups."""
    import numpy as np

    width = {k: v.shape[1] for k, v in values.items()}

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, total, uses = None, None, None

        def out():
            rows = np.flatnonzero(uses)
            mean = (total[rows] / uses[rows][:, None]).astype(np.float32)
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([rows.astype(np.int32).tobytes()]), pa.array([mean.tobytes()])],
                names=["kind", "block", "rows", "values"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if (r["kind"], r["block"]) != now:
                    if now:
                        yield out()
                    now, total, uses = (r["kind"], r["block"]), np.zeros((BLOCK, width[r["kind"]])), np.zeros(BLOCK)
                rows, n = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["uses"], np.float32).astype(float)
                total[rows] += np.frombuffer(r["values"], np.float32).reshape(len(rows), -1) * n[:, None]
                uses[rows] += n
        if now:
            yield out()

    dealt = made.repartition("kind", "block").sortWithinPartitions("kind", "block", "group")
    out = {k: v.copy() for k, v in values.items()}
    for r in dealt.mapInArrow(merge, "kind string, block int, rows binary, values binary").toLocalIterator():
        rows = np.frombuffer(r["rows"], np.int32) + r["block"] * BLOCK
        out[r["kind"]][rows] = np.frombuffer(r["values"], np.float32).reshape(len(rows), -1)
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, **training) -> tuple[LanguageModel, DataFrame]:
    """Counts over all documents, training on all positions; the model, and the encoded documents for ``score_encoded``."""
    chunks = stored(tokenised(df, key, text), "word-chunks")
    counts = stored(count_words(chunks), "word-counts")
    known = vocabulary(counts, words)
    rows = stored(encoded(chunks, known, key), "word-numbers")
    discard(chunks)
    return LanguageModel(known, train(rows, known, **training), counts if known.others else None), rows


def score_encoded(rows: DataFrame, model: LanguageModel, key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.vocabulary.tables(), model.values))  # bounded by WORDS
    kind = rows.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        net = Network(*shared.value)
        for batch in batches:
            n, s = [], []
            for cost in net.costs(np.frombuffer(value.as_py(), np.int32) for value in batch.column(2)):
                n.append(len(cost))
                s.append(-float(cost.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pa.float64()), batch.column(3)], names=[key, "_id", "n", "s", "m"])

    judged = rows.select(key, "_id", "ids", F.size("rare").cast("long").alias("m")).mapInArrow(run, f"`{key}` {kind}, _id bigint, n bigint, s double, m bigint")
    whole = F.array(*[F.log(F.lit(float(n + 1))) for n in model.vocabulary.totals])
    met = rows.where(F.size("rare") > 0).select("_id", F.explode("rare").alias("h"))
    met = met.withColumn("_whole", whole[leaf("h")])
    if model.counts is None:  # the corpus has no such word
        met = met.withColumn("n", F.lit(1).cast("long"))
    else:
        # by hash, as neither side need fit in memory
        met = met.join(model.counts.select("h", "n").hint("shuffle_hash"), "h", "left")
    # rows that are equal in key and text have the same mean share, so they may meet
    share = met.groupBy("_id").agg(F.avg(F.log(F.coalesce("n", F.lit(1)).cast("double")) - F.col("_whole")).alias("_share"))
    placed = judged.join(share, "_id", "left")
    total = F.col("s") + F.coalesce(F.col("m") * F.col("_share"), F.lit(0.0))
    return placed.select(key, F.col("n").alias("n_words"), total.alias("log_likelihood"), F.when(F.col("n") > 0, total / F.col("n")).alias("mean_logprob"))


def score(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, log_likelihood (sum over all words), mean_logprob.

    A null or wordless text has 0 words, log_likelihood 0 and a null mean.
    Whole texts are scored, of any length; repeated rows each; other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    return score_encoded(encoded(tokenised(df, key, text), model.vocabulary, key), model, key)


def pseudo_likelihood(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on all rows and score all rows, as ``score`` does."""
    model, rows = fit(df, key, text)
    return score_encoded(rows, model, key)
