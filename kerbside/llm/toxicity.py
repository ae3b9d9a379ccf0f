"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Texts and lexicon are folded alike: lower case, homoglyphs to Latin letters,
digits and signs used as letters to those letters, invisible characters gone.
The lexicon is a short seed list and the terms, whole words or word stems, that
labelled documents teach; they teach exception phrases too.  A match inside an
exception phrase does not count.
The summed weights, divided by a power of the number of words, go through a
logistic curve whose three numbers are fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm._common import free_names, own, stored
from kerbside.llm.sharding import unit_hash

# Letters that look alike, as "lookalikes: letter".
_LOOKALIKES = {
    "a": "4@аαɑａ", "b": "ЬЪьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "3еεёｅ", "f": "ｆ", "g": "9ɡｇ", "h": "һｈ",
    "i": "1іιıｉ", "j": "јｊ", "k": "кκｋ", "l": "ӏｌ", "m": "мｍ", "n": "пηｎ", "o": "0оοσｏ", "p": "рρｐ",
    "q": "ԛｑ", "r": "гｒ", "s": "5$ѕｓ", "t": "7тτｔ", "u": "υսｕ", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ",
    "y": "уγｙ", "z": "2ｚ",
}
# Zero-width space, non-joiner, joiner, word joiner, byte order mark, soft hyphen.
_INVISIBLE = "​‌‍⁠﻿­"
_FOLD = {ord(x): ord(letter) for letter, looks in _LOOKALIKES.items() for x in looks} | {ord(x): None for x in _INVISIBLE}
_WORD = re.compile(r"[^\W_]+")

# General insults that need no labels, and harmless phrases that contain one.
SEED_TERMS = ("asshole", "bastard", "bitch", "dumbass", "idiot", "imbecile", "moron", "retard", "scumbag", "shithead")
EXCEPTION_PHRASES = (
    "clown fish", "idiot proof", "idiot savant", "trash bag", "trash bin", "trash can", "trash collection",
    "village idiot", "white trash bag",
)
SEED_WEIGHT = 4.0


def fold(text: str | None) -> str:
    """Lower case, with homoglyphs and substituted digits as plain letters."""
    return text.lower().translate(_FOLD) if text else ""


@dataclass(frozen=True)
class ToxicityModel:
    """terms: (folded term, weight, whether it is a stem)."""

    terms: tuple[tuple[str, float, bool], ...]
    exceptions: tuple[str, ...] = EXCEPTION_PHRASES
    length_power: float = 0.25
    slope: float = 4.0
    offset: float = -2.0
    _built: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"}

    def __setstate__(self, state):
        self.__dict__.update(state, _built={})

    def automaton(self):
        if "a" not in self._built:
            import ahocorasick

            best: dict[str, tuple[float, int]] = {}
            for term, weight, stem in self.terms:
                if term and (term not in best or weight > best[term][0]):
                    best[term] = (weight, 1 if stem else 0)
            for phrase in self.exceptions:
                best[fold(phrase)] = (0.0, 2)
            made = ahocorasick.Automaton()
            for term, (weight, kind) in best.items():
                made.add_word(term, (len(term), weight, kind))
            made.make_automaton()
            self._built["a"] = made if len(made) else None
        return self._built["a"]

    def hits(self, text: str | None) -> tuple[float, int, int]:
        """Summed weights, number of words hit, number of words."""
        folded = fold(text)
        at = self._weights(folded)
        return math.fsum(at.values()), len(at), len(folded.split())

    def surroundings(self, text: str | None) -> Iterator[str]:
        """Each hit's word with the word before it, and with the word after it, as they stand in the folded text."""
        folded = fold(text)
        words = [m.span() for m in _WORD.finditer(folded)] if (at := self._weights(folded)) else []
        for i, (start, _) in enumerate(words):
            if start in at:
                if i:
                    yield folded[words[i - 1][0] : words[i][1]]
                if i + 1 < len(words):
                    yield folded[words[i][0] : words[i + 1][1]]

    def _weights(self, folded: str) -> dict[int, float]:
        """Weight of the hit at each place, without those inside an exception phrase."""
        found = self.automaton()
        if not folded or found is None:
            return {}
        n, at, spans = len(folded), {}, []
        for last, (size, weight, kind) in found.iter(folded):
            start = last + 1 - size
            if start and folded[start - 1].isalnum():
                continue
            if kind != 1 and last + 1 < n and folded[last + 1].isalnum():
                continue
            if kind == 2:
                spans.append((start, last))
            elif weight > at.get(start, -1.0):
                at[start] = weight
        for start, last in spans:
            for p in range(start, last + 1):
                at.pop(p, None)
        return at

    def score(self, total: float, words: int) -> float:
        x = self.slope * total / max(words, 1) ** self.length_power + self.offset
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def held_out(key: Column) -> Column:
    """Rows no label is learnt from: crc32 of the key as text leaves 0 modulo 5; a null key is never one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(text: str, stems: range) -> tuple[set[str], set[str]]:
    words = set(_WORD.findall(fold(text)))
    return {w for w in words if len(w) >= 3}, {w[:k] for w in words for k in stems if len(w) > k}


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of labelled rows that are not held out: about ``per_class``
    of each class at most, chosen by a hash of the key."""
    ids = (
        labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    size = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(per_class / max(size.get(1, 0), 1))).otherwise(
        F.lit(2 * per_class / max(size.get(0, 0), 1))
    )
    chosen = ids.where(unit_hash(F.concat(F.lit("toxic:"), F.col("_id").cast("string"))) < share)
    # the sample's size is bounded by per_class, so it may be broadcast
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "_id").select("text", "toxic")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    per_class: int = 3000,
    stem_lengths: Sequence[int] = (3, 4, 5, 6, 7, 8),
) -> ToxicityModel:
    """Learn terms and curve from labelled rows; without any, the seed list alone.

    The sample holds about ``per_class`` toxic and twice as many clean rows at
    most, so what comes to the driver (candidate terms, and per sampled toxic row
    the candidates it holds) is bounded by that.  A term is a candidate if three
    toxic rows or more have it and its rate in toxic rows is eight times that in
    clean rows.  Terms are taken as long as they explain toxic rows that no term
    so far explains, at twice the cost of the clean rows that they hit.  Two
    words around a hit become an exception phrase by the same rule turned round:
    three clean rows or more have them, at eight times the rate of toxic rows.

    Null keys, and labels other than 0 and 1, teach nothing; a key that is
    labelled twice counts as toxic if one label says so, and each of its rows is
    read.  Ties go to whole words, longer terms and then by name.
    """
    stems = range(min(stem_lengths), max(stem_lengths) + 1)
    rows = stored(training_rows(docs, labels, per_class, key, text), "toxic-sample")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    seed = tuple((fold(t), SEED_WEIGHT, False) for t in SEED_TERMS)
    if not n1 or not n0:
        return ToxicityModel(seed)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        toxic, clean = Counter(), Counter()

        def out():
            names = list(toxic.keys() | clean.keys())
            made = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
                names=["term", "n1", "n0"],
            )
            toxic.clear()
            clean.clear()
            return made

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, heads = _features(t, stems)
                (toxic if y else clean).update([f"w{w}" for w in words] + [f"s{h}" for h in heads])
                if len(toxic) + len(clean) > 400_000:
                    yield out()
        yield out()

    least = 3
    found = (
        rows.mapInArrow(count, "term string, n1 bigint, n0 bigint")
        .groupBy("term")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        .where((F.col("n1") >= least) & (F.col("n0") * (n1 / n0) * 8 <= F.col("n1")))
        .orderBy(F.col("n1").desc(), "term")
        .collect()
    )
    names = [r["term"] for r in found]
    index = {x: i for i, x in enumerate(names)}

    def held(texts):
        import pandas as pd

        out = []
        for t in texts:
            words, heads = _features(t, stems)
            out.append(sorted({index[x] for x in [f"w{w}" for w in words] + [f"s{h}" for h in heads] if x in index}))
        return pd.Series(out)

    marks = F.pandas_udf(held, T.ArrayType(T.IntegerType()))
    covered = [set() for _ in names]
    for r, row in enumerate(rows.where("toxic = 1").select(marks("text").alias("m")).collect()):
        for i in row["m"]:
            covered[i].add(r)
    picked = _cover(names, covered, least, [2.0 * r["n0"] * n1 / n0 for r in found])
    weigh = {i: math.log((found[i]["n1"] + 0.5) / (n1 + 1)) - math.log((found[i]["n0"] + 0.5) / (n0 + 1)) for i in picked}
    model = ToxicityModel(seed + tuple((names[i][1:], w, names[i][0] == "s") for i, w in weigh.items()))

    model = replace(model, exceptions=model.exceptions + _learnt_exceptions(rows, model, n1, n0, least))

    @F.pandas_udf("total double, hits int, words int")
    def measure(texts):
        import pandas as pd

        return pd.DataFrame([model.hits(t) for t in texts], columns=["total", "hits", "words"])

    seen = rows.select(measure("text").alias("m"), "toxic").select("m.*", "toxic").collect()
    return _calibrated(model, [(r["total"], r["words"], r["toxic"]) for r in seen])


def _learnt_exceptions(rows: DataFrame, model: ToxicityModel, n1: int, n0: int, least: int) -> tuple[str, ...]:
    """Pairs of neighbouring words around hits of the model that are harmless by the labelled rows."""

    @F.pandas_udf("array<string>")
    def around(texts):
        import pandas as pd

        return pd.Series([sorted(set(model.surroundings(t))) for t in texts])

    met = rows.select(F.explode(around("text")).alias("phrase"), "toxic").groupBy("phrase").agg(F.sum("toxic").alias("y"), F.sum(1 - F.col("toxic")).alias("n"))
    good = met.where((F.col("n") >= least) & (F.col("y") * (n0 / n1) * 8 <= F.col("n")))
    return tuple(r["phrase"] for r in good.orderBy("phrase").collect())


def _cover(names: list[str], covered: list[set[int]], least: int, cost: list[float]) -> list[int]:
    """Greedy cover of the toxic rows; ties go to whole words, then to longer terms."""
    import heapq

    left = set().union(*covered) if covered else set()
    heap = [(cost[i] - len(c), names[i][0] == "s", -len(names[i]), names[i], i) for i, c in enumerate(covered)]
    heapq.heapify(heap)
    picked: list[int] = []
    while heap and left:
        value, stem, size, name, i = heapq.heappop(heap)
        new = len(covered[i] & left)
        if new < least or cost[i] >= new:
            continue
        if cost[i] - new > value:
            heapq.heappush(heap, (cost[i] - new, stem, size, name, i))
            continue
        picked.append(i)
        left -= covered[i]
    # what the cover needs no more still marks other rows: whole terms as strong as those picked
    floor = max(10 * least, min((len(covered[i]) for i in picked), default=0))
    stems = {names[i][1:] for i in picked if names[i][0] == "s"}
    for i, c in enumerate(covered):
        term = names[i][1:]
        if names[i][0] == "w" and len(c) >= floor and i not in picked and not any(term.startswith(s) for s in stems):
            picked.append(i)
    return picked


def _calibrated(model: ToxicityModel, rows: list[tuple[float, int, int]]) -> ToxicityModel:
    """The length power and logistic curve with the least loss on ``rows``, a class counting as much as the other."""
    import numpy as np

    total, words, y = (np.array(x, float) for x in zip(*rows, strict=True))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    best = (math.inf, model)
    for power in (0.125, 0.25, 0.5, 0.75, 1.0):
        x = total / np.maximum(words, 1) ** power
        scale = float(np.median(x[x > 0])) if (x > 0).any() else 1.0
        z, b = x / scale, np.array([4.0, -2.0])
        design = np.stack([z, np.ones_like(z)], 1)
        ridge = np.diag([1e-4, 1e-4])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
            grad = design.T @ (weight * (p - y)) + ridge @ b
            hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge
            step = np.linalg.solve(hess, grad)
            b = b - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ b, -30, 30))), 1e-9, 1 - 1e-9)
        loss = float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        if loss < best[0] and b[0] > 0:
            best = (loss, ToxicityModel(model.terms, model.exceptions, power, float(b[0] / scale), float(b[1])))
    return best[1]


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic_hits`` (int) to every row, replacing columns so named.

    Whole texts are read, long ones too.  A null or empty text scores as a text
    without a hit.  The score depends on the text alone, so repeated rows score
    alike; all other columns stay, and an empty table gives an empty table.
    """

    @F.pandas_udf("s double, h int")
    def judge(texts):
        import pandas as pd

        out = []
        for t in texts:
            total, hits, words = model.hits(t)
            out.append((model.score(total, words), hits))
        return pd.DataFrame(out, columns=["s", "h"])

    plain = df.drop("toxicity", "toxic_hits")
    (mark,) = free_names(df, "_judged")
    # not deterministic for the planner only, so that a filter on the score does not run the matcher twice
    judged = plain.withColumn(mark, judge.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
    return judged.select(*own(plain), F.col(f"{mark}.s").alias("toxicity"), F.col(f"{mark}.h").alias("toxic_hits"))
