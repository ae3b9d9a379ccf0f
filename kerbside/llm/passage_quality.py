"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of 256 characters.  Every passage is measured
(shares of kinds of characters, shapes and repetitions of words), encoded by a
learned layer, and weighted by a learned gated attention: the weight of passage
k is the softmax over the document of w·(tanh(V h_k) * sigmoid(U h_k)).  A
logistic unit on the weighted sum of the encodings scores the document.  Only
documents are labelled; the attention learns which passages speak.

The numbers are fitted by numpy on a bounded sample of labelled documents;
scoring reads whole texts on the executors and keeps two running sums a document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm._common import discard, free_names, own, stored
from kerbside.llm.sharding import unit_hash

PASSAGE = 256
#: Code points that are measured at once; a multiple of PASSAGE.  Longer texts are read in pieces of this size.
PIECE = 1 << 18
_SIGNS = ["#", "*", "$", "%", "&", "|", "<>", "@", "_", "=+~^`", "/\\", "-", ".", ",", ":;", "!", "?", "'\"", "()[]{}"]
_LOWER, _UPPER, _OTHER_LETTER, _DIGIT, _BLANK, _LINE, _CONTROL, _REST = range(8)
_KINDS = 8 + len(_SIGNS)
_BACK = 8
FEATURES = _KINDS + 9


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point below 65 536; letters, digits and the rest beyond count as other letters."""
    out = np.full(1 << 16, _REST, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        group = unicodedata.category(c)
        if group in ("Ll", "Lu", "Nd", "Cc") or group[0] in "LMZ":
            out[i] = {"Ll": _LOWER, "Lu": _UPPER, "Nd": _DIGIT, "Cc": _CONTROL}.get(group, _BLANK if group[0] == "Z" else _OTHER_LETTER)
    for i, signs in enumerate(_SIGNS):
        out[[ord(c) for c in signs]] = 8 + i
    out[[ord(c) for c in "\t\x0b\x0c\r"]] = _BLANK
    out[ord("\n")] = _LINE
    return out


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def measured(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the pieces, one after the other, and how many passages each piece has; an empty piece has one."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in pieces]
    sizes = np.array([len(p) for p in points])
    passages = np.maximum(-(-sizes // PASSAGE), 1)
    total = int(passages.sum())
    text = np.concatenate([*points, np.zeros(0, np.uint32)])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    first = np.concatenate([[0], np.cumsum(passages)])[:-1]
    piece = np.repeat(np.arange(len(pieces)), sizes)
    passage = first[piece] + (np.arange(len(text)) - starts[piece]) // PASSAGE
    kind = np.where(text < (1 << 16), _kinds()[np.minimum(text, (1 << 16) - 1)], _OTHER_LETTER).astype(np.int64)
    shares = np.bincount(passage * _KINDS + kind, minlength=total * _KINDS).reshape(total, _KINDS) / np.maximum(np.bincount(passage, minlength=total), 1)[:, None]

    solid = (kind != _BLANK) & (kind != _LINE) & (kind != _CONTROL)
    new = solid.copy()
    new[1:] &= ~solid[:-1] | (np.diff(piece) > 0)
    begin = np.flatnonzero(new)
    out = np.zeros((total, FEATURES))
    out[:, :_KINDS] = np.sqrt(shares)
    if len(begin):
        word = np.cumsum(new[solid]) - 1
        at = np.flatnonzero(solid)
        place = at - begin[word]
        length = np.bincount(word)
        heads = np.flatnonzero(new[solid])
        code = np.add.reduceat(text[at].astype(np.uint64) * _powers()[place % 64], heads)
        upper, lower = (np.bincount(word, kind[at] == k, len(begin)) for k in (_UPPER, _LOWER))
        letters = upper + lower + np.bincount(word, kind[at] == _OTHER_LETTER, len(begin))
        of, whose = passage[begin], piece[begin]
        again, near = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
        for back in range(1, _BACK + 1):
            same = (code[back:] == code[:-back]) & (whose[back:] == whose[:-back])
            near[back:] |= same
            if back == 1:
                again[1:] = same
        last = kind[at[np.append(heads[1:], len(at)) - 1]]
        each = np.maximum(np.bincount(of, minlength=total), 1)
        words = [
            again, near, (upper >= 2) & (upper == letters), (kind[begin] == _UPPER) & (lower > 0), letters == 0, length > 24,
            last >= 8, np.minimum(length, 40) / 40,
        ]
        for i, x in enumerate(words):
            out[:, _KINDS + i] = np.sqrt(np.bincount(of, x.astype(float), total) / each)
        out[:, -1] = np.log1p(np.bincount(of, minlength=total)) / 5
    return out, passages


@dataclass(frozen=True)
class PassageModel:
    """The fitted numbers; without weights every document scores ``constant``."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict | None = None
    constant: float = 0.5

    def encoded(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of passages and their attention before it is normalised."""
        p = self.weights
        h = np.tanh((features - self.mean) / self.scale @ p["E"] + p["e"])
        return h, np.exp(_gate(h, p)[2])

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The score of each text; whole texts are read, piece by piece."""
        texts = [t or "" for t in texts]
        if self.weights is None:
            return np.full(len(texts), self.constant)
        summed, total = np.zeros((len(texts), len(self.weights["c"]))), np.zeros(len(texts))
        for of, pieces in _batched(texts):
            features, passages = measured(pieces)
            h, a = self.encoded(features)
            whose = np.repeat(of, passages)
            np.add.at(total, whose, a)
            np.add.at(summed, whose, a[:, None] * h)
        logit = summed / np.maximum(total, 1e-300)[:, None] @ self.weights["c"] + self.weights["d"]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _batched(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts, of PIECE code points at most in all (or one piece), with the numbers of their texts."""
    of, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(len(t), 1), PIECE):
            piece = t[k : k + PIECE]
            if pieces and size + len(piece) > PIECE:
                yield of, pieces
                of, pieces, size = [], [], 0
            of.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield of, pieces


def _gate(h: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    return t, s, (t * s) @ p["w"]


def loss_and_gradient(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, dict]:
    """Weighted cross-entropy of bags that lie one after the other from ``starts``, and its gradient."""
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ p["E"] + p["e"])
    t, s, a = _gate(h, p)
    e = np.exp(a)
    share = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(share[:, None] * h, starts)
    prob = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -60, 60)))
    loss = -(weight * (y * np.log(prob + 1e-12) + (1 - y) * np.log(1 - prob + 1e-12))).sum()
    gl = weight * (prob - y)
    gz = gl[:, None] * p["c"]
    gshare = (gz[of] * h).sum(1)
    ga = share * (gshare - np.add.reduceat(share * gshare, starts)[of])
    gt, gs = ga[:, None] * p["w"] * s * (1 - t * t), ga[:, None] * p["w"] * t * s * (1 - s)
    gh = (share[:, None] * gz[of] + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
    grad = {"E": x.T @ gh, "e": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ga, "c": z.T @ gl, "d": np.array(gl.sum())}
    loss += ridge / 2 * sum(float((p[k] ** 2).sum()) for k in "EVUwc")
    return float(loss), {k: g + ridge * p[k] if k in "EVUwc" else g for k, g in grad.items()}


def held_out(key: Column) -> Column:
    """Rows no label is learnt from: crc32 of the key as text leaves 2 modulo 4; a null key is never one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, per_class: int, passages_a_bag: int, key: str, text: str, label: str) -> list[tuple[int, np.ndarray]]:
    """(label, features) of about ``per_class`` labelled documents of each class that are not held out, chosen by a hash of the key."""
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    )
    size = {r["_label"]: r["count"] for r in ids.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, F.lit(per_class / max(size.get(1, 0), 1))).otherwise(F.lit(per_class / max(size.get(0, 0), 1)))
    # bounded by per_class, so it may be broadcast
    chosen = F.broadcast(ids.where(unit_hash(F.concat(F.lit("quality:"), F.col("_id").cast("string"))) < share))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen, "_id")
    # rows that share a key are one bag each; a key with very many rows would fill the sample, so its rows are counted by text
    rows = stored(rows.select("_id", "_label", "_text").distinct(), "quality-sample")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bags = []
            for t in batch.column("_text").to_pylist():
                parts = [measured(pieces)[0] for _, pieces in _batched([t])]
                bag = np.concatenate(parts)
                if len(bag) > passages_a_bag:
                    bag = bag[np.linspace(0, len(bag) - 1, passages_a_bag).astype(int)]
                bags.append(bag.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_label"), pa.array(bags, pa.binary())], names=["id", "label", "bag"])

    limit = 4 * per_class
    found = rows.mapInArrow(encode, "id string, label int, bag binary").orderBy(F.xxhash64("id", "bag"), "id", "bag").limit(limit).collect()
    discard(rows)
    return [(r["label"], np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(np.float64)) for r in found]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_class: int = 2000,
    passages_a_bag: int = 128,
    hidden: int = 24,
    gates: int = 12,
    epochs: int = 30,
    cut: float = 0.7,
) -> PassageModel:
    """Learn encoder, attention and score from labelled documents that are not held out.

    The sample is bounded: about ``per_class`` documents of each class, by a hash
    of the key, and of a document with more passages ``passages_a_bag``, evenly
    spaced; a key with several texts counts once per text, four times
    ``per_class`` rows in all at most.  Null keys and labels other than 0 and 1
    teach nothing; a key that is labelled twice counts as bad if one label says
    so.  The two classes weigh the same, and the offset is then moved so that a
    document that is as likely one as the other scores ``cut``.  Where a class is
    missing every document scores 1 (only good ones), 0 (only bad ones) or 0.5.
    """
    bags = training_bags(docs, labels, per_class, passages_a_bag, key, text, label)
    y = np.array([b[0] for b in bags], float)
    if not len(bags) or y.min() == y.max():
        return PassageModel(constant=float(y[0]) if len(bags) else 0.5)
    everything = np.concatenate([b[1] for b in bags])
    mean, scale = everything.mean(0), everything.std(0) + 1e-2
    del everything
    x = [(b[1] - mean) / scale for b in bags]
    weights = fitted(x, y, hidden, gates, epochs)
    weights["d"] = weights["d"] + np.log(cut / (1 - cut))
    return PassageModel(mean, scale, weights)


def fitted(x: list[np.ndarray], y: np.ndarray, hidden: int, gates: int, epochs: int, bags_a_step: int = 64, ridge: float = 1e-5) -> dict:
    """Adam over shuffled groups of bags, with a falling rate; seeded, so the same sample gives the same numbers."""
    rng = np.random.default_rng(5)
    n = x[0].shape[1]
    p = {"E": rng.normal(0, n**-0.5, (n, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gates)), "U": rng.normal(0, 0.3, (hidden, gates))}
    p |= {"w": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, hidden), "d": np.array(0.0)}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    steps = epochs * -(-len(x) // bags_a_step)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for some in (order[i : i + bags_a_step] for i in range(0, len(x), bags_a_step)):
            step += 1
            starts = np.concatenate([[0], np.cumsum([len(x[i]) for i in some])])[:-1]
            _, g = loss_and_gradient(p, np.concatenate([x[i] for i in some]), starts, y[some], weight[some] / len(some), ridge)
            rate = 0.01 * (1 - step / steps) + 1e-5
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def score_quality(df: DataFrame, model: PassageModel, text: str = "text") -> DataFrame:
    """Add ``quality_score`` (0 to 1) to every row, replacing a column so named.

    Whole texts are read.  A null or empty text is one passage of nothing.  The
    score depends on the text alone, so repeated rows score alike; all other
    columns stay, and an empty table gives an empty table.
    """

    @F.pandas_udf("double")
    def judge(texts):
        import pandas as pd

        return pd.Series(model.scores(texts))

    plain = df.drop("quality_score")
    (mark,) = free_names(df, "_judged")
    # not deterministic for the planner only, so that a filter on the score does not run the model twice
    judged = plain.withColumn(mark, judge.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
    return judged.select(*own(plain), F.col(mark).alias("quality_score"))
