"""The attention classifier against plain formulas, by its gradient, on held-out rows, and in the odd cases it defines."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import passage_quality as pq

DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, quality int"


def made_up(rng, good: bool) -> str:
    clean = [" ".join("".join(rng.choice(["ta", "ri", "no", "be", "lu", "sé"], rng.integers(1, 4))) for _ in range(int(rng.integers(5, 14)))).capitalize() + "." for _ in range(int(rng.integers(4, 40)))]
    if good:
        return " ".join(clean)
    at, kind = int(rng.integers(0, len(clean))), int(rng.integers(0, 3))
    junk = ["BUY NOW!! " * 40, "| a | b7 " * 50, "same " * 80][kind]
    return " ".join(clean[:at] + [junk] + clean[at:])


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    docs = [(i, made_up(rng, i % 4 != 0)) for i in range(600)]
    labels = [(i, int(i % 4 != 0)) for i in range(600)]
    # the held-out rows have wrong labels: they must teach nothing
    labels = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, q in labels]
    labels += [(None, 0), (10**9, 1), (5, 7), (6, None)]
    docs += [(None, "no key"), (1000, None), (1001, ""), (1002, " \n\t "), (1003, "x" * 700_000 + " end."), (1, docs[1][1])]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def model(tables):
    return pq.fit_quality(*tables, per_class=200, epochs=20)


def test_held_out_accuracy(tables, model):
    docs, _ = tables
    rows = pq.score_quality(docs.withColumn("held", pq.held_out(F.col("doc_id"))), model).where("held and doc_id < 600").collect()
    right = sum((r["quality_score"] >= 0.7) == (r["doc_id"] % 4 != 0) for r in rows)
    assert len(rows) > 100 and right >= 0.95 * len(rows)


def test_same_sample_same_numbers(tables, model):
    again = pq.fit_quality(tables[0].repartition(9), tables[1].repartition(3), per_class=200, epochs=20)
    assert all(np.array_equal(again.weights[k], model.weights[k]) for k in model.weights)


def test_scores_equal_the_formula(tables, model):
    for r in pq.score_quality(tables[0].where("doc_id < 30 or doc_id >= 1000"), model).collect():
        text, p = r["text"] or "", model.weights
        if len(text) > 10_000:
            continue
        h = [[math.tanh(sum(x * w for x, w in zip((f - model.mean) / model.scale, p["E"][:, j])) + p["e"][j]) for j in range(len(p["c"]))] for f in pq.measured([text])[0]]
        logits = []
        for e in h:
            gate = lambda m, e=e: [sum(a * b for a, b in zip(e, m[:, j])) for j in range(m.shape[1])]
            logits.append(sum(w * math.tanh(t) / (1 + math.exp(-s)) for w, t, s in zip(p["w"], gate(p["V"]), gate(p["U"]))))
        total = sum(map(math.exp, logits))
        z = [sum(math.exp(a) / total * e[j] for a, e in zip(logits, h)) for j in range(len(p["c"]))]
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["d"]))), abs=1e-9)


def test_measures_of_passages():
    text = ("Ab ab. 12, XY XY XY\n" * 40)[:700]
    got, counts = pq.measured([text, "", "né"])
    assert counts.tolist() == [3, 1, 1] and got.shape == (5, pq.FEATURES)
    for k in range(3):
        part = text[256 * k : 256 * (k + 1)]
        share = lambda test, part=part: sum(map(test, part)) / len(part)
        assert got[k, pq._UPPER] ** 2 == pytest.approx(share(str.isupper))
        assert got[k, pq._DIGIT] ** 2 == pytest.approx(share(str.isdigit))
        assert got[k, pq._LINE] ** 2 == pytest.approx(share("\n".__eq__))
        starts = [i for i in range(256 * k, min(256 * (k + 1), 700)) if not text[i].isspace() and (i == 0 or text[i - 1].isspace())]
        words = {i: text[i:].split()[0] for i in starts}
        before = {i: (text[:i].split() or [""])[-1] for i in starts}
        assert got[k, pq._KINDS] ** 2 == pytest.approx(sum(words[i] == before[i] for i in starts) / len(starts))
        assert got[k, pq._KINDS + 2] ** 2 == pytest.approx(sum(w == "XY" for w in words.values()) / len(starts))
    assert not got[3].any() and got[4, pq._LOWER] == 1


def test_batches_and_pieces_do_not_matter(model, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [made_up(rng, i % 2 == 0) for i in range(40)] + ["", None]
    one_by_one = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), one_by_one, atol=1e-12)
    monkeypatch.setattr(pq, "PIECE", 1024)
    assert np.allclose(model.scores(texts), np.concatenate([model.scores([t]) for t in texts]), atol=1e-12)


def test_gradient():
    rng = np.random.default_rng(2)
    x, starts, y = rng.normal(size=(9, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    p = {k: rng.normal(size=s) for k, s in {"E": (5, 4), "e": 4, "V": (4, 3), "U": (4, 3), "w": 3, "c": 4, "d": ()}.items()}
    p["d"] = np.array(p["d"])
    weight = np.array([1.0, 2.0, 0.5])
    _, grad = pq.loss_and_gradient(p, x, starts, y, weight, 0.1)
    for k in p:
        for at in np.ndindex(p[k].shape):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            slope = (pq.loss_and_gradient(up, x, starts, y, weight, 0.1)[0] - pq.loss_and_gradient(down, x, starts, y, weight, 0.1)[0]) / 2e-6
            assert grad[k][at] == pytest.approx(slope, abs=1e-5)


def test_odd_rows_and_columns(tables, model):
    docs, labels = tables
    clash = docs.withColumns({"quality_score": F.lit("x"), "_judged": F.lit(1), "a.b": F.lit(2)})
    got = pq.score_quality(clash, model)
    assert sorted(got.columns) == sorted(clash.columns) and got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(r["quality_score"])
        assert 0 <= r["quality_score"] <= 1
    assert len(by[1]) == 1 and by[1000] == by[1001]
    assert pq.score_quality(docs.limit(0), model).count() == 0
    none = pq.fit_quality(docs, labels.limit(0))
    assert none.scores(["a", None]).tolist() == [0.5, 0.5]
    assert pq.fit_quality(docs, labels.where("quality = 1")).constant == 1.0
    assert pq.fit_quality(docs.limit(0), labels).constant == 0.5
