"""Conversation repair against a search over all edits, and the odd cases it defines."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from kerbside.llm import repair

CONVS = "conv_id bigint, turn bigint, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")
LONGEST = "s" + "ua" * 20


def search(rows: list[tuple[str, str, bool, bool]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cheapest edits of (role, text, must go, truncated), least letters first: a best-first search over all of them."""
    heap = [(0, "", 0, ())]
    while True:
        cost, letters, i, made = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in made)
        if not (LONGEST.startswith(initials) or LONGEST[1:].startswith(initials)):
            continue
        if i == len(rows) and WHOLE.fullmatch(initials):
            return cost, letters, list(made)
        for who in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, letters + "I", i, (*made, (who, ""))))
        if i < len(rows):
            role, text, must_go, cut_off = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, made))
            if not must_go:
                if role[:1] in tuple("sua"):
                    heapq.heappush(heap, (cost + 3 * cut_off, letters + "K", i + 1, (*made, (role, text))))
                for who in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + 3 * cut_off, letters + "R", i + 1, (*made, (who, text))))


def plain(rows: list[tuple]) -> dict:
    """The contract in plain Python: (conv_id, turn, role, text) to the values of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            role = "user" if fault == 4 else role
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults, judged = set(), [], []
        for _, role, text in kept:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
            judged.append((role, text, faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, made = search(judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def report(df) -> dict:
    got = [tuple(r) for r in repair.repair_report(df).collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.fixture(scope="module")
def conversations():
    rng = np.random.default_rng(3)
    texts = ["Yes.", "No!", "Well", "Why?", "", " \t", None, "né. ", "a\nb."]
    rows = []
    for conv in range(150):
        roles = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None], int(rng.integers(1, 6)))
        for i, role in enumerate(roles):
            text = texts[rng.integers(len(texts))]
            rows.append((conv, None if rng.random() < 0.05 else int(i * rng.integers(1, 3)), None if role is None else str(role), text if text is None else str(text)))
    rows += [(None, 0, "user", "No key."), (None, None, None, None), (500, 1, "user", "Same."), (500, 1, "user", "Same."), (500, 2, "assistant", "Same.")]
    return rows


def test_repairs_equal_a_search_over_all_edits(spark, conversations):
    df = spark.createDataFrame(conversations, CONVS).repartition(7)
    assert report(df.withColumns({c: df["text"] for c in ("key", "conv", "digest", "kind", "place", "audit", "_fault")})) == plain(conversations)


def test_small_batches_find_the_same(spark, conversations, monkeypatch):
    df = spark.createDataFrame(conversations, CONVS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert report(df) == plain(conversations)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_conversations_and_texts(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(5000)] + [(2, 0, "user", "long " * 300_000 + "end."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, CONVS)
    plans = {r["conv_id"]: r for r in repair.plan_repairs(df).collect()}
    assert plans[1]["audit"] == "K" * 5000 and plans[1]["cost"] == 0 and plans[2]["audit"] == "KK"
    made = repair.apply_repairs(df, repair.plan_repairs(df)).collect()
    assert sorted((r["conv_id"], r["place"], r["role"], r["text"]) for r in made) == rows


def test_tensor_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 40, 60)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = int(lengths.sum())
    kinds, must_go, cut_off = rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.2
    cost, audit = repair.cheapest_edits(kinds, must_go, cut_off & ~must_go, starts)
    monkeypatch.setattr(repair, "TENSOR_CELLS", 50)
    again, letters = repair.cheapest_edits(kinds, must_go, cut_off & ~must_go, starts)
    assert cost.tolist() == again.tolist() and audit == letters
    assert [len(a.replace("I", "")) for a in audit] == lengths.tolist()


def test_nothing_left_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVS)
    assert report(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.repair_report(df.limit(0)).count() == 0
    assert repair.plan_repairs(df.limit(0)).count() == 0


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "assistant", "Ho."), ("y", 0, "assistant", "Hm.")], "c string, t int, r string, b string")
    got = {r["c"]: r["audit"] for r in repair.plan_repairs(df, "c", "t", "r", "b").collect()}
    assert got == {"x": "KK", "y": "IK"}
