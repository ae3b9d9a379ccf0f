"""Conversation structure repair: the cheapest edits that leave ``(system)? (user assistant)+`` or nothing.

A dynamic programme with four states runs over the turns of many conversations
at once: conversations are bucketed by length, a turn of a bucket is one numpy
step for all of them, the costs of finishing are stored per turn from the last
to the first, and the edits are traced from the first to the last, again one
step a turn for the whole bucket.

Costs: Keep 0, Rerole 3, Delete 4 (the only edit for blank and repeated
messages), Insert 3; a truncated message that stays adds 3.  Of edits that cost
the same the ones whose initials come first in ASCII are taken.  A letter and a
state fix the next state, so the letters alone say what happens to each message.

Plans are made from rows without their texts (a digest stands for role and
text); texts are then read once, in order, and never held longer than a batch.
A conversation is edited by one task, which keeps some fifty bytes a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm._common import SPACES, WORD_RE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.  _FILL is where an inserted or reroled message leads.
_FILL = np.array([2, 2, 3, 2])
#: Where a kept message of kind system, user, assistant, other leads, by state; -1: it cannot be kept.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: What it costs to end in a state.
_END = np.array([0, 2 * INSERT, INSERT, 0])
_FAR = 1 << 40
#: Turns times conversations of one tensor.
TENSOR_CELLS = 1 << 19


def traced(kinds: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Costs and edit letters of the conversations in the columns of (turn, conversation) arrays."""
    turns, n = kinds.shape
    left = np.empty((turns + 1, 4, n), np.int64)
    left[turns] = _END[:, None]
    lanes = np.arange(n)
    for t in range(turns - 1, -1, -1):
        later, extra = left[t + 1], TRUNCATED * cut_off[t]
        to = _KEPT[:, kinds[t]]
        kept = np.where(to >= 0, later[to, lanes] + KEEP + extra, _FAR)
        here = np.where(must_go[t], _FAR, np.minimum(kept, later[_FILL] + REROLE + extra))
        here = np.minimum(here, later + DELETE)
        here = np.minimum(here, np.minimum(here[_FILL] + INSERT, here[_FILL[_FILL]] + 2 * INSERT))
        left[t] = np.where(t < lengths, here, later)
    state, letters = np.zeros(n, np.int64), np.zeros((3 * turns + 2, n), np.uint8)
    for t in range(turns):
        open_ = t < lengths
        later, extra = left[t + 1], TRUNCATED * cut_off[t]
        for k in range(3):
            cost = left[t, state, lanes]
            to = _KEPT[state, kinds[t]]
            delete = open_ & (later[state, lanes] + DELETE == cost)
            insert = open_ & ~delete & (left[t, _FILL[state], lanes] + INSERT == cost)
            stays = open_ & ~delete & ~insert
            keep = stays & (to >= 0) & (later[to, lanes] + KEEP + extra == cost) & ~must_go[t]
            letters[3 * t + k] = np.select([delete, insert, keep, stays], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            state = np.where(keep, to, np.where(insert | stays, _FILL[state], state))
            open_ = insert
            if not open_.any():
                break
    for k in range(2):
        more = _END[state] > 0
        letters[3 * turns + k] = np.where(more, ord("I"), 0)
        state = np.where(more, _FILL[state], state)
    flat = letters.T
    text, ends = flat[flat > 0].tobytes().decode("ascii"), np.concatenate([[0], np.cumsum((flat > 0).sum(1))])
    return left[0, 0], [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def cheapest_edits(kinds: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Costs and letters of conversations that lie one after the other, from ``starts``; bucketed by powers of two of their lengths."""
    lengths = np.diff(np.append(starts, len(kinds)))
    cost, audit = np.zeros(len(starts), np.int64), [""] * len(starts)
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for bucket in np.unique(size):
        of = np.flatnonzero(size == bucket)
        turns = int(lengths[of].max())
        each = max(TENSOR_CELLS // turns, 1)
        for some in (of[i : i + each] for i in range(0, len(of), each)):
            at = np.minimum(starts[some] + np.arange(turns)[:, None], len(kinds) - 1)
            cost[some], found = traced(kinds[at], must_go[at], cut_off[at], lengths[some])
            for i, letters in zip(some, found, strict=True):
                audit[i] = letters
    return cost, audit


def _digest(role: str, text: str) -> Column:
    """16 bytes for role and text; rows that share a turn are taken in this order."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary")))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    out = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *filled)
    # the key as text, so that a null key is a conversation like others
    return out.withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), "digest": _digest("role", "text")})


def _whole(batches: Iterator) -> Iterator:
    """Tables of whole conversations, from batches in which they lie one after the other."""
    import pyarrow as pa
    import pyarrow.compute as pc

    waiting: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key")
        change = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1
        if waiting and waiting[-1].column("key")[-1].as_py() != key[0].as_py():
            change = np.concatenate([[0], change])
        if len(change):
            last = int(change[-1])
            if waiting or last:
                yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
            batch = batch.slice(last)
        waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _planned(table):
    """One row per conversation of a table of whole conversations in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.combine_chunks()
    n, key = len(table), table["key"]
    starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy()) + 1]).astype(np.int64)
    of = np.zeros(n, np.int64)
    of[starts[1:]] = 1
    of = np.cumsum(of)
    count = lambda mask: np.bincount(of[mask], minlength=len(starts)).astype(np.int64)
    kinds, blank, cut_off = (table[c].to_numpy() for c in ("kind", "blank", "cut_off"))
    halves = np.frombuffer(b"".join(table["digest"].to_pylist()), np.int64).reshape(n, 2)
    order = np.lexsort((np.arange(n), halves[:, 1], halves[:, 0], of))
    same = (np.diff(of[order]) == 0) & (np.diff(halves[order], axis=0) == 0).all(1)
    seen = np.zeros(n, bool)
    seen[order[1:][same]] = True
    duplicate = seen & ~blank
    truncated = cut_off & ~blank & ~duplicate
    pair = kinds[:-1] * 4 + kinds[1:]
    legal = np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    illegal = np.flatnonzero(~legal & (np.diff(of) == 0))
    # turns are in order, those that are null come first
    known = np.flatnonzero(pc.is_valid(table["turn"]).to_numpy())
    turn, whose = table["turn"].fill_null(0).to_numpy()[known], of[known]
    gaps = np.zeros(len(starts), np.int64)
    if len(known):
        first = np.concatenate([[True], np.diff(whose) > 0])
        last = np.concatenate([first[1:], [True]])
        new = first | np.concatenate([[False], np.diff(turn) != 0])
        gaps[whose[first]] = turn[last] - turn[first] + 1 - np.bincount(whose[new], minlength=len(starts))[whose[first]]
    cost, audit = cheapest_edits(kinds, blank | duplicate, truncated, starts)
    made = {"conv": table["conv"].take(pa.array(starts)), "gaps": gaps, "blank": count(blank), "duplicate": count(duplicate), "truncated": count(truncated)}
    return made | {"illegal": np.bincount(of[illegal], minlength=len(starts)).astype(np.int64), "cost": cost, "audit": pa.array(audit, pa.string())}


def plan_repairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the key, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``, the letters of its edits.

    Messages are taken by turn, null turns first, and those that share a turn by
    a digest of role and text.  Null roles and texts count as one space.  The
    first fault of a message counts: blank (nothing but spaces), duplicate (role
    and text were there before), truncated (its last character that is no space
    is none of ``.!?``).  ``gaps`` are the numbers missing between the first and
    the last turn, ``illegal`` the neighbours whose initials are not su, ua or au.
    A message counts as system, user or assistant by the first letter of its
    role; any other, an empty role too, can only be reroled or deleted.
    Null keys are one conversation; repeated rows are duplicates; other columns
    are not looked at, whatever their names; an empty table gives an empty one.
    """
    import pyarrow as pa

    rows = _rows(df, conv, turn, role, text)
    spaces = F.lit(SPACES)
    light = rows.select(
        "key", "conv", "turn", "digest",
        F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3).cast("long").alias("kind"),
        (~F.col("text").rlike(WORD_RE)).alias("blank"),
        (~F.substring(F.rtrim("text", spaces), -1, 1).isin(".", "!", "?")).alias("cut_off"),
    )
    light = light.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "digest")
    kind = light.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def plan(batches: Iterator) -> Iterator:
        for table in _whole(batches):
            made = pa.table(_planned(table))
            yield from made.to_batches()

    return light.mapInArrow(plan, schema).withColumnRenamed("conv", conv)


def apply_repairs(
    df: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", audit: str = "audit"
) -> DataFrame:
    """The messages of the repaired conversations: key, ``place`` (from 0), ``role``, ``text``.

    ``plans`` are those that ``plan_repairs`` made of the same rows.  The
    messages of a conversation lie together in one partition, in order.  A
    conversation of which nothing is left, or without a plan, gives no row.
    """
    import pyarrow as pa

    rows = _rows(df, conv, turn, role, text).select("key", "conv", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    heads = plans.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("")).alias("key"), F.col(f"`{conv}`").alias("conv"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.col(audit).alias("text"),
    )
    # the letters of a conversation come just before its messages
    both = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "digest")
    names = {1: "assistant", 0: "user"}

    def edit(batches: Iterator) -> Iterator:
        key, whose, letters, at, state, place = None, None, "", 0, 0, 0
        out: tuple[list, list, list, list] = ([], [], [], [])

        def put(speaker: str, said: str) -> None:
            nonlocal place
            for column, value in zip(out, (whose, place, speaker, said), strict=True):
                column.append(value)
            place += 1

        def filled(said: str) -> None:
            nonlocal state
            put(names[int(state == 2)], said)
            state = int(_FILL[state])

        def inserted() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                at += 1
                filled("")

        def drained():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (conv_type, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "place", "role", "text"])
            for column in out:
                column.clear()
            return made

        conv_type = None
        for batch in batches:
            conv_type = batch.column("conv").type
            held = 0
            for k, c, kind, who, said in zip(*(batch.column(n).to_pylist() for n in ("key", "conv", "kind", "role", "text")), strict=True):
                if kind == 0 or k != key:
                    inserted()
                    key, whose, letters, at, state, place = k, c, said if kind == 0 else "", 0, 0, 0
                    if kind == 0:
                        continue
                inserted()
                letter = letters[at : at + 1]
                at += 1
                if letter == "K":
                    put(who, said)
                    state = int(_KEPT[state, {"s": 0, "u": 1, "a": 2}[who[0]]])
                elif letter == "R":
                    filled(said)
                held += len(said)
                if held > 1 << 24:
                    yield drained()
                    held = 0
            yield drained()
        if conv_type is not None:
            inserted()
            yield drained()

    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, place long, role string, text string"
    return both.mapInArrow(edit, schema).withColumnRenamed("conv", conv)


def repaired_digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Key and SHA-256 of ``role:text``, newline-joined, of each conversation that ``apply_repairs`` returned, read in its order without another shuffle."""
    import hashlib

    import pyarrow as pa

    def digest(batches: Iterator) -> Iterator:
        whose, running, conv_type = None, None, None
        for batch in batches:
            conv_type = batch.column(conv).type
            keys, digests = [], []
            for k, place, who, said in zip(*(batch.column(n).to_pylist() for n in (conv, "place", "role", "text")), strict=True):
                if place == 0:
                    if running is not None:
                        keys.append(whose)
                        digests.append(running.hexdigest())
                    whose, running = k, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{who}:{said}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, conv_type), pa.array(digests, pa.string())], names=[conv, "sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whose], conv_type), pa.array([running.hexdigest()], pa.string())], names=[conv, "sha256"])

    return repaired.select(f"`{conv}`", "place", "role", "text").mapInArrow(digest, f"`{conv}` {repaired.schema[conv].dataType.simpleString()}, sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the faults of the contract: by crc32 of ``conv_id:turn`` modulo 20, 0 drops
    a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("_fault")
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")


def repair_report(df: DataFrame) -> DataFrame:
    """The contract's row for every conversation of ``conversations`` after ``damaged``; those without rows after it have zeros, no letters and the digest of nothing."""
    rows = damaged(df)
    plans = plan_repairs(rows)
    digests = repaired_digests(apply_repairs(rows, plans)).withColumnRenamed("conv_id", "_c")
    everyone = df.select(F.col("conv_id").alias("_all")).distinct()
    out = everyone.join(plans, F.col("_all").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("_all").eqNullSafe(F.col("_c")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_all").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
