"""Rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key, and the key goes to the shard with the highest
score ``-weight / ln(u)``, where ``u`` in (0, 1) comes from a hash of key and
shard.  A new shard changes no existing score, so it only takes rows into
itself, and a removed shard only gives its own rows away.  All expressions are
built in; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash values are the first 13 hexadecimal digits of an MD5, 52 bits.
_SPAN = float(1 << 52)


def unit_hash(key: Column) -> Column:
    """A double in (0, 1) that depends on the string ``key`` alone."""
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(_SPAN)


def rendezvous_shard(key: Column, weights: Sequence[float] | Mapping[int, float]) -> Column:
    """Shard number for the string ``key``; a weight of 0 or less takes no rows.

    Ties go to the higher shard number.  A null key counts as the empty string.
    """
    items = weights.items() if isinstance(weights, Mapping) else enumerate(weights)
    live = [(int(i), float(w)) for i, w in items if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    base = F.coalesce(key, F.lit(""))
    scored = [
        F.struct(
            (F.lit(-w) / F.ln(unit_hash(F.concat(base, F.lit(f":{i}"))))).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in live
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return best["shard"].cast("int")


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 8,
    grown_weights: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``shard`` and, for one more shard, ``grown_shard``; keep all columns.

    Columns of ``df`` with these names are replaced.  An empty table gives an
    empty table.  Rows that share a key share a shard; rows without a key go
    where the empty key goes.
    """
    grown = tuple(grown_weights) if grown_weights is not None else (*weights, 1.0)
    name = F.col(key).cast("string")
    return df.withColumns(
        {"shard": rendezvous_shard(name, weights), "grown_shard": rendezvous_shard(name, grown)}
    )


def shard_plan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * 8,
    grown_weights: Sequence[float] | None = None,
    blocks: int = 512,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of
    (hash block, key, checksum, size).  A shard is cut into ``blocks`` hash
    blocks by key and checksum, so that the rows of one key are spread too: rows
    are numbered inside a block, and a block starts at the number
    of rows in the blocks before it, so no task sorts a whole shard.  The
    table of block starts has at most shards x blocks rows, whatever the
    input, and so can be broadcast.  Only key, size and checksum are shuffled.

    A null text has size 1 and checksum 0, like an empty one.  Rows that are
    equal in key, size and checksum get distinct neighbouring slots.  Other
    columns of ``df`` are ignored; an empty table gives an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = assign_shards(
        df.select(
            F.col(key).alias(key),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ),
        key,
        weights=weights,
        grown_weights=grown_weights,
    ).withColumn("_block", F.floor(unit_hash(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))) * blocks).cast("int"))
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    starts = counts.select(
        "shard",
        "_block",
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_start"),
    )
    inside = Window.partitionBy("shard", "_block").orderBy(key, "text_crc32", "size")
    return (
        rows.join(F.broadcast(starts), ["shard", "_block"])
        .withColumn("_place", F.row_number().over(inside).cast("long"))
        .select(
            key,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_start") + F.col("_place") - 1).alias("slot"),
            "grown_shard",
        )
    )
