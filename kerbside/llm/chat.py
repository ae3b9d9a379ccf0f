"""Multi-party perspective rotation of dialogues, in built-in expressions only.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant and everybody else as a named user; the mask
marks the assistant's words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _escaped(text: Column) -> Column:
    """Text in which no marker of the template can appear."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(speaker: Column, perspective: Column, system: Sequence[str]) -> Column:
    named = F.concat(F.lit("<|user name="), F.replace(speaker, F.lit("|>"), F.lit("| >")), F.lit("|>\n"))
    out = F.when(speaker == perspective, F.lit("<|assistant|>\n")).otherwise(named)
    return F.when(speaker.isin(*system), F.lit("<|system|>\n")).otherwise(out) if system else out


#: Messages of a dialogue that are walked at once: the list of spans is copied per message inside a block, and per block outside.
BLOCK = 1024
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def _state(at: Column, spans: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), spans.cast(_SPANS).alias("spans"))


def _mask(pieces: Column) -> Column:
    """The spans of the targets' bodies in the joined pieces (head, body, target)."""
    nothing = _state(F.lit(0), F.array())

    def step(a: Column, p: Column) -> Column:
        start = (a["at"] + F.length(p["head"])).cast("long")
        end = (start + F.length(p["body"])).cast("long")
        more = F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return _state(end, F.when(p["target"], more).otherwise(a["spans"]))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / F.lit(BLOCK)).cast("int")),
        lambda b: F.aggregate(F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)), nothing, step),
    )
    return F.aggregate(blocks, nothing, lambda a, b: _state(a["at"] + b["at"], F.concat(a["spans"], _moved(b["spans"], a["at"]))))["spans"]


def rotate_perspectives(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: Sequence[str] = ("system",),
) -> DataFrame:
    """One row per conversation and participant.

    Columns: the conversation's key, ``perspective``, ``n_messages``,
    ``rendered``, ``mask_spans`` (array of start and end, code points, end
    excluded: the assistant's text and its end marker), ``target_chars``.  Other
    columns of ``df`` are ignored, whatever their names.

    A dialogue is rendered whole, however long; as each result holds all of it,
    one task reads a dialogue, and Spark's limit of 2 GB for a value holds.
    Messages are ordered by turn, speaker and text; ties are equal in all three,
    and repeated rows stay.  A null turn sorts first; a null speaker is
    ``unknown``; a null text is empty; long texts stay whole.  Each row without a conversation key is a dialogue of
    its own, with a null key, and equal ones share one.  ``system`` speakers are context: they have no
    perspective, and a dialogue with no other speaker gives no row.  An empty
    table gives an empty table.
    """
    rows = df.select(
        F.col(conversation).alias("_conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        _escaped(F.col(text)).alias("text"),
    ).withColumn("_lone", F.when(F.col("_conv").isNull(), F.xxhash64("turn", "speaker", "text")).otherwise(F.lit(0)))
    parts = rows.groupBy("_conv", "_lone").agg(
        F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("_messages"),
        F.collect_set(F.when(~F.col("speaker").isin(*system), F.col("speaker")) if system else F.col("speaker")).alias("_people"),
    )
    perspective = F.col("perspective")
    pieces = F.transform(
        "_messages",
        lambda m: F.struct(
            _head(m["speaker"], perspective, system).alias("head"),
            F.concat(m["text"], F.lit(END)).alias("body"),
            ((m["speaker"] == perspective) & ~m["speaker"].isin(*system) if system else m["speaker"] == perspective).alias("target"),
        ),
    )
    rendered = parts.withColumn("perspective", F.explode("_people")).withColumn("_pieces", pieces)
    return rendered.select(
        F.col("_conv").alias(conversation),
        "perspective",
        F.size("_messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        _mask(F.col("_pieces")).alias("mask_spans"),
    ).withColumn(
        "target_chars",
        F.aggregate("mask_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]),
    )
