"""From raw documents to training shards, as five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import decontamination, mixing, near_dup, sharding, toxicity
from kerbside.llm._common import free_names, own, stored, table
from kerbside.llm.queries import WEIGHTS, domain


def _kept_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names, which an operator would replace, under free names, and the way back."""
    taken = [c for c in docs.columns if c.lower() in names]
    away = dict(zip(taken, free_names(docs, *[f"_own_{c}" for c in taken]), strict=True))
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.5 or more; the model learns from ``labels``.

    The score depends on the text alone: null and empty texts score as texts
    without a hit and stay, long texts are read whole, repeated rows fare alike,
    rows without a key are judged like others (and teach nothing).  A score of
    exactly 0.5 goes.  Every column comes back as it was, also one that is
    called ``toxicity``.  An empty table gives an empty one, by the seed list.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    aside, back = _kept_aside(docs, "toxicity", "toxic_hits")
    return toxicity.score_toxicity(aside, model).where("toxicity < 0.5").drop("toxicity", "toxic_hits").withColumnsRenamed(back).select(*own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group linked by five-word shingles at 0.8: the smallest key.

    Null, empty and wordless texts are linked with nothing and stay, one row per
    key; repeated rows stay once; of rows that share a key the text with the
    smallest hash stays; rows without a key stay once per text unless a key is
    linked to them.  Long texts are compared whole.  All columns come back as
    they were; an empty table gives an empty one.
    """
    return near_dup.drop_near_duplicates(docs, shingle=5, percent=80).select(*own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 0.8 of the five-word shingles of a benchmark item, or more.

    Null and empty texts hold nothing and stay; long texts are searched whole;
    repeated rows fare alike; keys are not looked at.  Items that are null or
    empty, and an empty benchmark, drop nothing.  All columns come back as they
    were, also one that is called ``contained``; an empty table gives an empty one.
    """
    aside, back = _kept_aside(docs, "contained")
    found = decontamination.find_items(aside, table(spark, sf_dir, "benchmark"), shingle=5, percent=80)
    return found.where(F.size("contained") == 0).drop("contained").withColumnsRenamed(back).select(*own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of a mixture of 0.8 of the tokens, each at most once.

    A null language or source is ``unknown``.  Null and empty texts have no
    tokens: they come along where the prefix of their leaf goes past them.  Rows
    equal in key and text are taken together; ties in the seeded order go by key
    and text.  Long texts count whole.  All columns come back as they were; an
    empty table gives an empty one.
    """
    return mixing.mixed_documents(docs, mixing.MixTree(WEIGHTS), domain(), share=0.8).select(*own(docs))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``shard`` (0 to 7) and ``grown_shard`` (0 to 8), by the key alone.

    Every row stays.  Rows with one key share a shard, rows without a key go
    where the empty key goes; ties go to the higher shard.  Texts are not looked
    at.  Columns of these two names are replaced, all others come back as they
    were; an empty table gives an empty one.
    """
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Toxicity learns and folds in ways that SQL does not have; a test compares the rows of run() with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
