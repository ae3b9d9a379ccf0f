"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words: space and the control characters 9 to 13.
SPACES = "\t\n\x0b\x0c\r "
#: Java and DuckDB regular expression for one word.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPLIT_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only on a local master,
    as in tests, a temporary folder may take its place; elsewhere a missing
    setting is an error, as no other machine could read such a folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kerbside-"))
        found = context.getCheckpointDir()
    return found


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``df``, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def split_join(left: DataFrame, right: DataFrame, key: str, weight: str = "_rows", how: str = "inner", shares: int = 1000) -> DataFrame:
    """``left`` joined to ``right``, which has one row per ``key`` and, in
    ``weight``, how many rows of ``left`` have it; the weight is dropped.

    Keys with more than one in ``shares`` of all those rows are ``shares`` at
    most, whatever the input, so they are broadcast and their rows stay where
    they are; only the others are dealt by key.  Both tables are read twice and
    should be stored.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // shares, 1)
    heavy = F.broadcast(right.where(F.col(weight) > limit).drop(weight))
    light = right.where(F.col(weight) <= limit).drop(weight)
    # a row of left without its key in right is no heavy one
    rest = left.join(heavy.select(key), key, "left_anti").join(light, key, how)
    return left.join(heavy, key).unionByName(rest)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a reliable checkpoint and cut its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Later steps read only the columns they need, and a lost executor costs a
    reread instead of a recomputation.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/{app}-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` has written, where no plan still to be run reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
