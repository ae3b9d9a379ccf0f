"""Fetching files from the network on executors: cached, retried, in byte ranges."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def http_get(url: str, start: int | None = None, end: int | None = None) -> bytes:
    """The body behind a URL, or bytes ``start`` to ``end`` of it, both included."""
    from urllib.request import Request, urlopen

    span = {} if start is None else {"Range": f"bytes={start}-{end}"}
    with urlopen(Request(url, headers=span), timeout=30) as answer:
        return answer.read()


def _kept(path: Path, body: bytes) -> None:
    """Write under another name first, so that a lost executor leaves no half file."""
    import os
    import uuid

    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_bytes(body)
    os.replace(part, path)


def fetched(df: DataFrame, url: str, name: str, cache: str, tries: int = 4, get: Callable[..., bytes] = http_get) -> DataFrame:
    """(name, body) of every row; null where every try failed or gave nothing.

    ``cache`` is a folder that all executors share; a file there that is not
    empty is not fetched again.  Names with a parent folder step are refused.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for address, file in zip(pdf["_url"], pdf["_name"], strict=True):
                if file is None or ".." in Path(file).parts or Path(file).is_absolute():
                    raise ValueError(f"not a name inside the cache: {file!r}")
                path, body = Path(cache) / file, None
                if path.exists() and path.stat().st_size:
                    body = path.read_bytes()
                for _ in range(0 if body else tries):
                    try:
                        body = get(address) or None
                    except OSError:
                        continue
                    if body:
                        _kept(path, body)
                        break
                yield pd.DataFrame({"name": [file], "body": pd.Series([body], dtype=object)})

    return df.select(F.col(url).alias("_url"), F.col(name).alias("_name")).mapInPandas(run, "name string, body binary")


def byte_ranges(spark: SparkSession, total: int, chunk: int = 32 << 20, done: DataFrame | None = None) -> DataFrame:
    """(chunk, start, end) that cover ``total`` bytes, without the chunks in ``done``; the end is included."""
    rows = spark.range(-(-total // chunk)).select(F.col("id").alias("chunk"), (F.col("id") * chunk).alias("start"))
    rows = rows.withColumn("end", F.least(F.col("start") + chunk, F.lit(total)) - 1)
    return rows if done is None else rows.join(done.select("chunk"), "chunk", "left_anti")


def fetch_ranges(ranges: DataFrame, url: str, parts: str, tries: int = 8, longest_wait: float = 20.0, get: Callable[..., bytes] = http_get) -> DataFrame:
    """(chunk, done) after writing every range to ``parts``/chunk; waits double up to ``longest_wait`` seconds between tries.

    A short answer counts as a failure.  Chunks that are there in full are not
    fetched again, so a second run resumes.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for number, start, end in zip(pdf["chunk"], pdf["start"], pdf["end"], strict=True):
                path, size = Path(parts) / f"{number:08d}", end - start + 1
                done = path.exists() and path.stat().st_size == size
                for attempt in range(0 if done else tries):
                    try:
                        body = get(url, int(start), int(end))
                        if len(body) == size:
                            _kept(path, body)
                            done = True
                            break
                    except OSError:
                        pass
                    time.sleep(min(2.0**attempt, longest_wait))
                yield pd.DataFrame({"chunk": [number], "done": [done]})

    return ranges.mapInPandas(run, "chunk bigint, done boolean")
