"""A catalogue of sources to fetch, chosen by name, smallest first."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.sources import fetch


@dataclass(frozen=True)
class Source:
    name: str
    url: str
    folder: str  # of its parts
    size: int  # bytes
    note: str = ""
    chunk: int = 32 << 20

    def line(self) -> str:
        return f"{self.name}  {self.size / 1e6:.1f} MB  {self.folder}  {self.note}".rstrip()


def catalogue(tree: Mapping[str, Mapping[str, Any]]) -> list[Source]:
    """The sources of a tree from name to url, folder, size and, if given, note and chunk: smallest first, then by name,
    so that a slow link soon has something whole."""
    return sorted((Source(name, **values) for name, values in tree.items()), key=lambda s: (s.size, s.name))


def selected(known: Iterable[Source], names: Iterable[str] = (), everything: bool = False) -> list[Source]:
    """The named ones in the catalogue's order; an unknown name, or none at all, is an error."""
    known, names = list(known), set(names)
    if strange := names - {s.name for s in known}:
        raise ValueError(f"not in the catalogue: {sorted(strange)}")
    if not (names or everything):
        raise ValueError("name a source, or take all")
    return [s for s in known if everything or s.name in names]


def obtain(spark: SparkSession, sources: Iterable[Source], get: Callable[..., bytes] = fetch.http_get, tries: int = 8, longest_wait: float = 20.0) -> DataFrame:
    """(name, chunks, done) of every source up to the first that stays incomplete, which is the last row.

    A source is fetched by ranges on the executors, into one file a range;
    parts that are there in full are not fetched again, so calling it again resumes.
    """
    rows = []
    for source in sources:
        ranges = fetch.byte_ranges(spark, source.size, source.chunk)
        got = fetch.fetch_ranges(ranges, source.url, source.folder, tries, longest_wait, get).agg(F.count("*"), F.count_if("done")).first()
        rows.append((source.name, *got))
        if got[0] != got[1]:
            break
    return spark.createDataFrame(rows, "name string, chunks bigint, done bigint")
