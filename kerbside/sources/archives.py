"""Frames in zip archives and folders as a Spark data source, for batch and streaming reads.

    spark.dataSource.register(FrameSource)
    spark.read.format("kerbside_frames").option("suffix", ".jpg").load(path)

An archive that is larger than a partition is read by several tasks, each a range
of its members by the sizes in its directory; smaller ones and single files are
read by a task each or together, and their directories are not looked at while
planning.  Bytes of members are read only where the schema has ``content``.

A stream takes files in the order of (modification time, path) and its offset is
the last one taken, so files have to be moved in whole and not with an older time
than what is there.  Paths may name any store that pyarrow reads.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

COLUMNS = "archive string, ordinal bigint, member string, size bigint, content binary"
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
#: Files that a partition opens at most; each weighs as much, besides its size.
FILES_A_PARTITION = 4096


def store(path: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Members ``first`` to ``last`` (all, if that is None) of the files."""

    files: list
    first: int = 0
    last: int | None = None


@dataclass(frozen=True)
class _Place:
    path: str
    suffix: str
    partition_bytes: int
    names: tuple[str, ...]

    @classmethod
    def of(cls, options: dict, schema: StructType) -> _Place:
        return cls(options["path"], options.get("suffix", "").lower(), int(options.get("partitionBytes", PARTITION_BYTES)), tuple(schema.names))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time, path, size) of archives and of files with the suffix, in the order in which a stream takes them."""
        from pyarrow import fs

        system, path = store(self.path)
        found = system.get_file_info(path)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = [i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
        return sorted((i.mtime_ns or 0, i.path, i.size) for i in files if i.path.lower().endswith((".zip", self.suffix)))

    def pieces(self, files: list[tuple[int, str, int]]) -> list[Piece]:
        out, together, held = [], [], 0
        for _, path, size in files:
            if path.lower().endswith(".zip") and size > self.partition_bytes:
                out += self._ranges(path)
                continue
            cost = size + self.partition_bytes // FILES_A_PARTITION
            if together and held + cost > self.partition_bytes:
                out.append(Piece(together))
                together, held = [], 0
            together.append(path)
            held += cost
        return [*out, Piece(together)] if together else out

    def _ranges(self, path: str) -> list[Piece]:
        """Ranges of members of a large archive with about the same bytes each."""
        out, first, held = [], 0, 0
        with store(self.path)[0].open_input_file(path) as f, zipfile.ZipFile(f) as z:
            sizes = [i.compress_size for i in z.infolist()]
        for n, size in enumerate(sizes):
            if n > first and held + size > self.partition_bytes:
                out.append(Piece([path], first, n))
                first, held = n, 0
            held += size
        return [*out, Piece([path], first, len(sizes))]

    def batches(self, piece: Piece) -> Iterator:
        import pyarrow as pa

        kinds = {"archive": pa.string(), "ordinal": pa.int64(), "member": pa.string(), "size": pa.int64(), "content": pa.binary()}
        held, size = [], 0
        for row in self._rows(piece):
            held.append([row[n] for n in self.names])
            size += len(row.get("content") or b"") + 100
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*held, strict=True), self.names, strict=True)], names=list(self.names))
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*held, strict=True), self.names, strict=True)], names=list(self.names))

    def _rows(self, piece: Piece) -> Iterator[dict]:
        system, wants = store(self.path)[0], "content" in self.names
        for path in piece.files:
            with system.open_input_file(path) as f:
                if not path.lower().endswith(".zip"):
                    yield {"archive": None, "ordinal": 0, "member": path, "size": f.size(), "content": f.read() if wants else None}
                    continue
                with zipfile.ZipFile(f) as z:
                    for n, info in list(enumerate(z.infolist()))[piece.first : piece.last]:
                        if not info.is_dir() and info.filename.lower().endswith(self.suffix):
                            yield {"archive": path, "ordinal": n, "member": info.filename.lstrip("/"), "size": info.file_size, "content": z.read(info) if wants else None}


class FrameReader(DataSourceReader):
    def __init__(self, place: _Place):
        self.place = place

    def partitions(self) -> list[Piece]:
        if not (files := self.place.listed()):
            raise FileNotFoundError(f"no archive and no {self.place.suffix or 'file'} in {self.place.path}")
        return self.place.pieces(files)

    def read(self, partition: Piece) -> Iterator:
        return self.place.batches(partition)


class FrameStream(DataSourceStreamReader):
    def __init__(self, place: _Place):
        self.place = place

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self, *_) -> dict:
        files = self.place.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        at = lambda o: (o["time"], o["path"])
        return self.place.pieces([f for f in self.place.listed() if at(start) < f[:2] <= at(end)]) or [Piece([])]

    def read(self, partition: Piece) -> Iterator:
        return self.place.batches(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing to release; offsets are plain


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kerbside_frames"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(_Place.of(self.options, schema))

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(_Place.of(self.options, schema))


def frames(spark: SparkSession, path: str, suffix: str = ".jpg", columns: str = COLUMNS, stream: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The frames under a path; ``columns`` is a schema with some of COLUMNS, and what it lacks is not read."""
    spark.dataSource.register(FrameSource)
    made = (spark.readStream if stream else spark.read).format(FrameSource.name()).schema(columns)
    return made.option("suffix", suffix).option("partitionBytes", partition_bytes).load(path)
