"""Collectors as Spark data sources: anything that hands out evidence in numbered drops, read in batch or as a stream.

A collector says which drops there are and reads one piece of a drop; it never touches stored tables.  ``register`` makes it a format
of ``spark.read`` and ``spark.readStream``.  Drops are told apart by name, in the order in which they came, so a stream's offset is
the name of the last drop it has read, and a restart goes on behind it.
"""

from __future__ import annotations

import io
import posixpath
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pitchlake.session import ship

# A piece of a drop, and the rows handed to Spark at once.
PIECE_BYTES = 64 << 20
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20
READ_BYTES = 1 << 20


# Pieces that one batch task reads, in bytes at most, once there are enough tasks for a cluster.
TASK_BYTES = 64 << 20
TASKS = 256


@dataclass(frozen=True)
class Piece(InputPartition):
    """A part of a drop that is read at once: the records that begin at ``start`` or later and before ``end``."""

    drop: str
    start: int
    end: int


@dataclass(frozen=True)
class Share(InputPartition):
    """The pieces of one batch task, read one after another."""

    pieces: tuple[Piece, ...]


def shares(pieces: list[Piece]) -> list[Share]:
    """The pieces in order, dealt to tasks by bytes: a task each while they are few, so that starting tasks does not grow with the pieces."""
    limit = min(TASK_BYTES, sum(p.end - p.start for p in pieces) // TASKS)
    found: list[list[Piece]] = []
    held = 0
    for piece in pieces:
        size = piece.end - piece.start
        if not found or held + size > limit:
            found.append([])
            held = 0
        found[-1].append(piece)
        held += size
    return [Share(tuple(own)) for own in found]


class Collector(ABC):
    """What a source of evidence has to say."""

    schema = "drop string, ordinal long, payload string"

    @abstractmethod
    def drops(self) -> list[str]:
        """Names of all drops that are complete, in the order in which they came; later drops sort behind."""

    @abstractmethod
    def pieces(self, drop: str) -> list[Piece]:
        """The pieces of a drop; each record belongs to exactly one."""

    @abstractmethod
    def collect(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The records of a piece: the drop, the place within it, the payload."""


class LandedFiles(Collector):
    """Files of lines (a JSON record each) that other programs put into a folder by renaming, with names that sort in order of arrival.

    The folder may be in any store that pyarrow opens.  Large files are cut into pieces at line ends.  Empty lines are no records, hidden
    files no drops; ``ordinal`` is the byte at which the line begins, so it is the same whatever the cut.
    """

    def __init__(self, path: str, suffix: str = ".json", piece_bytes: int = PIECE_BYTES) -> None:
        self.path, self.suffix, self.piece_bytes = path.rstrip("/"), suffix, piece_bytes

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def drops(self) -> list[str]:
        store, folder = self._open()
        found = store.get_file_info(fs.FileSelector(folder))
        names = (posixpath.basename(f.path) for f in found if f.type == fs.FileType.File)
        return sorted(n for n in names if n.endswith(self.suffix) and n[0] not in "._")

    def pieces(self, drop: str) -> list[Piece]:
        store, folder = self._open()
        size = store.get_file_info(f"{folder}/{drop}").size
        return [Piece(drop, at, min(size, at + self.piece_bytes)) for at in range(0, size, self.piece_bytes)]

    def _lines(self, piece: Piece) -> Iterator[tuple[int, bytes]]:
        store, folder = self._open()
        with store.open_input_file(f"{folder}/{piece.drop}") as file, io.BufferedReader(file, READ_BYTES) as lines:
            at = piece.start
            if at:
                # A line that begins right at the start is this piece's, so look for the end of the line before.
                lines.seek(at - 1)
                at += len(lines.readline()) - 1
            while at < piece.end:
                line = lines.readline()
                if not line:
                    return
                yield at, line
                at += len(line)

    def collect(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        places, payloads, held = [], [], 0
        for at, line in self._lines(piece):
            text = line.rstrip(b"\r\n")
            if not text.strip():
                continue
            places.append(at)
            payloads.append(text.decode())
            held += len(text)
            if len(places) == BATCH_ROWS or held >= BATCH_BYTES:
                yield self._batch(piece.drop, places, payloads)
                places, payloads, held = [], [], 0
        if places:
            yield self._batch(piece.drop, places, payloads)

    @staticmethod
    def _batch(drop: str, places: list[int], payloads: list[str]) -> pa.RecordBatch:
        columns = [pa.array([drop] * len(places)), pa.array(places, pa.int64()), pa.array(payloads)]
        return pa.RecordBatch.from_arrays(columns, ["drop", "ordinal", "payload"])


class _Reader(DataSourceReader):
    def __init__(self, collector: Collector) -> None:
        self.collector = collector

    def partitions(self) -> list[Share]:
        return shares([piece for drop in self.collector.drops() for piece in self.collector.pieces(drop)])

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        # Without any piece Spark asks once, for none.
        for piece in partition.pieces if partition else ():
            yield from self.collector.collect(piece)


class _StreamReader(DataSourceStreamReader):
    """Offsets are ``{"after": name of the last drop}``, the empty name before the first."""

    def __init__(self, collector: Collector) -> None:
        self.collector = collector

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        drops = self.collector.drops()
        return {"after": drops[-1] if drops else ""}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        new = [drop for drop in self.collector.drops() if start["after"] < drop <= end["after"]]
        return [piece for drop in new for piece in self.collector.pieces(drop)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.collector.collect(partition)

    def commit(self, end: dict) -> None:
        """Drops stay where they are: they are the evidence."""


def collector_source(name: str, build) -> type[DataSource]:
    """The data source ``name`` over the collector that ``build`` makes of the reader's options (keys in lower case)."""

    class CollectorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return build(self.options).schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(build(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(build(self.options))

    return CollectorSource


def _landed(options) -> LandedFiles:
    if "path" not in options:
        raise ValueError("landed files need a path")
    return LandedFiles(options["path"], options.get("suffix", ".json"), int(options.get("piece_bytes", PIECE_BYTES)))


def register(spark: SparkSession, name: str = "landed", build=_landed) -> str:
    """Make a collector a format of this session's readers; its default reads landed files (options path, suffix, piece_bytes)."""
    ship(spark)
    spark.dataSource.register(collector_source(name, build))
    return name
