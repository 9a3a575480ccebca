"""Growing capture files as a stream.

``spark.readStream.format("captures").option("path", folder)`` follows every capture below a folder. The
offset holds, per file, the byte up to which its record chain is complete, how many packets that is, and the
interfaces of the pcapng section it stands in; so half a written record is left until the rest of it is there,
and a batch that is run again reads the same bytes. Headers are hopped over to find the end of the
chain; the frames are read by the tasks, in pieces of ``split_bytes``.

Files are numbered in the order they are first seen, those of one look by name. Damaged bytes are stepped over
once a chain of records is found behind them (``capture.capture_faults`` lists them in a stored file).
Files that are no captures, or too short to tell, are looked at again each time.

Spark does not tell a restarted source where it stood, so each offset is also kept in the folder ``cursors``
before it is handed out: file numbers stay, and old bytes are not hopped over again. A large backlog belongs to ``capture.ingest``, which reads its files in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ethersense.session import configure
from ethersense.sources import capture

SPLIT_BYTES = 32 << 20


def _filesystem(path: str):
    from pyarrow import fs

    bare = path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path
    return (fs.LocalFileSystem(), bare) if bare.startswith("/") else fs.FileSystem.from_uri(bare)


def _captures(path: str) -> list[tuple[str, int]]:
    """Name and size of every capture below ``path``, by name."""
    import re

    from pyarrow import fs

    filesystem, inner = _filesystem(path)
    found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    files = [(prefix + f.path, f.size) for f in found if f.is_file and re.search(capture.SUFFIX_PATTERN, f.path)]
    return sorted(files, key=lambda f: f[0].split("/"))


@dataclass
class Piece(InputPartition):
    """Linked records of one file in ``[first, stop)``."""

    name: str
    ordinal: int
    index: int
    first: int
    stop: int
    links: list


def follow(name: str, ordinal: int, state: dict | None, length: int, split_bytes: int) -> tuple[dict | None, list[Piece]]:
    """How far the chain of one file is complete within its first ``length`` bytes, and the pieces up to there."""
    with capture._open(name) as handle:
        fmt = capture._sniff(handle)
        if fmt is None:
            return state, []
        at, index, links = fmt.start, 0, []
        if state is not None:
            at, index, links = state["at"], state["packets"], [tuple(x) for x in json.loads(state["links"])]
        pieces, piece = [], Piece(name, ordinal, index, at, at, list(links))

        def close(next_at: int) -> Piece:
            if piece.stop > piece.first:
                pieces.append(piece)
            return Piece(name, ordinal, index, next_at, next_at, list(links))

        import struct

        while True:
            for begin, buf, pos, size, is_packet in capture._records(handle, at, length, length, fmt):
                if begin - piece.first >= split_bytes:
                    piece = close(begin)
                if fmt.pcapng:
                    kind = struct.unpack_from(fmt.order + "I", buf, pos)[0]
                    if kind == capture.NG_SECTION:
                        links = []
                    elif kind == capture.NG_INTERFACE:
                        links.append(capture._interface(buf, pos, size, fmt.order))
                index += is_packet
                at = piece.stop = begin + size
            head = handle.read_at(min(16, length - at), at)
            least = 8 if fmt.pcapng else 16
            if len(head) < least or capture._record(head, 0, fmt, guess=True) is not None:
                break  # the rest of this record is not there yet
            found = capture._first_record(handle, at + 1, length, length, fmt, growing=True)
            if found is None:
                break
            at = found
            piece = close(found)
        close(at)
        return {"ordinal": ordinal, "at": at, "packets": index, "links": json.dumps(links)}, pieces


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.cursors = options["cursors"]
        self.latest: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.latest is None:
            self.latest = self._stored()
        seen = dict(self.latest)
        for name, size in _captures(self.path):
            state = seen.get(name)
            if state is not None and state["at"] >= size:
                continue
            ordinal = state["ordinal"] if state is not None else len(seen)
            found, _pieces = follow(name, ordinal, state, size, self.split_bytes)
            if found is not None:
                seen[name] = found
        if seen != self.latest:
            self._store(seen)
            self.latest = seen
        return seen

    def partitions(self, start: dict, end: dict) -> Sequence[Piece]:
        pieces: list[Piece] = []
        for name, state in sorted(end.items(), key=lambda f: f[1]["ordinal"]):
            before = start.get(name)
            if before is None or before["at"] < state["at"]:
                pieces += follow(name, state["ordinal"], before, state["at"], self.split_bytes)[1]
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with capture._open(partition.name) as handle:
            fmt = capture._sniff(handle)
            links = [tuple(x) for x in partition.links]
            for row in capture.frames_between(
                handle, partition.name, partition.ordinal, partition.index, partition.first, partition.stop, partition.stop, fmt, links
            ):
                rows.append(row)
                if len(rows) == capture.BATCH:
                    yield capture._batch(rows)
                    rows = []
        if rows:
            yield capture._batch(rows)

    def _kept(self) -> tuple:
        from pyarrow import fs

        filesystem, inner = _filesystem(self.cursors)
        found = filesystem.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return filesystem, inner, sorted(f.path for f in found if f.path.endswith(".json"))

    def _store(self, offset: dict) -> None:
        filesystem, inner, names = self._kept()
        number = int(names[-1].rsplit("/", 1)[1][:-5]) + 1 if names else 0
        filesystem.create_dir(inner, recursive=True)
        with filesystem.open_output_stream(f"{inner}/{number:020d}.json") as out:
            out.write(json.dumps(offset).encode())
        for name in names[:-1]:
            filesystem.delete_file(name)

    def _stored(self) -> dict:
        filesystem, _inner, names = self._kept()
        for name in reversed(names):  # the last one may be half written
            with filesystem.open_input_stream(name) as source:
                try:
                    return json.loads(source.read())
                except ValueError:
                    continue
        return {}


def _source(archive: str) -> type[DataSource]:
    """The data source class. Spark plans a stream in a Python process of its own on the driver, which does not
    have the files shipped to the executors; being local, the class is pickled whole and brings the package along."""

    class CaptureSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "captures"

        def schema(self) -> str:
            return (
                "file_ordinal int, source_file string, packet_index long, timestamp double, "
                "original_len int, linktype int, frame binary"
            )

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            import sys

            if archive not in sys.path:
                sys.path.append(archive)
            from ethersense.sources.live import CaptureStreamReader

            return CaptureStreamReader(dict(self.options))

    return CaptureSource


def capture_stream(spark: SparkSession, path: str, cursors: str, **options: str) -> DataFrame:
    """Raw frames of growing captures, for ``frames.decode`` and what follows it.

    ``cursors`` is a folder of this stream alone that a restart can reach."""
    configure(spark)
    spark.dataSource.register(_source(spark.sparkContext._ethersense_shipped))
    reader = spark.readStream.format("captures").option("path", path).option("cursors", cursors)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
