"""Raw log files of any size as a data source: byte ranges of a file are read side by side, and growing files are a stream.

A range begins at the first place whose header tells that it lies there (its next position is its own end), whose checksum holds and behind which another such header
or the file's end stands.  Each range reads every event that begins in it, looks for the next range's beginning itself and raises if that is not where its own last event ends: no
event is lost or read twice between ranges.  ``event_no`` is the place of an event in its file, which is its order.

``spark.read.format("rawlog").option("split_bytes", ...).load(folder)`` after ``register(spark)``; ``spark.readStream`` likewise.  Folders are opened with pyarrow's file systems.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalars import EVENT_TYPES
from ..schemas import EVENTS
from .binlog import DESCRIPTION, FOOTER_SIZE, HEADER_SIZE, MAGIC, Decoder

_NAME = re.compile(r"[^/]+\.[0-9]{6}")
#: Bytes that are read, and looked through for an event's beginning, at a time.
WINDOW = 1 << 20
#: Headers in a row that prove a place.
CHAIN = 3


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def log_files(path: str) -> list[tuple[str, str, int]]:
    """``name, path, size`` of the log files in a folder, in order."""
    from pyarrow import fs

    filesystem, base = _folder(path)
    found = filesystem.get_file_info(fs.FileSelector(base))
    return sorted((f.base_name, f.path, f.size) for f in found if f.type == fs.FileType.File and _NAME.fullmatch(f.base_name))


class RangedLog:
    """One open file: its description, events from a known place, and the search for such places."""

    def __init__(self, file, name: str, size: int, payloads: bool = True):
        self.file, self.name, self.end, self.payloads = file, name, size, payloads
        if self.read(0, 4) != MAGIC:
            raise ValueError(f"{name}: not a log file")
        self.decoder = Decoder(name, payloads)
        head = self.read(4, HEADER_SIZE)
        if len(head) == HEADER_SIZE and head[4] == DESCRIPTION:
            size = int.from_bytes(head[9:13], "little")
            if 4 + size <= self.end:
                self.decoder.row(self.read(4, size), 4, 4)

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.end - at)), at)

    def _header(self, at: int, h: bytes | None = None) -> int | None:
        """Where the event that begins here ends, if a header lies here (``h``: the bytes, if they are read already)."""
        h = self.read(at, HEADER_SIZE) if h is None else h
        if len(h) < HEADER_SIZE or h[4] not in EVENT_TYPES:
            return None
        size = int.from_bytes(h[9:13], "little")
        told = int.from_bytes(h[13:17], "little") == at + size & 0xFFFFFFFF
        return at + size if told and size >= HEADER_SIZE and at + size <= self.end else None

    def _proven(self, at: int) -> bool:
        """Headers in a row from here to the end or far enough, the first with its checksum."""
        ends = [at]
        while len(ends) <= CHAIN and ends[-1] < self.end:
            end = self._header(ends[-1])
            if end is None:
                # the last event of a growing file may be cut off
                return len(ends) > 1 and self._cut(ends[-1])
            ends.append(end)
        if not self.decoder.checksum:
            return True
        event = self.read(at, ends[1] - at)
        return zlib.crc32(event[:-FOOTER_SIZE]) == int.from_bytes(event[-FOOTER_SIZE:], "little") or len(ends) > CHAIN

    def _cut(self, at: int) -> bool:
        h = self.read(at, HEADER_SIZE)
        return len(h) < HEADER_SIZE or h[4] in EVENT_TYPES and at + int.from_bytes(h[9:13], "little") > self.end

    def first_event(self, at: int) -> int:
        """The first place from ``at`` on where an event begins; the file's end if there is none."""
        import numpy as np

        if at <= 4:
            return 4
        while at + HEADER_SIZE <= self.end:
            b = np.frombuffer(self.read(at, WINDOW + HEADER_SIZE), np.uint8).astype(np.int64)
            n = len(b) - HEADER_SIZE + 1
            word = lambda i: b[i : i + n] | b[i + 1 : i + 1 + n] << 8 | b[i + 2 : i + 2 + n] << 16 | b[i + 3 : i + 3 + n] << 24
            size = word(9)
            for i in np.flatnonzero((size >= HEADER_SIZE) & (word(13) == (at + np.arange(n) + size & 0xFFFFFFFF))).tolist():
                if self._header(at + i) is not None and self._proven(at + i):
                    return at + i
            at += n
        return self.end

    def events(self, begin: int, end: int):
        """``place, bytes`` of the events that begin in ``begin .. end``, the first of which begins at ``begin``; the place behind the last is yielded with None."""
        at, held, base = begin, b"", begin
        while at < end:
            if at - base + HEADER_SIZE > len(held):
                held, base = self.read(at, WINDOW), at
            size = self.decoder.size(held[at - base : at - base + HEADER_SIZE], self.end - at)
            if at - base + size > len(held):
                held, base = self.read(at, max(size, WINDOW)), at
            yield at, held[at - base : at - base + size]
            at += size
        yield at, None

    def rows(self, begin: int, end: int, known: bool, last: bool):
        """Rows of the events that begin in a range; ``known``: an event begins at ``begin``; ``last``: ``end`` is where the reading stops for good, so the last event ends there."""
        at = begin
        try:
            start = max(4, begin) if known or begin <= 4 else self.first_event(begin)
            for at, event in self.events(start, end):
                if event is not None:
                    yield self.decoder.row(event, at, at)
            if start < end and at != (end if last else self.first_event(end)):
                raise ValueError("the ranges of the file do not meet")
        except (ValueError, UnicodeDecodeError) as e:
            raise ValueError(f"{self.name} at {at}: {e}") from e

    def last_boundary(self, known: int) -> int:
        """Where the last whole event ends: headers are followed from a place near the end, or from ``known``."""
        span = WINDOW
        while True:
            at = known if self.end - known <= span else self.first_event(self.end - span)
            if at < self.end or known >= self.end - span:
                break
            span *= 8  # a longer event, or none yet
        held, base = b"", at
        while True:
            if at - base + HEADER_SIZE > len(held):
                held, base = self.read(at, WINDOW), at
            end = self._header(at, held[at - base : at - base + HEADER_SIZE])
            if end is None:
                return at
            at = end


@dataclass
class Range(InputPartition):
    path: str
    name: str
    begin: int
    end: int
    size: int
    known: bool
    last: bool


def ranges(path: str, name: str, begin: int, end: int, size: int, split: int, known: bool) -> list[Range]:
    cuts = [*range(begin, end, split), end]
    return [Range(path, name, a, b, size, known and a == begin, b == end) for a, b in zip(cuts[:-1], cuts[1:])]


#: Up to so many ranges are a task each; more are dealt to ``TASKS`` tasks, or to more of so many bytes, where opening a file counts as some.
MOST_TASKS, TASKS, TASK_BYTES, OPEN_BYTES = 2048, 256, 32 << 20, 64 << 10


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    parts: list[Range]


def packed(parts: list[Range], most: int = MOST_TASKS, tasks: int = TASKS) -> list[Ranges]:
    """Ranges in order, dealt to tasks: one each, or, where there are more than ``most``, to about ``tasks`` or what their bytes want, whatever the number of files."""
    cost = [p.end - p.begin + (OPEN_BYTES if i == 0 or parts[i - 1].path != p.path else 0) for i, p in enumerate(parts)]
    share = min(TASK_BYTES, sum(cost) / tasks) if len(parts) > most else 0
    out, held = [], share
    for part, n in zip(parts, cost):
        if held >= share:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(part)
        held += n
    return out


class _Read:
    def __init__(self, options: dict):
        self.folder, self.payloads = options["path"], options.get("payloads", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 128 << 20))

    def read(self, partition: Ranges):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(EVENTS)
        filesystem, _ = _folder(self.folder)
        rows, held = [], 0
        for path, parts in itertools.groupby(partition.parts, lambda p: p.path):
            with filesystem.open_input_file(path) as file:
                for part in parts:
                    for row in RangedLog(file, part.name, part.size, self.payloads).rows(part.begin, part.end, part.known, part.last):
                        rows.append(row)
                        held += row["event_size"]
                        if len(rows) >= 5000 or held > 16_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class _BatchReader(_Read, DataSourceReader):
    def partitions(self):
        return packed([r for name, path, size in log_files(self.folder) for r in ranges(path, name, 4, max(size, 5), size, self.split, True)])


class _StreamReader(_Read, DataSourceStreamReader):
    """The offset is the place behind the last whole event of each file, so a restart goes on there and an event that is half written waits."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        filesystem, _ = _folder(self.folder)
        for name, path, size in log_files(self.folder):
            known = self.seen.get(name, 4)
            if size > max(known, HEADER_SIZE):
                with filesystem.open_input_file(path) as file:
                    self.seen[name] = RangedLog(file, name, size, False).last_boundary(known)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict):
        paths = {name: path for name, path, _ in log_files(self.folder)}
        return packed([r for name, stop in sorted(end.items()) if stop > start.get(name, 4) for r in ranges(paths[name], name, start.get(name, 4), stop, stop, self.split, True)])

    def commit(self, end: dict) -> None:
        pass


class RawLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawlog"

    def schema(self):
        return EVENTS

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawLog)


def read_raw_log(spark: SparkSession, path: str, split_bytes: int = 128 << 20, payloads: bool = True) -> DataFrame:
    """The events of all log files (``base.NNNNNN``) in a folder, in ranges of ``split_bytes``."""
    register(spark)
    return spark.read.format("rawlog").option("split_bytes", split_bytes).option("payloads", str(payloads).lower()).load(path)


def raw_log_stream(spark: SparkSession, path: str, split_bytes: int = 128 << 20, payloads: bool = True) -> DataFrame:
    """The same as a stream: whole events as files grow and appear."""
    register(spark)
    return spark.readStream.format("rawlog").option("split_bytes", split_bytes).option("payloads", str(payloads).lower()).load(path)
