"""Server-sent events from growing files, read from byte offsets as a stream or as a table."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, offset long, id string, event string, data string"
PIECE = 32 << 20  # bytes of a file that one task reads; no limit of an event
LOOK_BACK = 1 << 16

# An event is complete with the first byte of the end of an empty line; two bytes tell it, whatever ends lines.
_COMPLETE = re.compile(rb"(?<=\n)[\n\r]|(?<=\r)\r")
_LINE_END = re.compile(rb"\r\n|\r|\n")


def parse_event(raw: bytes) -> tuple[str | None, str, str] | None:
    """(id, event, data) of the bytes of one event; None if it has no data lines. Comments and unknown fields are ignored, so is an id with a NUL; bytes that are no UTF-8 become the replacement character."""
    number, name, lines = None, "", []
    for line in _LINE_END.split(raw):
        field, _, value = line.decode("utf-8", "replace").partition(":")
        value = value.removeprefix(" ")
        if field == "event":
            name = value
        elif field == "data":
            lines.append(value)
        elif field == "id" and "\0" not in value:
            number = value
    return (number, name or "message", "\n".join(lines)) if lines else None


@dataclass
class Piece(InputPartition):
    """The events of a file that become complete after `begin` and not after `end`."""

    file: str
    begin: int
    end: int


NOTHING = [Piece("", 0, 0)]  # without any piece, Spark would ask to read None


def pieces(start: dict, end: dict, size: int = PIECE) -> list[Piece]:
    """Pieces of at most `size` bytes of what each file grew by."""
    return [Piece(f, a, min(a + size, n)) for f, n in sorted(end.items()) for a in range(int(start.get(f, 0)), int(n), size)]


def _start(f, begin: int) -> int:
    """Where the event starts that is not complete at `begin`: after the last one that is, looking back as far as it takes."""
    step = LOOK_BACK
    while begin:
        low = max(0, begin - step)
        f.seek(low)
        found = [m.end() for m in _COMPLETE.finditer(f.read(begin - low))]
        if found:
            return low + found[-1]
        if not low:
            return 0
        step *= 2
    return 0


def events_in(path: str, piece: Piece) -> Iterator[tuple]:
    """(file, offset, id, event, data) of the events of a piece. A task holds its piece, and an event that began before it."""
    if piece.begin >= piece.end:
        return
    with open(os.path.join(path, piece.file), "rb") as f:
        at = _start(f, piece.begin)
        f.seek(at)
        data = f.read(piece.end - at)
    base, at = at, 0
    for m in _COMPLETE.finditer(data):
        raw, begin, at = data[at : m.start()], base + at, m.end()
        if base + m.end() <= piece.begin:
            continue
        if begin and raw[:1] == b"\n":  # the second byte of the end before, or an empty line
            raw, begin = raw[1:], begin + 1
        elif not begin:
            raw = raw.removeprefix(b"\xef\xbb\xbf")
        if event := parse_event(raw):
            yield piece.file, begin, *event


class _Log:
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("piece", PIECE))
        if "://" in self.path or self.path.startswith("file:"):
            self.path = unquote(urlparse(self.path).path)

    def lengths(self) -> dict:
        with os.scandir(self.path) as entries:
            return {e.name: e.stat().st_size for e in entries if e.name.endswith(".events")}

    def read(self, piece: Piece) -> Iterator[tuple]:
        return events_in(self.path, piece)


class _Stream(_Log, DataSourceStreamReader):
    """An offset is the length of each file; executors read the bytes between two offsets."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.lengths()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(start, end, self.size) or NOTHING


class _Table(_Log, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return pieces({}, self.lengths(), self.size) or NOTHING


class EventLog(DataSource):
    """Format `event_log`: the `*.events` files of a folder that driver and executors share. Option `piece`: bytes for one task."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def event_log(spark: SparkSession, path: str, stream: bool = True, piece: int = PIECE) -> DataFrame:
    """file, offset (of the event's first byte), id (its own, or null), event, data, as a stream while files grow or as a table.

    An event shows up once, in the batch in which its empty line arrives; a replayed batch reads the same
    bytes. Lines end with LF, CR LF or CR, cut anywhere. A folder without files gives no rows.
    """
    spark.dataSource.register(EventLog)
    reader = spark.readStream if stream else spark.read
    return reader.format("event_log").option("piece", str(piece)).load(path)
