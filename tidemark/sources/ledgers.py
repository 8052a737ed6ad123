"""Ledgers in JSON lines as a Spark data source: ``spark.read.format("jsonl_ledger")`` and ``spark.readStream`` alike.

Options: ``path`` (a file, or a folder of ``*.jsonl``, on a file system that driver and executors mount), ``torn`` (what a
last line without a newline is that can't be parsed: ``error``, or ``drop`` for ledgers whose writer may have been cut
off), ``range_bytes`` (files are read in ranges of that size), ``on_shrink`` (for streams: a log that was rewritten
shorter is read again from its ``start``, or from its new ``end``). A schema is required.

A range has the lines that begin in it. A malformed line is an error that names file and line; its number is counted only
then. Blank lines are passed over. A file that isn't there is an empty ledger.

The offsets of a stream are, of each file, its identity and the end of its last whole line; a torn line waits for its
rest. A file of another identity, or one that became shorter, is a log that was rewritten.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType

FORMAT, RANGE, BLOCK = "jsonl_ledger", 64 << 20, 1 << 16
BITS_OF = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}


class LedgerError(ValueError):
    """A malformed line: file, line number from 1 on, reason."""

    def __init__(self, path: str, line: int, reason: str):
        super().__init__(f"{path}, line {line}: {reason}")

    def __reduce__(self):
        return ValueError, self.args


def typed(value, kind: DataType, at: str = "line"):
    """A JSON value as a value of the type; unknown fields are passed over, missing ones are null."""
    if value is None:
        return None
    if isinstance(kind, StructType) and isinstance(value, dict):
        return tuple(typed(value.get(f.name), f.dataType, f.name) for f in kind.fields)
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [typed(v, kind.elementType, at) for v in value]
    if isinstance(kind, MapType) and isinstance(value, dict):
        return {k: typed(v, kind.valueType, k) for k, v in value.items()}
    if isinstance(kind, StringType) and isinstance(value, str) or isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if (bits := BITS_OF.get(type(kind))) and isinstance(value, int) and not isinstance(value, bool) and -(1 << bits - 1) <= value < 1 << bits - 1:
        return value
    if isinstance(kind, (DoubleType, FloatType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    raise ValueError(f"{at}: {json.dumps(value)[:60]} is no {kind.simpleString()}")


def files_at(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(glob.escape(path), "*.jsonl"))) if os.path.isdir(path) else [path]


def whole_lines(path: str) -> tuple[int, int]:
    """(identity, end of the last whole line) of a file; zeros if there is none."""
    try:
        with open(path, "rb") as f:
            s = os.fstat(f.fileno())
            end = s.st_size
            while end:
                start = max(0, end - BLOCK)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return s.st_ino, start + at + 1
                end = start
            return s.st_ino, 0
    except FileNotFoundError:
        return 0, 0


@dataclass
class Range(InputPartition):
    """Bytes of a file whose lines are read; ``last`` is the end of what may be read, if it isn't the file's."""

    path: str
    start: int
    end: int
    last: int | None = None


def ranges(path: str, start: int, end: int, size: int, last: int | None = None) -> list[Range]:
    return [Range(path, at, min(end, at + size), last) for at in range(start, end, size)]


def line_number(path: str, at: int) -> int:
    """The number of the line that begins at this byte."""
    with open(path, "rb") as f:
        n = 1
        while at > 0 and (block := f.read(min(BLOCK, at))):
            n, at = n + block.count(b"\n"), at - len(block)
        return n


def rows_of(part: Range, schema: StructType, torn: str) -> Iterator[tuple]:
    """The rows of lines that begin in the range."""
    try:
        f = open(part.path, "rb")
    except FileNotFoundError:
        return
    with f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of a line that began before, or the newline alone
        while at < part.end and (part.last is None or at < part.last) and (raw := f.readline()):
            begin, at = at, at + len(raw)
            if not raw.strip():
                continue
            try:
                value = json.loads(raw.decode("utf-8"))
                if not isinstance(value, dict):
                    raise ValueError("no object")
                row = typed(value, schema)
            except ValueError as e:
                if torn == "drop" and not raw.endswith(b"\n"):
                    return
                raise LedgerError(part.path, line_number(part.path, begin), str(e)) from None
            yield row


class Options:
    def __init__(self, options: dict):
        self.path, self.torn, self.size, self.on_shrink = options.get("path"), options.get("torn", "error"), int(options.get("range_bytes", RANGE)), options.get("on_shrink", "start")
        if not self.path or self.torn not in ("error", "drop") or self.on_shrink not in ("start", "end") or self.size < 1:
            raise ValueError("a ledger has a path, torn is error or drop, on_shrink is start or end, range_bytes is positive")
        self.path = self.path.removeprefix("file://")


class LedgerReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, Options(options)

    def partitions(self) -> list[Range]:
        o = self.options
        found = [r for p in files_at(o.path) if os.path.exists(p) for r in ranges(p, 0, os.path.getsize(p), o.size)]
        return found or [Range(o.path, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        return rows_of(part, self.schema, self.options.torn)


class LedgerStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, Options(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: list(whole_lines(p)) for p in files_at(self.options.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (identity, upto) in sorted(end.items()):
            was, at = start.get(path, (identity, 0))
            if at and (was != identity or upto < at):
                at = 0 if self.options.on_shrink == "start" else upto
            out += ranges(path, at, upto, self.options.size, upto)
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        return rows_of(part, self.schema, "error")

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("a ledger is read with a schema")

    def reader(self, schema: StructType) -> LedgerReader:
        return LedgerReader(schema, self.options)

    def streamReader(self, schema: StructType) -> LedgerStream:
        return LedgerStream(schema, self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    from ..session import ship

    spark.dataSource.register(LedgerSource)
    return ship(spark)
