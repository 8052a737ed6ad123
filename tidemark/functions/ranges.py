"""Content-defined chunks of files of any size: ranges of one file are chunked by many tasks.

A place where a chunk may end depends on the WINDOW bytes before it alone, as chunks are as long as a window at least. So
each range is searched by itself, with the bytes just before it, and gives the candidates that lie in it: one in 2^bits
bytes. Which of them are cuts depends on where the chunk before began; that is a number that is handed from range to range
of a file, over candidates only, a fraction of about 8 / 2^bits of the content. Then chunks are hashed wherever they are
dealt to, by bytes of their own. No task holds more than a range, or than the chunks of one batch.

Content comes from files, read by range, or from a table of parts, whose rows are the pieces of a file in order. Cuts are
those of ``chunker.cuts`` of the whole content, ids are SHA-256. Empty contents have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunker import BITS, LEAST, MOST, WINDOW, low_bits

#: Bytes of a file that one task searches at once.
RANGE = 64 << 20
OVERLAP = WINDOW - 1
FOUND = "off bigint, len bigint, ends array<bigint>"


def candidates(before: bytes, data: bytes, at: int, polynomial: int, bits: int = BITS) -> np.ndarray:
    """Offsets in the file at which a chunk may end, of data that starts at ``at`` and of the bytes before it, OVERLAP at most."""
    mask, shift = np.uint32((1 << bits) - 1), at - len(before) + 1
    found = [i + shift + np.flatnonzero((f & mask) == 0) for i, f in low_bits(before + data, polynomial)]
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def opened(path: str):
    system, plain = fs.FileSystem.from_uri(path) if re.match("[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(plain)


def check_bounds(least: int, bits: int) -> None:
    if least < WINDOW or bits > 32:
        raise ValueError("a chunk has a window at least, and the mask 32 bits at most")


def file_candidates(files: DataFrame, polynomial: int, bits: int = BITS, size: int = RANGE) -> DataFrame:
    """(path, off, len, ends) of ranges of files(path, size); paths are of the mounted file system, or URIs that Arrow opens."""
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(size).cast("bigint"))).alias("off"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, whole, off in zip(*(batch.column(c).to_pylist() for c in range(3))):
                n, skip = min(size, whole - off), min(off, OVERLAP)
                with opened(path) as f:
                    f.seek(off - skip)
                    data = f.read(n + skip)
                if len(data) != n + skip:
                    raise OSError(f"{path} has become shorter than {off + n} bytes")
                ends = candidates(data[:skip], data[skip:], off, polynomial, bits)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([off]), pa.array([n]), pa.array([ends], pa.list_(pa.int64()))], names=["path", "off", "len", "ends"])

    return ranges.repartition(parts, "path", "off").mapInArrow(run, "path string, " + FOUND)


def part_candidates(parts: DataFrame, polynomial: int, bits: int = BITS) -> DataFrame:
    """(path, off, len, ends) of parts(path, off, data), of OVERLAP bytes at least but for a file's last."""
    tails = parts.select("path", (F.col("off") + F.length("data")).alias("off"), F.expr(f"substring(data, greatest(length(data) - {OVERLAP - 1}, 1), {OVERLAP})").alias("before"))
    both = parts.join(tails, ["path", "off"], "left").select("path", "off", "data", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, off, data, before = batch.columns
            bodies = [(b.as_py() or b"", d.as_py()) for b, d in zip(before, data)]
            for o, (b, _) in zip(off.to_pylist(), bodies):
                if len(b) < min(o, OVERLAP):
                    raise ValueError(f"a part that ends before {o} has fewer than {OVERLAP} bytes, or is missing")
            ends = [candidates(b, d, o, polynomial, bits) for o, (b, d) in zip(off.to_pylist(), bodies)]
            yield pa.RecordBatch.from_arrays([path, off, pa.array([len(d) for _, d in bodies], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["path", "off", "len", "ends"])

    return both.mapInArrow(run, "path string, " + FOUND)


class Cutter:
    """The chunks of one file, as its ranges come: what is handed on is where the open chunk began, and its number."""

    def __init__(self, path: str, least: int, most: int):
        self.path, self.least, self.most = path, least, most
        self.start = self.ord = self.end = 0

    def take(self, off: int, n: int, ends: np.ndarray) -> list[tuple[str, int, int, int]]:
        if off != self.end:
            raise ValueError(f"{self.path}: no range starts at {self.end}")
        self.end, out, ends = off + n, [], ends.tolist()
        at = 0
        while True:
            first, last = self.start + self.least, self.start + self.most
            while at < len(ends) and ends[at] < first:
                at += 1
            if at < len(ends) and ends[at] <= last:
                cut = ends[at]
            elif last <= self.end:
                cut = last
            else:
                return out
            out.append(self.chunk(cut))

    def chunk(self, cut: int) -> tuple[str, int, int, int]:
        row = (self.path, self.ord, self.start, cut - self.start)
        self.start, self.ord = cut, self.ord + 1
        return row

    def finish(self) -> list[tuple[str, int, int, int]]:
        return [self.chunk(self.end)] if self.end > self.start else []


def resolved(found: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(path, ord, off, len) of every chunk, from the candidates of all ranges: a file's are read in order, a batch at a time."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "ord", "off", "len"])

        now = None
        for batch in batches:
            rows = []
            for path, off, n, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if now is None or path != now.path:
                    rows += now.finish() if now else []
                    now = Cutter(path, least, most)
                rows += now.take(off, n, ends.values.to_numpy())
            if rows:
                yield made(rows)
        if now and (rows := now.finish()):
            yield made(rows)

    return found.repartition(parts, "path").sortWithinPartitions("path", "off").mapInArrow(run, "path string, ord int, off bigint, len bigint")


def file_chunks(files: DataFrame, polynomial: int, least: int = LEAST, most: int = MOST, bits: int = BITS, size: int = RANGE) -> DataFrame:
    """(path, ord, off, len, id) of every chunk of files(path, size)."""
    check_bounds(least, bits)
    cut = resolved(file_candidates(files, polynomial, bits, size), least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        name, f = None, None
        for batch in batches:
            ids = []
            for path, off, n in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if path != name:
                    if f:
                        f.close()
                    name, f = path, opened(path)
                f.seek(off)
                ids.append(hashlib.sha256(f.read(n)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.string())], names=[*batch.schema.names, "id"])
        if f:
            f.close()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(parts, "path", F.floor(F.col("off") / size)).sortWithinPartitions("path", "off")
    return dealt.mapInArrow(run, "path string, ord int, off bigint, len bigint, id string")


def part_chunks(parts: DataFrame, polynomial: int, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """(path, ord, off, len, id) of every chunk of the files whose parts(path, off, data) these are.

    A chunk's bytes are gathered from the parts it lies in, ``most`` of them at most.
    """
    check_bounds(least, bits)
    full = parts.where("length(data) > 0")
    cut = resolved(part_candidates(full, polynomial, bits), least, most)
    # chunks and parts are both cut at the multiples of ``most``: what overlaps has a stretch between two of them in common
    stretch = lambda off, n: F.explode(F.sequence(F.floor(off / most), F.floor((off + n - 1) / most))).alias("stretch")
    places = full.select("path", F.col("off").alias("at"), F.length("data").cast("bigint").alias("n"))
    a, b = cut.withColumn("stretch", stretch(F.col("off"), F.col("len"))), places.withColumn("stretch", stretch(F.col("at"), F.col("n")))
    met = a.join(b, ["path", "stretch"]).where((F.col("at") < F.col("off") + F.col("len")) & (F.col("off") < F.col("at") + F.col("n")))
    pieces = met.select("path", "ord", "off", "len", "at", F.greatest("off", "at").alias("from"), F.least(F.col("off") + F.col("len"), F.col("at") + F.col("n")).alias("to")).distinct()
    body = F.expr("substring(data, cast(from - at as int) + 1, cast(to - from as int))")
    read = pieces.join(full.select("path", F.col("off").alias("at"), "data"), ["path", "at"]).select("path", "ord", "off", "len", F.struct("from", body.alias("body")).alias("piece"))
    whole = F.aggregate(F.array_sort(F.collect_list("piece")), F.lit(b""), lambda a, p: F.concat(a, p["body"]))
    return read.groupBy("path", "ord", "off", "len").agg(F.sha2(whole, 256).alias("id"))
