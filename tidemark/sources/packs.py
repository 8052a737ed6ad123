"""Pack files: bodies of blobs one after the other, a footer that says where each is, and reading by range.

A file is the blobs, the footer as JSON, and a trailer of eight bytes of the footer's length and eight of a mark. Blobs are
read by the bytes they lie in; nothing ever joins whole packs.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, keep

MARK = b"TIDEPACK"
PLACE = "id string, pack string, plain_off bigint, plain_len bigint"
#: A pack's name for its file; names are no paths.
SUFFIX = ".pack"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match("[a-z][a-z0-9+.-]*:", folder) else (fs.LocalFileSystem(), folder)


def write(blobs: DataFrame, folder: str) -> DataFrame:
    """Write blobs(pack, id, body) as one file a pack, in the order of ids, and return the index: id, pack, plain_off, plain_len.

    A file is written under a name of its own and then renamed, so a task that runs again leaves a whole file.
    """
    rows = blobs.select("pack", "id", F.col("body").cast("binary").alias("body"))
    parts = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base)
        name = stream = temporary = None
        places: list[tuple[str, int, int]] = []

        def closed() -> pa.RecordBatch:
            footer = json.dumps(places).encode()
            stream.write(footer + struct.pack("<Q", len(footer)) + MARK)
            stream.close()
            system.move(temporary, f"{base}/{name}{SUFFIX}")
            ids, offs, lens = zip(*places)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids)), pa.array(offs, pa.int64()), pa.array(lens, pa.int64())], names=["id", "pack", "plain_off", "plain_len"])

        at = 0
        for batch in batches:
            for pack, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if pack != name:
                    if stream:
                        yield closed()
                    name, places, at = pack, [], 0
                    temporary = f"{base}/.{name}-{uuid.uuid4().hex[:8]}"
                    stream = system.open_output_stream(temporary)
                data = body.as_py() or b""
                stream.write(data)
                places.append((key, at, len(data)))
                at += len(data)
        if stream:
            yield closed()

    return keep(rows.repartition(parts, "pack").sortWithinPartitions("pack", "id").mapInArrow(run, PLACE), "index")


class Pack:
    """An open pack: its footer, and bodies by range."""

    def __init__(self, folder: str, name: str):
        system, base = _open(folder)
        self.file = system.open_input_file(f"{base}/{name}{SUFFIX}")
        size = self.file.size()
        tail = self.file.read_at(16, max(0, size - 16))
        if len(tail) < 16 or tail[8:] != MARK:
            raise ValueError("no footer")
        (n,) = struct.unpack("<Q", tail[:8])
        if n > size - 16:
            raise ValueError("no footer")
        self.places = {key: (off, length) for key, off, length in json.loads(self.file.read_at(n, size - 16 - n))}

    def read(self, key: str, off: int, length: int) -> tuple[bytes | None, str | None]:
        """A body, or what is wrong: an index that says another place than the footer, or bytes that aren't the id's."""
        import hashlib

        if self.places.get(key) != (off, length):
            return None, "disagreement"
        body = self.file.read_at(length, off)
        return (body, None) if hashlib.sha256(body).hexdigest() == key else (None, "hash_mismatch")


def read_at(places: DataFrame, folder: str) -> DataFrame:
    """places(id, pack, plain_off, plain_len) with body and error (missing, no_footer, disagreement, hash_mismatch): a pack is opened once where its places are."""
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["id", "pack", "body", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pack, problem = None, None, None
        for batch in batches:
            out = []
            for key, wanted, off, length in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if wanted != name:
                    name, pack, problem = wanted, None, None
                    try:
                        pack = Pack(folder, name)
                    except FileNotFoundError:
                        problem = "missing"
                    except ValueError:
                        problem = "no_footer"
                body, wrong = pack.read(key, off, length) if pack else (None, problem)
                out.append((key, name, body, wrong))
                if sum(len(x[2] or b"") for x in out[-1:]) > 1 << 20 or len(out) >= 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.binary(), pa.string()))], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.binary(), pa.string()))], names=names)

    dealt = places.select("id", "pack", "plain_off", "plain_len").repartition(parts, "pack", F.floor(F.col("plain_off") / (64 << 20))).sortWithinPartitions("pack", "plain_off")
    return dealt.mapInArrow(run, "id string, pack string, body binary, error string")


def get(wanted: DataFrame, index: DataFrame, folder: str, staged: DataFrame | None = None) -> DataFrame:
    """wanted(id) from staged(id, body) and from packs at index(id, pack, plain_off, plain_len, ord): id, pack, body, error.

    Staged bodies come first; one that isn't its id's is an error, whatever the packs have. Then all other ids go to their
    first place, those that got nothing there to their second, and so on: a round reads the places of one rank. A place
    whose index row isn't what the pack's footer says ends its id's search with ``disagreement``; missing packs and damaged
    bytes send it on. What no place gave has ``not_found``, if its packs are missing or it has no place, or the last
    error.
    """
    ids = wanted.select("id").distinct()
    done = []
    if staged is not None:
        found = ids.join(staged.dropDuplicates(["id"]), "id")
        good = F.sha2("body", 256) == F.col("id")
        done.append(found.select("id", F.lit(None).cast("string").alias("pack"), F.when(good, F.col("body")).alias("body"), F.when(~good, "hash_mismatch").alias("error")))
        ids = ids.join(staged.select("id"), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("ord", "pack"))
    places = keep(index.join(ids, "id", "left_semi").withColumn("rank", rank), "places")
    open_, number = keep(ids.withColumn("last", F.lit("not_found")), "open"), 1
    while True:
        here = places.where(F.col("rank") == number).join(open_, "id", "left_semi")
        read = keep(read_at(here, folder), "read")
        ended = F.col("error").isNull() | (F.col("error") == "disagreement")
        done.append(read.where(ended).select("id", "pack", "body", "error"))
        rest = open_.join(read.where(ended).select("id"), "id", "left_anti").join(read.where(~ended).select("id", "error"), "id", "left")
        # a pack that is missing is no news of the blob
        last = F.when(F.col("error").isNull() | (F.col("error") == "missing"), F.col("last")).otherwise(F.col("error"))
        new = keep(rest.select("id", last.alias("last")), "open")
        drop(open_)
        open_, number = new, number + 1
        if places.where(F.col("rank") == number).join(open_, "id", "left_semi").isEmpty():
            break
    done.append(open_.select("id", F.lit(None).cast("string").alias("pack"), F.lit(None).cast("binary").alias("body"), F.col("last").alias("error")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return wanted.select("id").join(out, "id")
