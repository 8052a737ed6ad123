"""Content-defined chunking with a rolling fingerprint over GF(2).

The fingerprint of the last WINDOW bytes is their polynomial modulo an irreducible polynomial of degree DEGREE. A chunk
ends where, from ``least`` bytes on, its low bits are zero, or at ``most`` bytes; then all state starts anew.

Fingerprints of all windows are computed at once with numpy: the remainder is linear, so a window's is the XOR of one
table entry a byte and place. A candidate's window lies within its own chunk, as ``least`` is at least WINDOW.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

# fixed values: the format's window, bounds and mask
WINDOW, DEGREE, LEAST, MOST, BITS = 64, 53, 524_288, 8_388_608, 20


def multiply(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return out


def remainder(a: int, p: int) -> int:
    n = p.bit_length()
    while a.bit_length() >= n:
        a ^= p << (a.bit_length() - n)
    return a


def power_of_x(n: int, p: int) -> int:
    """x^n modulo p."""
    out, base = 1, remainder(2, p)
    while n:
        if n & 1:
            out = remainder(multiply(out, base), p)
        base, n = remainder(multiply(base, base), p), n >> 1
    return out


def is_valid(p: int) -> bool:
    """Degree DEGREE (a prime), odd weight, constant term, and x^(2^DEGREE) = x: irreducible."""
    if p.bit_length() != DEGREE + 1 or not p & 1 or not p.bit_count() & 1:
        return False
    x = 2
    for _ in range(DEGREE):
        x = remainder(multiply(x, x), p)
    return x == 2


#: Bytes of files that are chunked in one pass.
PASS = 4 << 20


@lru_cache(maxsize=8)
def tables(p: int) -> np.ndarray:
    """WINDOW x 256: the remainder of each byte at each place of a window, the newest byte first."""
    if not is_valid(p):
        raise ValueError(f"{p:#x} is not an irreducible polynomial of degree {DEGREE}")
    bit = [power_of_x(i, p) for i in range(8 * WINDOW)]
    out = np.zeros((WINDOW, 256), np.uint64)
    values = np.arange(256)
    for place in range(WINDOW):
        for b in range(8):
            out[place] ^= np.where(values >> b & 1, np.uint64(bit[8 * place + b]), np.uint64(0))
    return out


@lru_cache(maxsize=8)
def pair_tables(p: int) -> np.ndarray:
    """WINDOW / 2 x 65536: low 32 bits of the remainder of two bytes at once, the newer one in the low half of the place."""
    t = tables(p).astype(np.uint32)
    values = np.arange(1 << 16)
    return np.stack([t[2 * k][values & 255] ^ t[2 * k + 1][values >> 8] for k in range(WINDOW // 2)])


def low_bits(data: bytes, p: int, block: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
    """(position, low 32 bits of the fingerprints of the windows that end there and after) in blocks; positions start at WINDOW - 1."""
    x, t = np.frombuffer(data, np.uint8), pair_tables(p)
    for i in range(WINDOW - 1, len(x), block):
        j = min(len(x), i + block)
        part, out, one = x[i - WINDOW + 1 : j].astype(np.intp), np.zeros(j - i, np.uint32), np.empty(j - i, np.uint32)
        pairs = part[:-1] << 8 | part[1:]
        for k in range(WINDOW // 2):
            at = WINDOW - 2 - 2 * k
            np.take(t[k], pairs[at : at + j - i], out=one, mode="clip")
            out ^= one
        yield i, out


def cuts(data: bytes, p: int, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[tuple[int, int]]:
    """(offset, length) of each chunk."""
    return cuts_of([data], p, least, most, bits)[0]


def cuts_of(files: list[bytes], p: int, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """The chunks of each file, (offset, length), from one pass over all of them: no chunk is shorter than a window, so none ends by a window that began in another file."""
    if least < WINDOW or bits > 32:
        raise ValueError("a chunk has a window at least, and the mask 32 bits at most")
    mask, data = np.uint32((1 << bits) - 1), files[0] if len(files) == 1 else b"".join(files)
    ends = np.concatenate([i + 1 + np.flatnonzero((f & mask) == 0) for i, f in low_bits(data, p)] or [np.empty(0, np.int64)])
    out, base = [], 0
    for body in files:
        own, start = [], 0
        while start < len(body):
            at = np.searchsorted(ends, base + start + least)
            end = min(int(ends[at]) - base if at < len(ends) else len(body), start + most, len(body))
            own.append((start, end - start))
            start = end
        out.append(own)
        base += len(body)
    return out


def spread(files: DataFrame, key: str, row_group: int = 128 << 20) -> DataFrame:
    """Small tables dealt over all cores: a row group is read by one task, and fewer of them than cores leave cores idle."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(cores, key) if size < cores * row_group else files


def chunks(files: DataFrame, polynomial: int, key: str = "path", content: str = "content", least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """(key, ord, off, len, id) of every chunk of each file; empty and null contents have none. Ids are SHA-256."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
        """Files of a batch, as many at a time as have PASS bytes or so."""
        keys, bodies, size = [], [], 0
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(k)
            bodies.append(data.as_py() or b"")
            size += len(bodies[-1])
            if size >= PASS:
                yield keys, bodies
                keys, bodies, size = [], [], 0
        if keys:
            yield keys, bodies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for keys, bodies in parts(batch):
                rows = [(k, i, o, n, hashlib.sha256(body[o : o + n]).hexdigest()) for k, body, found in zip(keys, bodies, cuts_of(bodies, polynomial, least, most, bits)) for i, (o, n) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=[key, "ord", "off", "len", "id"])

    sql = dict(files.dtypes)[key]
    kind = pa.string() if sql == "string" else pa.int64()
    return files.select(key, content).mapInArrow(run, f"`{key}` {'string' if sql == 'string' else 'bigint'}, ord int, off bigint, len bigint, id string")


def register_chunker(spark: SparkSession, polynomial: int, name: str = "cdc_chunks", least: int = LEAST, most: int = MOST, bits: int = BITS) -> None:
    """``name(content)`` as a table function of SQL: (ord, off, len, id) of each chunk; a null content has none."""

    class Chunker:
        def eval(self, content: bytes):
            import hashlib

            body = bytes(content or b"")
            for i, (o, n) in enumerate(cuts(body, polynomial, least, most, bits)):
                yield i, o, n, hashlib.sha256(body[o : o + n]).hexdigest()

    spark.udtf.register(name, udtf(Chunker, returnType="ord int, off bigint, len bigint, id string"))
