"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. At most ``max_bits`` (up to 2) differing bits touch at most two of them, so
two fingerprints that link share at least six, and of the four two-byte groups at least two: the index therefore posts
each distinct fingerprint under the six pairs of groups, that is under four positional bytes at a time. Pairs that
meet in a posting list get their shared positional bytes tallied; those that reach the guaranteed minimum are verified
by differing bits. A posting list over ``LIST_LIMIT`` emits no pairs: its members meet through the 65 points within
one bit of each instead (two fingerprints differ in two bits at most if and only if such points coincide), which is
exact as well and linear in the list.

Copies collapse before the index: work is per distinct fingerprint. Null texts count as empty; texts without words
have fingerprint zero. Null ids keep a row; a component is named by its least id that isn't null. Repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .components import components

#: Longest posting list that emits pairs; longer ones go through points within one bit.
LIST_LIMIT = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    if len(words) <= size:
        return np.array([one(joined, seed)], np.uint64)
    starts = [0, *(e + 1 for e in ends)]
    return np.array([one(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit 1 if set in over half the hashes."""
    if not len(hashes):
        return 0
    n = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 50_000):
        part = np.ascontiguousarray(hashes[i : i + 50_000]).astype("<u8")
        n += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * n > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), size, seed)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_column).mapInArrow(run, "doc_id bigint, fp bigint")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for i in range(8):
        out = out + (_byte(a, i) == _byte(b, i)).cast("int")
    return out


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) over distinct(fp) that connect exactly what chains of links connect."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two of the eight bytes may differ: max_bits is 0, 1 or 2")
    fp = F.col("fp")
    group = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    key = lambda k, i, j: F.lit(k << 32).bitwiseOR(group[i] * 65536 + group[j])
    postings = distinct.select("fp", F.explode(F.array(*(key(k, i, j) for k, (i, j) in enumerate(combinations(range(4), 2))))).alias("key"))
    counts = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = keep(postings.join(counts, "key"), "postings")
    short = listed.where(F.col("n") <= LIST_LIMIT)
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    tallied = a.join(b, "key").where("a < b").where(shared_bytes(F.col("a"), F.col("b")) >= 8 - max_bits)
    pairs = tallied.where(differing_bits(F.col("a"), F.col("b")) <= max_bits).select("a", "b").distinct()
    crowded = listed.where(F.col("n") > LIST_LIMIT).select("fp").distinct()
    if max_bits == 2:
        points = crowded.select("fp", F.explode(F.array(F.lit(0).cast("bigint"), *(F.lit((1 << i) - (1 << 64) * (i == 63)) for i in range(64)))).alias("flip"))
        points = points.select("fp", fp.bitwiseXOR(F.col("flip")).alias("point"))
        heads = points.groupBy("point").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
        stars = points.join(heads, "point").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    else:
        flips = crowded.select("fp", F.explode(F.array(*(F.lit((1 << i) - (1 << 64) * (i == 63)) for i in range(64 * max_bits)))).alias("flip")) if max_bits else crowded.select("fp", F.lit(0).cast("bigint").alias("flip"))
        near = flips.select(F.col("fp").alias("a"), fp.bitwiseXOR(F.col("flip")).alias("b"))
        stars = near.join(crowded.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return pairs.union(stars).distinct()


def near_duplicates(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """prints(doc_id, fp) with component_id, the least doc_id reachable by links."""
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
