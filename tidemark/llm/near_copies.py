"""Near copies by shingle sets: all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The SimHash operator comes first: texts whose fingerprints of these shingles differ in two bits at most meet in its
byte-position index, and those that their sets confirm are linked. At a similarity of 0.8 far more bits differ, and no
count of shared bytes is guaranteed, so what the index can't promise comes from prefix filtering, which is exact. Put
the shingles of all texts in one order, whatever it is: of two sets of n and m shingles with a similarity of s or more,
the first n - ceil(s n) + 1 of the one and the first m - ceil(s m) + 1 of the other share a shingle. Each distinct set
is posted under these; the first shingle that two prefixes share also bounds what the sets can share from there on,
parities of the sets over ``PARITIES`` buckets bound from below in how many shingles they differ, and sets decide about
every pair that is left. The order is from rare to frequent, as counted over a share of the documents, which keeps
lists short and has no bearing on what is found.

Of two sets that link the smaller one, of n shingles, has the first shared shingle even earlier: it shares 2 s n / (1 + s)
at least, so among its first n - ceil(2 s n / (1 + s)) + 1. Only a member that has a list's shingle so early is compared
with members as large or larger. So texts of one template that don't link, as their own words are too many, have no such
member in the lists of the template's shingles, and these lists are no lists at all.

At first the members of each list are compared with two of them only, which is linear and puts most of a large group
together: with the member that has the fewest rarer shingles, as it is the likeliest to be near all others, and with
one by hash. What is not in one group by then is compared class by class: a list's members are classed by size and place
of the shingle, classes that can't reach the similarity from there on, whichever members are taken, are told apart
unseen, and the members of the others are dealt in blocks of ``BLOCK``, a pair of blocks a unit of work, so that a long
list is many units. Work grows with the square of a list only for members that neither link nor differ in any of these
bounds.

Rows are known by a hash of id and text of 128 bits, sets by one of their shingles, and get numbers of their own once they
are written. Texts of equal shingle sets collapse before the index. Words are as in ``simhash``; a text without words is one with
all others like it. Null ids sort first, null texts count as empty. Of each group the document of least id stays, of
rows that repeat id and text one. An empty table stays empty; extra columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop, keep
from .columns import spare
from .components import components
from .simhash import fingerprint, shingle_hashes
from .simhash import links as simhash_links

SIMILARITY = 0.8
#: Bits of a fingerprint that may differ for the SimHash operator to link.
MAX_BITS = 2
#: Buckets of shingles whose parities are compared; a multiple of 64.
PARITIES = 256
#: Ids of 8 bytes that may be broadcast.
BROADCAST_IDS = 200_000
#: One document in so many is counted for the order; frequent shingles that are told apart, and their least count.
COUNTED, FREQUENT, LEAST = 8, 300_000, 3
#: Members of a class that meet those of another at once.
BLOCK = 1_000


def key_of() -> list[Column]:
    """Two hashes of 64 bits of id and text."""
    return [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(3), "text", F.lit(5), "doc_id")]


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def early(n: Column, similarity: float) -> Column:
    """Places at which the smaller set of a pair can have the first shared shingle."""
    return n - F.ceil(F.lit(2 * similarity / (1 + similarity)) * n - 1e-9) + 1


def frequent(docs: DataFrame, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a share of the documents, sorted, and their counts; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.column(0).slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found = np.concatenate([np.unique(shingle_hashes(t.as_py(), size, seed)) for t in part])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    some = docs.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(COUNTED)) == 0).select("text")
    counts = some.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    rows = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key, n = rows["key"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def in_order(hashes: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct hashes, those of least count first, equal counts by hash."""
    own = np.unique(hashes).view(np.int64)
    n = np.zeros(len(own), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        n = np.where(keys[at] == own, counts[at], 0)
    return own[np.lexsort((own, n))]


def parities(own: np.ndarray) -> np.ndarray:
    """A bit for each bucket of hashes: 1 if an odd number of the set's shingles is in it. Sets differ in as many shingles as bits at least."""
    odd = np.bincount((own.view(np.uint64) >> np.uint64(7)) % np.uint64(PARITIES), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefixes_of(docs: DataFrame, size: int, seed: int, similarity: float) -> DataFrame:
    """(k0, k1, doc_id, c0, c1, n, fp, bits, prefix): hashes of id and text, and of the shingle set, its size, fingerprint, parities and prefix."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, size, seed))

    def one(text: str | None) -> tuple[int, int, int, int, np.ndarray, np.ndarray]:
        hashes = shingle_hashes(text, size, seed)
        own = in_order(hashes, *shared.value)
        c = np.frombuffer(xxhash.xxh3_128_digest(np.sort(own).tobytes()), "<i8")
        fp = int(np.uint64(fingerprint(hashes)).view(np.int64))
        return int(c[0]), int(c[1]), len(own), fp, parities(own), own[: prefix_length(len(own), similarity)] if len(own) else own

    many = pa.list_(pa.int64())
    kinds = {"c0": pa.int64(), "c1": pa.int64(), "n": pa.int32(), "fp": pa.int64(), "bits": many, "prefix": many}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                cols = [pa.array(c, k) for c, k in zip(zip(*(one(t.as_py()) for t in part.column(3))), kinds.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], names=["k0", "k1", "doc_id", *kinds])

    k0, k1 = key_of()
    rows = docs.select(k0.alias("k0"), k1.alias("k1"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "k0 bigint, k1 bigint, doc_id bigint, c0 bigint, c1 bigint, n int, fp bigint, bits array<bigint>, prefix array<bigint>")


class Verifier:
    """Which pairs of ids link; rows(id, k0, k1) has the document that stands for each id's shingle set."""

    def __init__(self, docs: DataFrame, rows: DataFrame, size: int, seed: int, similarity: float):
        self.docs, self.rows, self.size, self.seed, self.similarity = docs, rows.select("id", "k0", "k1"), size, seed, similarity

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, set): the distinct shingles of these documents."""
        size, seed = self.size, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.unique(shingle_hashes(t.as_py(), size, seed)).view(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "set"])

        wanted = keep(ids.join(self.rows, "id"), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        k0, k1 = key_of()
        chosen = self.docs.select(k0.alias("k0"), k1.alias("k1"), "text").join(F.broadcast(wanted) if few else wanted, ["k0", "k1"])
        return chosen.select("id", "text").mapInArrow(run, "id bigint, set array<bigint>").dropDuplicates(["id"])

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that link."""
        pairs = keep(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return pairs
        sets = keep(self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "sets")
        both = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b")
        shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        linked = keep(both.where(shared >= F.lit(self.similarity) * (total - shared)).select("a", "b"), "linked")
        drop(pairs, sets)
        return linked


def by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Candidates (a, b) of distinct(id, fp): texts of one fingerprint, and one text each of fingerprints that the SimHash operator links."""
    of = keep(distinct.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    one = distinct.select("fp", F.col("id").alias("a")).join(of.withColumnRenamed("id", "b"), "fp").where("a <> b").select("a", "b")
    near = simhash_links(of.select("fp"), MAX_BITS).withColumnsRenamed({"a": "fa", "b": "fb"})
    two = near.join(of.select(F.col("fp").alias("fa"), F.col("id").alias("a")), "fa").join(of.select(F.col("fp").alias("fb"), F.col("id").alias("b")), "fb").select("a", "b")
    return one.union(two)


def links(distinct: DataFrame, verified: Verifier) -> DataFrame:
    """Edges (a, b) between the ids of distinct(id, n, fp, bits, prefix) that connect exactly what chains of links connect."""
    s = verified.similarity

    def can(n: Column, at: Column, m: Column, to: Column) -> Column:
        """Whether sets of n and m shingles whose first shared one is at these places can reach the similarity."""
        return F.least(n - at, m - to) >= F.lit(s / (1 + s)) * (n + m) - 1e-6

    def differ(a: Column, b: Column) -> Column:
        return reduce(Column.__add__, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITIES // 64)))

    # one exchange serves the count and the join
    postings = distinct.select("id", "n", F.posexplode("prefix").alias("at", "key")).withColumn("first", F.col("at") < early(F.col("n"), s)).repartition("key")
    more = postings.groupBy("key").agg(F.count("*").alias("many"), F.max("first").alias("any")).where("many > 1 and any").drop("any")
    lists = keep(postings.join(more, "key"), "lists")
    order = F.xxhash64("id").alias("order")
    heads = lists.groupBy("key").agg(F.min(F.struct("at", order, "id", "n")).alias("least"), F.max(F.struct(order, "id", "n", "at")).alias("other"))
    dealt = lists.join(heads, "key")
    ends = [dealt.where(can(F.col("n"), F.col("at"), F.col(f"{e}.n"), F.col(f"{e}.at"))).select(F.greatest("id", f"{e}.id").alias("a"), F.least("id", f"{e}.id").alias("b")) for e in ("least", "other")]
    edges = verified(by_fingerprint(distinct).union(ends[0]).union(ends[1]).where("a <> b"))
    rooted = keep(lists.join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    apart = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    split = rooted.join(apart.select("key"), "key", "left_semi").withColumn("class", size_class(F.col("n"), F.col("at")))
    classes = split.groupBy("key", "class").agg(*(f("n").alias(f"n{k}") for k, f in enumerate((F.min, F.max))), F.max(F.col("n") - F.col("at")).alias("left"), F.max("first").alias("first"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("many"))
    classes = keep(classes.withColumn("blocks", F.ceil(F.col("many") / BLOCK)), "classes")
    now = keep(split.join(classes.select("key", "class", "blocks"), ["key", "class"]).join(distinct.select("id", "bits"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "apart")
    drop(lists, rooted)
    # x is the smaller one of each pair, or as large
    cx, cy = (classes.select("key", *(F.col(c).alias(c + k) for c in classes.columns[1:])) for k in "xy")
    fit = F.least("leftx", "lefty") >= F.lit(s / (1 + s)) * (F.col("n0x") + F.greatest("n0x", "n0y")) - 1e-6
    one_root = (F.col("r0x") == F.col("r1x")) & (F.col("r0x") == F.col("r0y")) & (F.col("r0x") == F.col("r1y"))
    units = cx.where("firstx").join(cy, "key").where(F.col("n0x") <= F.col("n1y")).where(fit & ~one_root)
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    units = units.select("key", "classx", "classy", "blocksy", span("blocksx").alias("blockx")).select("key", "classx", "classy", "blockx", span("blocksy").alias("blocky"))
    x, y = (now.select("key", *(F.col(c).alias(c + k) for c in ("class", "block", "id", "n", "at", "first", "root", "bits"))) for k in "xy")
    met = units.join(x.where("firstx"), ["key", "classx", "blockx"]).join(y, ["key", "classy", "blocky"])
    across = (F.col("rootx") != F.col("rooty")) & (F.struct("nx", "idx") < F.struct("ny", "idy")) & can(F.col("nx"), F.col("atx"), F.col("ny"), F.col("aty"))
    near = differ(F.col("bitsx"), F.col("bitsy")) <= F.lit((1 - s) / (1 + s)) * (F.col("nx") + F.col("ny")) + 1e-6
    out = edges.union(verified(met.where(across & near).select(F.col("idx").alias("a"), F.col("idy").alias("b"))))
    drop(now, classes)
    return out


def size_class(n: Column, at: Column) -> Column:
    """Sets of like size in which a list's shingle has like places: exact below 64, then sixteen sizes an octave."""
    fine = F.floor(16 * F.log2(n / 64)) + 64
    size, place = F.when(n < 64, n).otherwise(fine), F.when(n < 64, at).otherwise(F.floor(at * 64 / n))
    return (size * 64 + place).cast("int")


def without_near_copies(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each group, all columns as they were."""
    prints = keep(prefixes_of(docs, size, seed, similarity), "prints")
    first = {c: F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")}
    grouped = prints.groupBy("c0", "c1").agg(F.min(F.struct("doc_id", "k0", "k1")).alias("least"), *first.values())
    distinct = keep(grouped.select(F.monotonically_increasing_id().alias("id"), "least.*", *first), "distinct")
    drop(prints)
    roots = components(links(distinct, Verifier(docs, distinct, size, seed, similarity)))
    rooted = distinct.select("id", "doc_id", "k0", "k1").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    n0, n1 = spare(docs.columns, "k0"), spare(docs.columns, "k1")
    keepers = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "k0", "k1")).alias("least")).select(F.col("least.k0").alias(n0), F.col("least.k1").alias(n1))
    k0, k1 = key_of()
    return docs.withColumns({n0: k0, n1: k1}).join(keepers, [n0, n1], "left_semi").dropDuplicates([n0, n1]).select(*docs.columns)
