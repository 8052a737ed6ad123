"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are encoded, end id included, and those beyond the capacity are cut. Pieces are dealt by hash into regions of
some ``REGION`` pieces, which are packed apart. Each region is bred on ``ISLANDS`` islands, a task's work each, in
``EPOCHS`` epochs; between epochs every island's best packing replaces the next island's worst, by a join.

An individual is a packing: the bin of each piece. The first is best fit in descending order, the others best fit after
small shuffles of that order. A child starts as one parent; whole bins of the other, the fuller the likelier, are
injected, bins that hold a piece of these are emptied, and the displaced pieces are put back by best fit, along with those
of a few of the emptiest bins (mutation). Fitness is the mean of squared fills, after the number of bins. An island rests
once its best needs no more bins than the total asks for.

What regions leave over goes on: bins filled under ``FULL`` are dealt into regions again, whole, and are the packing to
start from there, so no round needs more bins than before. Regions become fewer each time, until one holds all that is
left or they don't. So a thousandth of the bins and one more are lost overall at most where sizes allow it, and neither
a task nor the driver ever holds more than a region.

Null texts count as empty (a piece of the end id), null ids are ids like others, repeated rows are documents each. A
piece of the whole capacity is a sequence of its own. Random choices come from seeds of region, island and epoch, so
retried tasks give the same packing. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, keep
from .token_store import encode_texts

CAPACITY = 4_096
#: Pieces packed together, on average.
REGION = 2_048
ISLANDS, EPOCHS = 3, 3
#: Packings on each island, and children of each epoch.
POPULATION, CHILDREN = 4, 8
#: Bins filled to this share stay as they are when regions are merged.
FULL = 0.999
#: Rounds at most; regions become fewer in each.
ROUNDS = 40


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text): whole documents, longer ones cut; row is a number of the piece's own."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                payload, width = encode_texts(part.column(1).to_pylist(), tokenizer, end_id)
                out = []
                for doc, p in zip(part.column(0).to_pylist(), payload):
                    ids = np.frombuffer(p, f"<u{width}")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity].astype("<u4")
                        out.append((row, doc, k, at, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else [])))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], names=list(kinds))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


class Region:
    """Packings of the pieces of one region; lengths are at most the capacity."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-int(self.lengths.sum()) // capacity)

    def best_fit(self, bins: np.ndarray, order: np.ndarray) -> np.ndarray:
        """bins with the pieces of this order, -1 so far, each put where the least room is left."""
        bins = bins.copy()
        placed = bins >= 0
        used = int(bins.max(initial=-1)) + 1
        room = (self.capacity - np.bincount(bins[placed], self.lengths[placed], minlength=used).astype(np.int64)).tolist()
        holders: dict[int, list[int]] = {}
        open_rooms = 0  # bit r: some bin has room r
        for b, r in enumerate(room):
            if r:
                holders.setdefault(r, []).append(b)
                open_rooms |= 1 << r
        for i, n in zip(order.tolist(), self.lengths[order].tolist()):
            fits = open_rooms >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                same = holders[r]
                b = same.pop()
                if not same:
                    open_rooms ^= 1 << r
            else:
                b, r = used, self.capacity
                used += 1
            bins[i] = b
            if r > n:
                left = r - n
                if holders.setdefault(left, []):
                    holders[left].append(b)
                else:
                    holders[left] = [b]
                    open_rooms |= 1 << left
        return bins

    def fresh(self, noise: float) -> np.ndarray:
        key = self.lengths * (1 + noise * self.rng.standard_normal(len(self.lengths))) if noise else self.lengths
        return self.best_fit(np.full(len(self.lengths), -1), np.argsort(-key, kind="stable"))

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths)

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        f = self.fills(bins)
        return -len(f), float(np.mean((f / self.capacity) ** 2))

    def child(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """one, with some of the fullest bins of the other."""
        f = self.fills(other)
        share = self.rng.uniform(0.1, 0.5)
        pick = self.rng.random(len(f)) * (f / self.capacity) ** 8
        injected = np.zeros(len(f), bool)
        injected[np.argsort(-pick)[: max(1, int(share * len(f)))]] = True
        mine = injected[other]
        g = self.fills(one)
        gone = np.zeros(len(g), bool)
        gone[one[mine]] = True  # they hold a piece of an injected bin
        emptiest = np.argsort(g + self.rng.random(len(g)))[: 1 + len(g) // 50]
        gone[emptiest] = True
        bins = np.where(gone[one], -1, one)
        bins[mine] = len(g) + other[mine]
        kept = bins >= 0
        bins[kept] = np.unique(bins[kept], return_inverse=True)[1]
        lost = np.flatnonzero(~kept)
        return self.best_fit(bins, lost[np.argsort(-self.lengths[lost], kind="stable")])

    def evolve(self, population: list[np.ndarray], children: int) -> list[np.ndarray]:
        """The population, best first, after as many children; each replaces the worst if it is better."""
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
        for k in range(children):
            if -ranked[0][0][0] <= self.least:
                break
            a, b = self.rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
            made = self.child(ranked[min(a, b)][2], ranked[max(a, b)][2])
            new = (self.fitness(made), -1 - k, made)
            if new[0] > ranked[-1][0]:
                ranked = sorted([*ranked[:-1], new], key=lambda x: (x[0], -x[1]), reverse=True)
        return [p for _, _, p in ranked]


def bred(regions: DataFrame, capacity: int) -> DataFrame:
    """(region, rows, lengths, bins): the best packing of each of regions(region, rows, lengths, old); old bins, if not null, are one to start from."""
    schema = "region bigint, island int, rows array<bigint>, lengths array<bigint>, population array<array<int>>, bins int, least int"
    names = ["region", "island", "rows", "lengths", "population", "bins", "least"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.int32()]

    def step(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for region, island, rows, lengths, before, guest in zip(*(batch.column(c) for c in range(6))):
                    space = Region(lengths.values.to_numpy(), capacity, zlib.crc32(f"{region} {island} {epoch}".encode()))
                    population = [x.values.to_numpy() for x in before] if before.is_valid else []
                    if guest.is_valid:
                        population[-1:] = [np.unique(guest.values.to_numpy(), return_inverse=True)[1]]
                    if not epoch:
                        population.append(space.fresh(0.0))
                        if population[-1].max() + 1 > space.least:
                            population += [space.fresh(0.02 * (1 + island.as_py()) * k) for k in range(len(population), POPULATION)]
                    population = space.evolve(population, CHILDREN)
                    values = (region.as_py(), island.as_py(), rows.values.to_numpy(), lengths.values.to_numpy(), population, len(space.fills(population[0])), space.least)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        return run

    spread = regions.select("region", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "rows", "lengths", F.lit(None).cast("array<array<int>>").alias("population"), F.col("old").alias("guest"))
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = keep(spread.repartition(parts, "region", "island").mapInArrow(step(0), schema), "islands")
    for epoch in range(1, EPOCHS):
        elite = now.where("bins > least").select("region", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].cast("array<bigint>").alias("guest"))
        met = now.where("bins > least").join(elite, ["region", "island"], "left").select("region", "island", "rows", "lengths", "population", "guest")
        open_ = keep(met.mapInArrow(step(epoch), schema), "islands")
        new = keep(now.where("bins <= least").unionByName(open_), "islands")
        drop(now, open_)
        now = new
    best = keep(now.groupBy("region").agg(F.min_by(F.struct("rows", "lengths", F.col("population")[0].alias("bins")), F.struct("bins", "island")).alias("b")).select("region", "b.*"), "best")
    drop(now)
    return best


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, sequence_id, offset) of items(row, length), whose rows are numbers of their own and lengths from 1 to the capacity."""
    whole = items.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = keep(items.where(F.col("length") < capacity).select("row", "length", F.lit(None).cast("bigint").alias("bin")), "items")
    n = left.count()
    done, places = whole, "row bigint, sequence_id bigint, offset bigint, length bigint, fill bigint"

    def placed(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for region, rows, lengths, bins in zip(*(batch.column(c) for c in range(4))):
                    rows, lengths, bins = (x.values.to_numpy().astype(np.int64) for x in (rows, lengths, bins))
                    order = np.argsort(bins, kind="stable")
                    rows, lengths, bins = rows[order], lengths[order], bins[order]
                    before = np.cumsum(lengths) - lengths
                    first = np.searchsorted(bins, bins)
                    fill = np.bincount(bins, lengths).astype(np.int64)[bins]
                    sequence = (number << 56) + (region.as_py() << 16) + bins
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, sequence, before - before[first], lengths, fill)], names=["row", "sequence_id", "offset", "length", "fill"])

        return run

    for number in range(1, ROUNDS + 1):
        regions = -(-n // REGION)
        if not regions:
            break
        region = F.pmod(F.xxhash64(F.coalesce("bin", "row"), F.lit(number)), F.lit(regions)).alias("region")
        dealt = left.select(region, F.struct("row", "length", "bin").alias("item")).groupBy("region").agg(F.array_sort(F.collect_list("item")).alias("items"))  # REGION on average
        old = F.when(F.col("items")[0]["bin"].isNotNull(), F.col("items.bin"))
        best = bred(dealt.select("region", F.col("items.row").alias("rows"), F.col("items.length").alias("lengths"), old.alias("old")), capacity)
        put = keep(best.select("region", "rows", "lengths", "bins").mapInArrow(placed(number), places), "placed")
        drop(left, best)
        part = ["row", "sequence_id", "offset"]
        full = F.col("fill") >= FULL * capacity
        more = regions > 1 and number < ROUNDS
        rest = keep(put.where(~full).select("row", "length", F.col("sequence_id").alias("bin")), "items") if more else None
        m = rest.count() if rest is not None else 0
        # regions that become no fewer had no room to share
        if rest is None or -(-m // REGION) >= regions:
            done = done.unionByName(put.select(part))
            break
        done = done.unionByName(put.where(full).select(part))
        left, n = rest, m
    return done


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of docs(doc_id, text): where each piece stands."""
    cut = keep(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    return cut.join(pack(cut.select("row", "length"), capacity), "row").drop("row")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of what ``packed`` gives with ids: pieces in the order of their places, a capacity of ids at most."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
