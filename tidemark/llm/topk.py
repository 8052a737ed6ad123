"""Exact top-k by inner product, pruned with segment statistics at several resolutions.

With a vector cut into segments of means m and deviations s, the squared distance of x and q is at least the sum over
segments of length * ((mx - mq)^2 + (sx - sq)^2). As x.q = (|x|^2 + |q|^2 - |x - q|^2) / 2, a lower bound of the
distance is an upper bound of the score. Bounds go from one segment to many; a candidate that can't reach a query's
k-th best score so far is dropped for that query, and what survives all of them is scored exactly in integers.

Queries are taken in blocks of bounded size, files of the shared folder that tasks read; no vector passes the driver. A
task takes one block to one share of the rows, so all blocks are at work at once, ``AT_ONCE`` in one job at most. It
returns its best k for each query, and a window picks the best of these. Components are held to 64 bits, scores too (those beyond count as the nearest number that
fits, so they tie). Vectors that are null, empty, or hold null or non-finite components
take no part, nor do rows without an id, neither as candidates nor as queries; vectors meet those of their own length. A repeated id is one query (its least vector) and as many
candidates as it has rows. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep, scratch

#: Numbers in a block of queries: 4 million are 32 MB.
BLOCK_NUMBERS = 4_000_000
#: Blocks in one job.
AT_ONCE = 64
STRIDE = 1_024


def integers(v: Column, scale: int = 1024) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(v: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, ok)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * (mean, deviation) of each segment: distances of features are the lower bounds."""
    out = []
    for part in np.array_split(x, segments, axis=1):
        w = np.sqrt(part.shape[1])
        out += [w * part.mean(1), w * part.std(1)]
    return np.stack(out, 1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them exactly while they are small enough, Python's integers always."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best of each query so far: scores (least possible if none) and ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.scores, self.found = np.full((len(q), k), -(2**63), np.int64), np.full((len(q), k), 2**63 - 1, np.int64)
        self.filled = np.zeros((len(q), k), bool)
        self.levels = [s for s in (1, 2, 4, 8, 16, 32) if s <= max(1, q.shape[1] // 2)]
        self.qf = [segment_features(q.astype(float), s) for s in self.levels]
        self.qn = (q.astype(float) ** 2).sum(1)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = self.ids[:, None] != ids[None, :]
        floor = np.where(self.filled.all(1), self.scores[:, -1], -np.inf)
        xd = x.astype(float)
        xn = (xd**2).sum(1)
        for s, qf in zip(self.levels, self.qf):
            cols = np.flatnonzero((alive & np.isfinite(floor)[:, None]).any(0))
            if not len(cols):
                break
            xf = segment_features(xd[cols], s)
            least = (qf**2).sum(1)[:, None] + (xf**2).sum(1)[None, :] - 2 * qf @ xf.T
            most = (self.qn[:, None] + xn[None, cols] - least) / 2
            alive[:, cols] &= most + 1e-9 * (self.qn[:, None] + xn[None, cols]) + 1 >= floor[:, None]
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return
        score = exact_scores(self.q[rows], x[cols])
        ok = np.hstack([self.filled[rows], alive[np.ix_(rows, cols)]])
        score = np.hstack([self.scores[rows], score])
        found = np.hstack([self.found[rows], np.broadcast_to(ids[cols], (len(rows), len(cols)))])
        order = np.lexsort((found, -score.astype(float) if np.abs(score[ok].astype(float)).max(initial=0) < 2**53 else ~score, ~ok), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows], self.filled[rows] = (np.take_along_axis(v, order, 1) for v in (score, found, ok))


def read_block(folder: str, block: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a block of queries, by the vectors' length."""
    import pyarrow.parquet as pq

    system, path = fs.FileSystem.from_uri(folder)
    names = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
    out: dict[int, list] = {}
    for name in names:
        with system.open_input_file(name) as f:
            table = pq.ParquetFile(f).read().combine_chunks()
        ids, lists = table["vec_id"].to_numpy(), table["v"].combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            out.setdefault(d, []).append((ids[at], np.asarray(lists.take(pa.array(at)).flatten()).reshape(-1, d)))
    return {d: tuple(np.concatenate(x) for x in zip(*parts)) for d, parts in out.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors and queries: (vec_id, v) with v array<bigint>; returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    queries = keep(queries.where("vec_id is not null and size(v) > 0").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (width or 1) // BLOCK_NUMBERS))
    folder = scratch(spark, "blocks")
    queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(min(blocks, 1_000), "block").write.partitionBy("block").parquet(folder)
    candidates = vectors.where("vec_id is not null").select("vec_id", "v")

    def best_of(block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if best is None:
                    best = {d: Best(*pair, k) for d, pair in read_block(folder, block).items()}
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.asarray(lists.value_lengths())
                for d, found in best.items():
                    at = np.flatnonzero(sizes == d)
                    for i in range(0, len(at), STRIDE):
                        part = at[i : i + STRIDE]
                        found.add(ids[part], np.asarray(lists.take(pa.array(part)).flatten()).reshape(-1, d))
            for found in (best or {}).values():
                q = np.broadcast_to(found.ids[:, None], found.filled.shape)[found.filled]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, found.found[found.filled], found.scores[found.filled])], names=["query_id", "vec_id", "score"])

        return candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")

    jobs = []
    for first in range(0, blocks, AT_ONCE):
        job = reduce(DataFrame.unionByName, map(best_of, range(first, min(blocks, first + AT_ONCE))))
        jobs.append(job if blocks <= AT_ONCE else keep(job, "best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, jobs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
