"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters and words, of the line itself and of the
lines before and after it; the chain adds weights for first states and for transitions. Documents label all of their
lines for the first fit; a second fit lets the model take back lines of bad documents that it finds clearly good.
Forward-backward gives each line's probability of being good; their mean weighted by length, calibrated on the
training documents, is the document's score.

The model is fitted on at most ``MAX_DOCS`` labelled documents (half of each class, those of least hash of their id),
whole documents all of them, and on so many of these that they have ``MAX_LINES`` lines together at most; scoring reads
every line of every document. Null texts count as empty, an empty text
as one empty line. Labels that are null are left out; of repeated labels the least counts. Without labels of both
classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop, keep

MAX_DOCS, MAX_LINES, STEPS, L2 = 6_000, 1_000_000, 150, 1e-3

#: Kinds of bytes, for counting: 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence marks, 6 symbols, 7 beyond ASCII, 8 newline
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 7
KIND[[9, 11, 12, 13, 32]], KIND[10] = 4, 8
KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
WIDTH = 16


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, weight of each line), empty lines left out unless there is nothing else."""
    data = np.frombuffer((text or "").encode() + b"\n", np.uint8)
    kind = KIND[data]
    ends = np.flatnonzero(kind == 8)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    count = lambda flags: np.add.reduceat(flags.astype(np.int32), starts)
    n = {k: count(kind == k) for k in range(1, 8)}
    gap = (kind == 4) | (kind == 8)
    first = ~gap & np.concatenate([[True], gap[:-1]])
    words = count(first)
    capital = count(first & (kind == 2))
    previous = np.concatenate([[8], kind[:-1]])
    shouted = count((kind == 2) & (previous == 2))
    stuck = count((kind == 6) & (previous == 6))
    change = count(np.concatenate([[False], data[1:] == data[:-1]]) & (kind != 8))
    used = np.flatnonzero(words > 0)
    if not len(used):
        used = np.array([0])
    s, w = np.maximum(size[used], 1), np.maximum(words[used], 1)
    out = np.empty((len(used), WIDTH))
    for i, k in enumerate(range(1, 8)):
        out[:, i] = n[k][used] / s
    out[:, 7], out[:, 8], out[:, 9] = capital[used] / w, shouted[used] / s, stuck[used] / w
    out[:, 10], out[:, 11], out[:, 12] = change[used] / s, np.log1p(words[used]), np.minimum(s / w, 40) / 10
    out[:, 13] = np.minimum(n[6][used] / w, 4)
    out[:, 14] = np.add.reduceat((data == 124).astype(np.int32), starts)[used] / w
    lines = (text or "").split("\n")
    split = [lines[i].lower().split() for i in used.tolist()]
    out[:, 15] = [len(set(x)) / (len(x) + 1) for x in split]
    return out, s.astype(float)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, square roots of shares, those of the lines around, and marks of the ends."""
    zero = np.zeros((1, x.shape[1]))
    before, after = np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero])
    ends = np.zeros((len(x), 3))
    ends[0, 0] = ends[-1, 1] = ends[:, 2] = 1
    return np.hstack([x, np.sqrt(np.abs(x)), before, after, ends])


FEATURES = 4 * WIDTH + 3


def present(lengths: list[int]) -> np.ndarray:
    """documents x lines: true where a line is."""
    return np.arange(max(lengths))[None, :] < np.array(lengths)[:, None]


def spread(flat: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Values of all lines, as documents x lines with zeros where there is none."""
    out = np.zeros(there.shape)
    out[there] = flat
    return out


def forward_backward(unary: np.ndarray, pair: np.ndarray, there: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """unary: documents x lines, log odds of good. Returns P(good) of each line and, if asked for, pair counts (2 x 2).

    Messages are scaled to sum 1 at each line, so texts of any length neither overflow nor vanish.
    """
    odds, on = np.exp(np.clip(unary, -60, 60)).T, there.T.astype(float)
    m = np.exp(pair - pair.max())
    t, d = odds.shape
    alpha, beta = np.empty((2, t, d)), np.ones((2, t, d))
    alpha[1, 0] = odds[0] / (1 + odds[0])
    alpha[0, 0] = 1 - alpha[1, 0]
    for i in range(1, t):
        bad, good = alpha[0, i - 1], alpha[1, i - 1]
        x, y = bad * m[0, 0] + good * m[1, 0], (bad * m[0, 1] + good * m[1, 1]) * odds[i]
        z = x + y
        alpha[0, i], alpha[1, i] = x / z, y / z
    for i in range(t - 2, -1, -1):
        bad, good = beta[0, i + 1], beta[1, i + 1] * odds[i + 1]
        x, y = m[0, 0] * bad + m[0, 1] * good, m[1, 0] * bad + m[1, 1] * good
        z = x + y
        beta[0, i], beta[1, i] = 1 + on[i + 1] * (x / z - 1), 1 + on[i + 1] * (y / z - 1)
    g = alpha[1] * beta[1]
    good = (g / (g + alpha[0] * beta[0])).T
    if not pairs:
        return good, None
    joint = np.empty((2, 2, t - 1, d))
    for i in (0, 1):
        for j in (0, 1):
            joint[i, j] = alpha[i, :-1] * m[i, j] * (odds[1:] if j else 1.0) * beta[j, 1:]
    return good, (joint / joint.sum((0, 1)) * on[1:]).sum((2, 3))


def like_lengths(lengths: list[int]) -> Iterator[list[int]]:
    """Places of documents in groups of like length, of bounded size."""
    order, at = sorted(range(len(lengths)), key=lengths.__getitem__), 0
    while at < len(order):
        least = lengths[order[at]]
        most = max(1, 200_000 // (2 * least + 8))
        part = [i for i in order[at : at + most] if lengths[i] <= 2 * least + 8]
        at += len(part)
        yield part


class Model:
    """Weights of the chain, and of the calibration of a document's mean."""

    def __init__(self) -> None:
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.w, self.pair, self.a, self.b = np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 0.0

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def fit_chain(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Adam on the mean log likelihood of the lines' labels; groups have lines x features, and documents x lines of what is there and of labels."""
        n = sum(len(flat) for flat, _, _ in groups)
        given = np.zeros((2, 2))
        for _, there, y in groups:
            for i in (0, 1):
                for j in (0, 1):
                    given[i, j] += ((y[:, :-1] == i) & (y[:, 1:] == j) & there[:, 1:]).sum()
        state = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
        for step in range(1, STEPS + 1):
            slope, counts = np.zeros(FEATURES), np.zeros((2, 2))
            for flat, there, y in groups:
                good, joint = forward_backward(spread(flat @ self.w.astype(np.float32), there), self.pair, there, pairs=True)
                slope += (y[there] - good[there]).astype(np.float32) @ flat
                counts += joint
            g = np.concatenate([slope / n - L2 * self.w, ((given - counts) / n - L2 * self.pair).ravel()])
            state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g
            move = 0.1 * (1 - 0.9 * step / STEPS) * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
            self.w, self.pair = self.w + move[:FEATURES], self.pair + move[FEATURES:].reshape(2, 2)

    def means(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of P(good) of each document; documents of like length go together."""
        out, lengths = np.empty(len(docs)), [len(f) for f, _ in docs]
        for part in like_lengths(lengths):
            there = present([lengths[i] for i in part])
            odds = np.concatenate([self.unary(with_neighbours(docs[i][0])) for i in part])
            good, _ = forward_backward(spread(odds, there), self.pair, there)
            for i, g in zip(part, good):
                w = docs[i][1]
                out[i] = (g[: len(w)] * w).sum() / w.sum()
        return out

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * (self.means(docs) - 0.5) + self.b, -30, 30)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    m = Model()
    if len(set(labels.tolist())) < 2:
        return m
    lengths = [len(f) for f, _ in docs]
    groups = []
    for part in like_lengths(lengths):
        there = present([lengths[i] for i in part])
        groups.append((np.vstack([with_neighbours(docs[i][0]) for i in part]).astype(np.float32), there, np.repeat(labels[part][:, None], there.shape[1], 1).astype(float)))
    n = sum(lengths)
    m.mean = sum(x.sum(0, dtype=float) for x, _, _ in groups) / n
    parts = lambda x: np.array_split(x, 1 + len(x) // 4_096)
    m.scale = np.sqrt(sum(((p - m.mean) ** 2).sum(0) for x, _, _ in groups for p in parts(x)) / n) + 1e-6
    m.mean[-1], m.scale[-1] = 0, 1
    for x, _, _ in groups:  # in place: the sample is in memory once
        x -= m.mean.astype(np.float32)
        x /= m.scale.astype(np.float32)
    m.fit_chain(groups)
    again = []
    for x, there, y in groups:
        good, _ = forward_backward(spread(x @ m.w.astype(np.float32), there), m.pair, there)
        sure = good >= 0.9
        sure[(good * there).sum(1) >= 0.9 * there.sum(1)] = False  # a bad document keeps some bad line
        again.append((x, there, np.where(sure, 1.0, y)))
    m.fit_chain(again)
    # calibration: a logistic curve through the training documents, by Newton steps
    mean = m.means(docs) - 0.5
    t = np.stack([mean, np.ones_like(mean)], 1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(t @ c, -30, 30)))
        h = (t * (p * (1 - p) + 1e-9)[:, None]).T @ t + 1e-2 * np.eye(2)
        c = c + np.linalg.solve(h, t.T @ (labels - p) - 1e-2 * c)
    m.a, m.b = max(float(c[0]), 0.0), float(c[1])
    return m


def held_out(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels(doc_id, quality) of documents that aren't held out, at most MAX_DOCS of them."""
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id"), 4))
    rank = F.xxhash64("doc_id")
    picked = usable.where("quality = 1").orderBy(rank, "doc_id").limit(MAX_DOCS // 2).union(usable.where("quality = 0").orderBy(rank, "doc_id").limit(MAX_DOCS // 2))
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # MAX_DOCS ids and labels

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [line_features(t.as_py()) for t in batch.column(1)]
            pack = lambda k: pa.array([x[k].astype("<f4").tobytes() for x in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pack(0), pack(1), pa.array([len(x[1]) for x in got])], names=["doc_id", "quality", "x", "w", "lines"])

    rows = keep(chosen.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(features, "doc_id bigint, quality int, x binary, w binary, lines bigint"), "sample")
    # of rows that repeat an id the shortest count, so no more than MAX_DOCS numbers are gathered
    one = rows.groupBy("doc_id").agg(F.min("lines").alias("lines")).select("doc_id", "lines", rank.alias("rank"))
    total, taken = 0, set()
    for r in sorted(one.collect(), key=lambda r: (r["rank"], r["doc_id"])):
        if total + r["lines"] <= MAX_LINES:
            taken.add((r["doc_id"], r["lines"]))
            total += r["lines"]
    few = docs.sparkSession.createDataFrame(sorted(taken), "doc_id bigint, lines bigint")
    got = rows.join(F.broadcast(few), ["doc_id", "lines"], "left_semi").orderBy("doc_id", "x").limit(MAX_DOCS).collect()
    drop(rows)
    data = [(np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH), np.frombuffer(r["w"], "<f4").astype(float)) for r in got]
    return fit(data, np.array([float(r["quality"]) for r in got]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column (0 to 1, higher is better) after its own columns; name it as none of these."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                s = model.scores([line_features(t.as_py()) for t in part.column(text)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
