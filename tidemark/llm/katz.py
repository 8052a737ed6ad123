"""Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

    P(w | u) = d(c(uw)) c(uw) / c(u)   if c(uw) > 0
             = alpha(u) P(w)           otherwise, with alpha(u) = what the discounts free / (1 - sum of P over words seen after u)
    P(w)     = d(c(w)) c(w) / N        if c(w) > 0, and the mass that the discounts free for all unknown words together

Counts up to K are discounted by Good-Turing, each of them for which this gives a discount between 0 and 1, by an absolute
discount otherwise (small corpora have no or odd counts of counts); a context
in which nothing is discounted gets one count for what it hasn't seen. The context of a text's first word is the end.

How it runs: texts are coded in batches of about ``BATCH_TOKENS`` tokens, each with a vocabulary of its own sorted by
hash. A batch asks for every distinct word and word pair once, in one row for each bucket, so a frequent word or pair
is one entry a batch and no bucket gets hot by it; contexts so frequent that their pairs would fill a bucket are dealt
over all buckets by pair. A bucket sums what its batches counted, keeps its part of the count tables, and answers each
batch in the order of its question. What the buckets know of a frequent context is summed where its word is, and goes
from there to the batches that have it. Counts of counts, a row a bucket, are all that reaches the driver. Buckets grow in
number with the documents, not in size; exchanges have a partition for each bucket or batch, ``PARTITIONS`` at most, and a
task has one bucket or batch in memory at a time. Words are known by a hash of 64 bits: two words of
one hash, which 10^9 distinct words make likely once in 40 corpora, count as one.

Null texts count as empty; an empty text is one end token. Rows with a null id are taken as id text ''. Repeated rows
count and score each for itself. Without training rows every word is unknown and unknown words have all the mass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .crf_quality import held_out
from .simhash import LOWER

K = 5
BATCH_TOKENS = 2_000_000
ROWS_PER_BUCKET = 2_000
#: Partitions of an exchange at most.
PARTITIONS = 10_000


def pack(x: np.ndarray) -> bytes:
    """Compressed by place: all first bytes of the numbers, then all second ones, so high bytes cost little."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    if not b:
        return np.empty(0, kind)
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(places.T).reshape(-1).view(kind)


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    """How many counts are 1, ..., K + 1; and how many there are in all."""
    return np.array([*((c == i).sum() for i in range(1, K + 2)), (c > 0).sum()], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0), ..., d(K) from counts of counts; d(0) is unused. Higher counts keep 1."""
    d = np.ones(K + 1)
    n = n[: K + 1].astype(float)
    cut = (K + 1) * n[K] / n[0] if n[0] else 1.0
    b = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    for c in range(1, K + 1):
        ratio = ((c + 1) * n[c] / (c * n[c - 1]) - cut) / (1 - cut) if n[c - 1] and cut < 1 else 0.0
        d[c] = ratio if 0 < ratio < 1 else (c - b) / c
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.where(c <= K, c, 0)] if len(c) else c.astype(float)


class Unigrams:
    """Probabilities of words by their count."""

    def __init__(self, n: np.ndarray, total: int):
        d = discounts(n)
        d[0] = 1
        self.d, self.total = d, total
        freed = sum(int(n[c - 1]) * c * (1 - d[c]) for c in range(1, K + 1))
        self.known = 1 / total if total else 0.0
        self.unknown = freed / total if total else 1.0
        if total and freed <= 0:  # nothing is that rare: one count for the unknown
            self.known, self.unknown = 1 / (total + 1), 1 / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.known, self.unknown)


class Batch:
    """A coded batch: tokens are places in its vocabulary in the order of hashes; each text is followed by end.

    A row has tokens by frequency, which takes less room, with the place of each, and the cuts of places by bucket.
    """

    def __init__(self, row: dict, buckets: int):
        self.row, self.buckets = row, buckets
        place, self.cuts = unpack(row["hashes"], "<u4").astype(np.int64), unpack(row["counts"], "<i8")
        self.tokens, self.sizes, self.n = place[unpack(row["tokens"], "<u4")], unpack(row["sizes"], "<i8"), len(place)
        self.train = unpack(row["train"], "u1")
        self.word_bucket = np.repeat(np.arange(buckets), np.diff(self.cuts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[self.starts] = int(row["end"])

    def pairs(self, heavy: np.ndarray, ids: np.ndarray) -> None:
        """Distinct pairs in the order of their buckets: u, w (places), inverse (pair of each token), slices by bucket."""
        key, inverse = np.unique(self.context << 32 | self.tokens, return_inverse=True)
        u, w = key >> 32, key & 0xFFFFFFFF
        spread = (mix(ids[u].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ids[w].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        bucket = np.where(heavy[u], spread, self.word_bucket[u])
        order = np.argsort(bucket, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.u, self.w, self.inverse = u[order], w[order], back[inverse]
        self.slices = np.searchsorted(bucket[order], np.arange(self.buckets + 1))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


CODED = "kind string, batch bigint, bucket int, ids binary, train binary, sizes binary, tokens binary, hashes binary, counts binary, end bigint"
ANSWER = "kind string, batch bigint, bucket int, a binary, b binary, c binary"


def table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields})


def code(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, text, train) as rows of kind d (a batch) and w (its words of one bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, train, sizes, tokens, words = [], [], [], [], defaultdict()

        def start() -> None:
            words.clear()
            words.default_factory = words.__len__
            words[b""]  # the end
            for x in (ids, train, sizes, tokens):
                x.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            raw, size, of = np.concatenate(tokens), np.array(sizes, np.int64), np.array(train, bool)
            counts = np.bincount(rank[raw[np.repeat(of, size)]], minlength=len(order)).astype("<u4")
            common = np.argsort(-np.bincount(raw, minlength=len(order)), kind="stable")
            by_use = np.empty_like(common)
            by_use[common] = np.arange(len(common))
            hashes, name = hashes[order], part << 24 | n
            cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
            rows = [{"kind": "d", "batch": name, "ids": pack(np.array([i or 0 for i in ids], "<i8")), "train": pack(np.array([2 * (i is None) + b for i, b in zip(ids, train)], "u1")), "sizes": pack(size.astype("<i8")), "tokens": pack(by_use[raw].astype("<u4")), "hashes": pack(rank[common].astype("<u4")), "counts": pack(cuts.astype("<i8")), "end": int(rank[0])}]
            rows += [{"kind": "w", "batch": name, "bucket": b, "hashes": pack(hashes[i:j]), "counts": pack(counts[i:j])} for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            yield from table(CODED, rows).to_batches()

        start()
        total = 0
        for batch in batches:
            for i, text, of in zip(batch.column(0), batch.column(1), batch.column(2)):
                got = [*map(words.__getitem__, (text.as_py() or "").encode().translate(LOWER).split()), 0]
                ids.append(i.as_py())
                train.append(of.as_py())
                sizes.append(len(got))
                tokens.append(np.array(got, np.int32))
                total += len(got)
                if total >= BATCH_TOKENS:
                    yield from finish()
                    n, total = n + 1, 0
                    start()
        if ids:
            yield from finish()

    return keep(docs.select("doc_id", "text", "train").mapInArrow(run, CODED), "coded")


def count_words(group: pa.Table) -> pa.Table:
    """A bucket's word counts: a table row, an answer (count and number of each word asked for) for each batch, counts of counts."""
    asked = [unpack(h, "<u8") for h in group["hashes"].to_pylist()]
    counts = np.concatenate([unpack(c, "<u4") for c in group["counts"].to_pylist()])
    words, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(words)).astype(np.int64)
    bucket, rows, i = group["bucket"][0].as_py(), [], 0
    for batch, a in zip(group["batch"].to_pylist(), asked):
        here = at[i : i + len(a)]
        rows.append({"kind": "words", "batch": batch, "bucket": bucket, "a": pack(total[here]), "b": pack(here.astype("<u4"))})
        i += len(a)
    stats = np.array([*counts_of_counts(total), total.sum(), len(words)], "<i8")
    rows += [{"kind": "table", "bucket": bucket, "a": pack(words), "b": pack(total)}, {"kind": "stats", "bucket": bucket, "a": stats.tobytes()}]
    return table(ANSWER, rows)


def answers_of(batch: Batch, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Count and number within its bucket of every word of the batch."""
    cuts, counts, number = batch.cuts, np.zeros(batch.n, np.int64), np.zeros(batch.n, np.int64)
    for r in rows:
        if r["kind"] == "words":
            i, j = cuts[r["bucket"]], cuts[r["bucket"] + 1]
            counts[i:j], number[i:j] = unpack(r["a"], "<i8"), unpack(r["b"], "<u4")
    return counts, number


def score(docs: DataFrame, train_where=None) -> DataFrame:
    """docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from what isn't held out."""
    spark = docs.sparkSession
    buckets = max(8, docs.count() // ROWS_PER_BUCKET)
    learn = ~held_out(F.col("doc_id"), 7) if train_where is None else train_where
    coded = code(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", learn.alias("train")), buckets)
    batches = max(1, coded.where("kind = 'd'").count())
    words = keep(coded.where("kind = 'w'").repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(count_words, ANSWER), "words")
    stats = np.zeros(K + 4, np.int64)
    stride = 1
    for r in words.where("kind = 'stats'").select("a").toLocalIterator():
        s = np.frombuffer(r["a"], "<i8")
        stats += s
        stride = max(stride, int(s[-1]))
    total, types = int(stats[K + 2]), int(stats[K + 1])
    uni = Unigrams(stats, total)
    limit = max(1, total // (4 * buckets))

    def heavy_and_ids(batch: Batch, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        counts, number = answers_of(batch, rows)
        batch.pairs(counts > limit, batch.word_bucket * stride + number)
        return counts, batch.word_bucket * stride + number

    wide = "<u4" if stride * buckets < 1 << 32 else "<u8"

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left.to_pylist()[0], buckets)
        counts, ids = heavy_and_ids(batch, right.to_pylist())
        of = np.repeat((batch.train & 1).astype(bool), batch.sizes)
        seen = np.bincount(batch.inverse[of], minlength=len(batch.u))
        rows = []
        for b, (i, j) in enumerate(zip(batch.slices, batch.slices[1:])):
            if i < j:
                at = np.flatnonzero(np.concatenate([[True], batch.u[i + 1 : j] != batch.u[i : j - 1]]))
                rows.append({"kind": "p", "batch": batch.row["batch"], "bucket": b, "a": pack(np.stack([ids[batch.u[i:j][at]], np.diff(np.append(at, j - i)), counts[batch.u[i:j][at]] > limit]).astype("<i8")), "b": pack(ids[batch.w[i:j]].astype(wide)), "c": pack(np.stack([seen[i:j], counts[batch.w[i:j]]]).astype("<u4"))})
        often = np.flatnonzero(counts > limit)
        for b in np.unique(batch.word_bucket[often]).tolist():
            rows.append({"kind": "wants", "batch": batch.row["batch"], "bucket": b, "a": pack(ids[often][batch.word_bucket[often] == b].astype("<i8"))})
        return table(ANSWER, rows)

    def count_pairs(group: pa.Table) -> pa.Table:
        bucket, rows = group["bucket"][0].as_py(), [r for r in group.to_pylist() if r["kind"] == "wants"]
        group = group.filter(pa.compute.equal(group["kind"], "p"))
        if not len(group):
            return table(ANSWER, rows)
        asked = [unpack(a, "<i8").reshape(3, -1) for a in group["a"].to_pylist()]
        w = np.concatenate([unpack(b, wide) for b in group["b"].to_pylist()]).astype(np.int64)
        seen, of_w = np.concatenate([unpack(c, "<u4").reshape(2, -1) for c in group["c"].to_pylist()], 1).astype(np.int64)
        contexts, u_at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        per = np.concatenate([a[1] for a in asked])
        is_heavy = np.zeros(len(contexts), bool)
        is_heavy[u_at] = np.concatenate([a[2] for a in asked]) > 0
        followers, w_at = np.unique(w, return_inverse=True)
        key, at = np.unique(np.repeat(u_at, per) * len(followers) + w_at, return_inverse=True)
        count = np.bincount(at, weights=seen, minlength=len(key)).astype(np.int64)
        p = np.zeros(len(key))
        p[at] = uni.p(of_w)
        u_of, there = key // max(1, len(followers)), count > 0
        info = np.stack([*(np.bincount(u_of[count == c], minlength=len(contexts)) for c in range(1, K + 1)), np.bincount(u_of[there], weights=p[there], minlength=len(contexts))]).astype(float)
        i = k = 0
        for batch, a in zip(group["batch"].to_pylist(), asked):
            n = int(a[1].sum())
            few, mass = info[:K, u_at[k : k + a.shape[1]]].astype("<u4"), info[K, u_at[k : k + a.shape[1]]]
            rows.append({"kind": "pairs", "batch": batch, "bucket": bucket, "a": pack(count[at[i : i + n]].astype("<u4")), "b": pack(few), "c": pack(mass)})
            i, k = i + n, k + a.shape[1]
        kept = key[there]
        rows.append({"kind": "table", "bucket": bucket, "a": pack(np.stack([contexts, np.bincount(u_of[there], minlength=len(contexts))]).astype("<i8")), "b": pack(followers[kept % max(1, len(followers))].astype(wide)), "c": pack(count[there].astype("<u4"))})
        home = contexts // stride
        for b in np.unique(home[is_heavy]).tolist():
            here = is_heavy & (home == b)
            rows.append({"kind": "heavy", "bucket": b, "a": pack(contexts[here].astype("<i8")), "b": pack(info[:, here])})
        rows.append({"kind": "stats", "bucket": bucket, "a": counts_of_counts(count).astype("<i8").tobytes()})
        return table(ANSWER, rows)

    texts, told = coded.where("kind = 'd'").select("batch", "ids", "train", "sizes", "tokens", "hashes", "counts", "end"), words.where("kind = 'words'")
    by_batch = lambda df: df.repartition(min(batches, PARTITIONS), "batch").groupBy("batch")
    asked = by_batch(texts).cogroup(by_batch(told)).applyInArrow(ask, ANSWER)
    pairs = keep(asked.repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(count_pairs, ANSWER), "pairs")
    n_pairs = np.zeros(K + 2, np.int64)
    for r in pairs.where("kind = 'stats'").select("a").toLocalIterator():
        n_pairs += np.frombuffer(r["a"], "<i8")
    d = discounts(n_pairs)
    d[0] = 1

    def summed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """What is known of the frequent contexts of a bucket, to each batch that has some of them."""
        known: dict[int, np.ndarray] = {}
        for r in left.to_pylist():
            for i, x in zip(unpack(r["a"], "<i8").tolist(), unpack(r["b"], "<f8").reshape(K + 1, -1).T):
                known[i] = known.get(i, 0) + x
        out = []
        for r in right.to_pylist():
            out.append({"kind": "names", "batch": r["batch"], "bucket": r["bucket"], "a": r["a"], "b": pack(np.stack([known[i] for i in unpack(r["a"], "<i8").tolist()]).astype("<f8"))})
        return table(ANSWER, out)

    by_home = lambda kind: pairs.where(F.col("kind") == kind).repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket")
    names = by_home("heavy").cogroup(by_home("wants")).applyInArrow(summed, ANSWER)
    result = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def evaluate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        batch, rows = Batch(left.to_pylist()[0], buckets), right.to_pylist()
        counts, ids = heavy_and_ids(batch, rows)
        c_pair, info = np.zeros(len(batch.u), np.int64), np.zeros((K + 1, len(counts)))
        for r in rows:
            if r["kind"] == "pairs":
                i, j = batch.slices[r["bucket"]], batch.slices[r["bucket"] + 1]
                c_pair[i:j] = unpack(r["a"], "<u4")
                here = batch.u[i:j][np.concatenate([[True], batch.u[i + 1 : j] != batch.u[i : j - 1]])]
                info[:K, here], info[K, here] = unpack(r["b"], "<u4").reshape(K, -1), unpack(r["c"], "<f8")
        often = np.flatnonzero(counts > limit)
        place = often[np.argsort(ids[often])]
        for r in rows:
            if r["kind"] == "names":
                asked = unpack(r["a"], "<i8")
                info[:, place[np.searchsorted(ids[place], asked)]] = unpack(r["b"], "<f8").reshape(-1, K + 1).T
        c_u = np.maximum(counts, 1)
        freed = sum(info[c - 1] * c * (1 - d[c]) for c in range(1, K + 1))
        bare = (counts > 0) & (freed <= 0)
        whole = c_u + bare
        alpha = np.where(counts > 0, (freed + bare) / whole / np.maximum(1 - info[K], 1e-300), 1.0)
        p_word = uni.p(counts)
        u, w = batch.u, batch.w
        p = np.where(c_pair > 0, discounted(c_pair, d) / whole[u], alpha[u] * p_word[w])
        log_p, log_base = np.log10(p), np.log10((counts + 1) / (total + types + 1))
        add = lambda x: np.add.reduceat(x, batch.starts)
        flags = unpack(batch.row["train"], "u1")
        doc = pa.array(unpack(batch.row["ids"], "<i8"), pa.int64(), mask=flags >= 2)
        cols = [doc, (flags & 1) == 0, batch.sizes, add((counts[batch.tokens] > 0).astype(np.int64)), np.full(len(flags), total), add(log_base[batch.tokens]), add(log_p[batch.inverse])]
        return pa.table([pa.array(c) if not isinstance(c, pa.Array) else c for c in cols], names=[x.split()[0] for x in result.split(", ")])

    told = told.unionByName(pairs.where("kind = 'pairs'")).unionByName(names)
    return by_batch(texts).cogroup(by_batch(told)).applyInArrow(evaluate, result)
