"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may differ from a passage by up to k = floor(rate * n) word edits. Cut into k + 1 pieces, at
least one piece of it stands unchanged in such a passage; an automaton over all pieces finds exact piece hits in one
pass over a text, and Myers' bit-parallel distance verifies the item around each hit: an item's hits whose surroundings
overlap are verified together, in one pass over the words that they cover. The passage reported is the best of all,
by distance, then by its end, then the shortest. Words are runs of letters,
digits and underscores in lower case, so case, punctuation and spacing don't count as edits.

Documents are only mapped, never shuffled: hot passages cost no more than others. The items are taken in blocks of
bounded size, one pass over the documents each. Null texts and items count as empty; items without words match
nothing; items with equal words are all reported, those without an id with a null one. Repeated rows give repeated
results.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's words that may be edited.
RATE = 0.15
#: Characters of items in a block.
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def masks_of(pattern: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(pattern):
        out[w] = out.get(w, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any part of ``text``, and the end of the first such part."""
    full, top = (1 << m) - 1, m - 1
    plus, minus, score, best, at = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, less = minus | ~(across | plus), plus & across
        score += (up >> top & 1) - (less >> top & 1)
        up, less = up << 1, less << 1
        plus, minus = (less | ~(down | up)) & full, up & down & full
        if score < best:
            best, at = score, j
    return best, at


class Items:
    def __init__(self, rows: list[tuple[int, str]], rate: float):
        import ahocorasick

        by: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in rows:
            if words := tuple(words_of(text)):
                by.setdefault(words, []).append(item_id)
        self.items = [(list(w), ids, int(rate * len(w)), masks_of(list(w)), masks_of(list(w)[::-1])) for w, ids in by.items()]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (w, _, k, _, _) in enumerate(self.items):
            cuts = [len(w) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(f" {' '.join(w[a:b])} ", []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.automaton.add_word(p, (len(p), at))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, end word) of each item's best passage."""
        words = words_of(text)
        if not words or not self.any:
            return []
        starts, around = None, {}
        for end, (size, places) in self.automaton.iter(f" {' '.join(words)} "):
            if starts is None:
                starts = list(accumulate((len(w) + 1 for w in words), initial=0))
            h = bisect.bisect_left(starts, end - size + 1)
            for i, offset in places:
                around.setdefault(i, set()).add(h - offset)
        out = []
        for i, places in around.items():
            w, ids, k, masks, back = self.items[i]
            best, upto = None, -1
            parts: list[list[int]] = []
            for at in sorted(places):
                a, b = max(0, at - k), at + len(w) + k
                if a <= upto:
                    parts[-1][1] = b
                else:
                    parts.append([a, b])
                upto = b
            for a, b in parts:
                d, to = myers(masks, len(w), words[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + to)
            if best:
                d, to = best
                _, size = myers(back, len(w), words[max(0, to - len(w) - k) : to][::-1])
                out += [(item, d, to - size, to) for item in ids]
        return out


_built: dict[str, Items] = {}


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS, gathered one block at a time."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """docs(doc_id, text) against items(item_id, text): doc_id, item_id, distance, first_word, end_word of each item found in each document."""
    import uuid

    spark, schema = docs.sparkSession, "doc_id bigint, item_id bigint, distance int, first_word int, end_word int"
    out = spark.createDataFrame([], schema)
    for rows in blocks(items):
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                _built.clear()
                _built[name] = Items(shared.value, rate)
            for batch in batches:
                got = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in _built[name].find(t.as_py())]
                cols = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "distance", "first_word", "end_word"])

        out = out.union(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows in which an item is found, all columns as they were."""
    import uuid

    text = docs.columns.index("text")
    for rows in blocks(items):
        shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                _built.clear()
                _built[name] = Items(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not _built[name].find(t.as_py()) for t in batch.column(text)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
