"""Byte-level BPE: backtracking over longest matches, with memoised compatibility of adjacent tokens.

Bytes are mapped to Latin-1, so that an automaton over strings finds the longest token at a position. A sequence of
tokens is what merging by rank would give exactly if every two adjacent tokens are what merging gives for their own
bytes. So the encoder takes the longest token, goes to its next shorter prefix or one token back when the pair does
not fit, and marks ends that led nowhere; no end is tried twice, which makes it linear in the text.

Null texts count as empty; an empty text has no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of the memo of pieces and of pairs in a worker; a full memo is emptied.
MEMO = 300_000


class Encoder:
    """Ranks: token bytes to id. Single bytes must all be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            if len(b) == 1 or self.merge(b) == [i]:
                self.automaton.add_word(b.decode("latin-1"), b)
        self.automaton.make_automaton()
        self.shorter: dict[bytes, bytes | None] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merging by rank as defined, for short strings: always the lowest rank, the first from the left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: bytes, side: int) -> tuple[tuple[bytes, int], ...]:
        """What stands at the token's left (0) or right (1) edge while merging builds it: (bytes, rank of the next)."""
        found = self.edges[side].get(token)
        if found is None:
            parts, at_edge = [token[i : i + 1] for i in range(len(token))], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if at == (0, len(parts) - 2)[side]:
                    at_edge.append((parts[0 if side == 0 else -1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.edges[side][token] = (*at_edge, (token, 1 << 60))
        return found

    def compatible(self, a: bytes, b: bytes) -> bool:
        """No merge across the border comes before those that build a's right and b's left edge; at equal rank the left is first."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            left, right, i, j, known = self.edge(a, 1), self.edge(b, 0), 0, 0, None
            while known is None:
                (x, to_x), (y, to_y) = left[i], right[j]
                across = self.ranks.get(x + y, 1 << 61)
                if across < to_x and across <= to_y:
                    known = False
                elif to_x == to_y == 1 << 60:
                    known = True
                elif to_x <= to_y:
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = known
        return known

    def prefix(self, token: bytes) -> bytes | None:
        """The longest token that is a proper prefix."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if self.automaton.get(token[:n].decode("latin-1"), None)), None)
        return self.shorter[token]

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        if data in self.ranks:
            return (self.ranks[data],)
        latin, n, at = data.decode("latin-1"), len(data), 0
        longest, fits = [t for _, t in self.automaton.iter_long(latin)], self.fits.get
        if all(fits(pair) or self.compatible(*pair) for pair in zip(longest, longest[1:])):  # most need no step back
            return tuple([self.ranks[t] for t in longest])
        dead, out = bytearray(n + 1), []
        token = next(self.automaton.iter_long(latin))[1]
        while at < n:
            last = out[-1] if out else None
            while token and (dead[at + len(token)] or last and not self.compatible(last, token)):
                token = self.prefix(token)
            if token:
                out.append(token)
                at += len(token)
                token = next(self.automaton.iter_long(latin, at))[1] if at < n else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(token)
        return tuple(self.ranks[t] for t in out)

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for x in self.pattern.findall(text):
            ids = memo.get(x)
            if ids is None:
                ids = self.piece(x)
                if len(x) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[x] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each vocabulary file and worker."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = Encoder(ranks, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: the id column, ids (left out if not ``with_ids``), n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the decimal ids with one space between; decoded_sha256 over the bytes that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, n, sha, back = [], [], [], []
                for text in part.column(1):
                    x = enc.encode(text.as_py() or "")
                    n.append(len(x))
                    sha.append(hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest())
                    back.append(hashlib.sha256(enc.decode(x)).hexdigest())
                    if with_ids:
                        ids.append(x)
                cols = [part.column(0), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.select(id_column).dtypes)[id_column]
    names = ["k", *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = f"k {kind}, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_column, text_column).mapInArrow(run, schema).withColumnRenamed("k", id_column)
