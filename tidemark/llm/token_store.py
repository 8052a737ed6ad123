"""Token ids as raw little-endian payloads, with a minimal perfect hash index over document keys.

A store is a folder of ``shard-*.bin`` (nothing but ids, documents in ascending key order, shards in ascending key
ranges; two bytes an id where the vocabulary fits, else four) and ``index-*.mph``. Keys are dealt over the index files by hash; each file holds a minimal perfect hash by
displacement: a first hash picks a bucket, the bucket's stored displacement makes the second hash send every key to a
slot of its own, and the slot stores a 32-bit fingerprint with shard, offset and length. A look-up reads one
displacement and one slot whatever the number of keys; an unknown key is told by its fingerprint (one in 2^32 is not).

Null texts count as empty, and null keys are keys like others that come first. Rows that repeat a key are all kept, as
occurrences 0, 1, ... of it in the order of their text. An empty table gives an empty store. Every attempt of a task
writes files of its own names, shards and index files alike; the tables that the finished stages returned say which of
them are the store, so a task that is run again or late leaves no half-written file in use and replaces none.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

#: Keys for each index file, on average, and for each of more files than INDEX_FILES; one file is built in one task's memory.
KEYS_PER_INDEX, KEYS_AT_MOST, INDEX_FILES = 50_000, 1_000_000, 10_000
#: Keys for each displacement, on average.
PER_BUCKET = 4
#: Rows for each payload shard, on average, as long as this makes no more than SHARDS; a shard is streamed, and so of any size.
ROWS_PER_SHARD, SHARDS = 4_000, 20_000
#: Words whose ids a worker remembers; a full memo is emptied.
MEMO = 700_000
#: Marks that may follow a word's letters.
MARKS = ".,;:!?$%&*#"
BEYOND = re.compile("[^\x00-\u024f]")
MAGIC = b"TMPH0001"
#: Marks a displacement that is the slot of its bucket's only key.
DIRECT = np.uint32(1 << 31)
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])

_tokenizers: dict[tuple[str, int], Words] = {}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


#: How byte-level vocabularies write a byte: printable Latin-1 as itself, the others in order from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LEVEL = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(PRINTED))}


#: The normaliser and the splitter for which words may be encoded apart.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


class Words(dict):
    """Words to their ids, by the library's tokenizer where they aren't known yet. Where white space ends tokens and is dropped, words can be encoded apart.

    That is so for tokenizers of one kind (``apart``), by their normaliser and splitter; others get texts whole.

    A word of letters below U+0250, which composing leaves as they are, followed by marks is one token group of letters
    and one of marks: its letters go to the library's model in lower case, once for all marks and cases. Every other
    word goes through the library whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        self.cores: dict[str, bytes] = {}
        made = json.loads(self.tok.to_str())
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.apart = made["normalizer"] == NORMAL and splits[0].get("pattern") == SPLIT and splits[0].get("behavior") == "Removed" and [x["type"] for x in splits[1:]] == ["ByteLevel"] and made["post_processor"] is None

    def pack(self, ids) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def encode(self, words: list[str]) -> list[bytes]:
        """One encoding of all words with spaces between."""
        enc = self.tok.encode(" ".join(words), add_special_tokens=False)
        ids, places = np.array(enc.ids, f"<u{self.width}"), np.array([o[0] for o in enc.offsets], np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        return [x.tobytes() for x in np.split(ids, np.searchsorted(places, ends[:-1]))]

    def by_parts(self, word: str) -> bytes | None:
        low = word.lower()
        core = low.rstrip(MARKS)
        if not core.isalpha() or max(core) >= "\u0250":
            return None
        out = self.cores.get(core)
        if out is None:
            if len(self.cores) > MEMO:
                self.cores.clear()
            out = self.cores[core] = self.pack([t.id for t in self.tok.model.tokenize(core.encode().decode("latin-1").translate(LEVEL))])
        if len(core) == len(low):
            return out
        marks = low[len(core) :]
        if marks not in self.cores:
            self.cores[marks] = self.encode([marks])[0]
        return out + self.cores[marks]

    def __missing__(self, word: str) -> bytes:
        ids = self.by_parts(word) if word else b""
        if ids is None:
            ids = self.encode([word])[0]
        self[word] = ids
        return ids


def _encoder(path: str, end_id: int) -> Words:
    if (path, end_id) not in _tokenizers:
        _tokenizers[path, end_id] = Words(path, end_id)
    return _tokenizers[path, end_id]


def encode_texts(texts: list[str], path: str, end_id: int) -> tuple[list[bytes], int]:
    """The payload of each text, and the bytes of an id in it: two where they hold every id of the vocabulary."""
    enc = _encoder(path, end_id)
    if len(enc) > MEMO:
        enc.clear()
    out = []
    if not enc.apart:
        return [enc.pack(x.ids) + enc.end for x in enc.tok.encode_batch(texts, add_special_tokens=False)], enc.width
    for t in texts:
        # lower case is what the tokenizer sees; without marks that compose, and special tokens, it may come first
        if "<|" not in t and (t.isascii() or not BEYOND.search(t)):
            t = t.lower()
        out.append(b"".join([*map(enc.__getitem__, t.replace("\n", " ").split(" ")), enc.end]))
    return out, enc.width


def mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit mixing hash of 64-bit keys; seeds give independent hashes."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed).astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct keys: slot = mix(key, displacement of its bucket) mod n.

    Buckets go from large to small; a bucket's only key takes a slot that is left.
    """
    n = len(keys)
    buckets = max(1, n // PER_BUCKET)
    of = (mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1))
    taken, out = np.zeros(n, bool), np.zeros(buckets, "<u4")
    for b in np.argsort(-np.diff(starts), kind="stable"):
        group = keys[order[starts[b] : starts[b + 1]]]
        if len(group) < 2:
            break
        seed = 1
        while True:  # many displacements at once
            slots = (mix(group[None, :], np.arange(seed, seed + 64)[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[slots].any(1)
            s = np.sort(slots, 1)
            good &= (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                at = int(np.argmax(good))
                out[b], taken[slots[at]] = seed + at, True
                break
            seed += 64
    alone = np.flatnonzero(np.diff(starts) == 1)
    out[alone] = np.flatnonzero(~taken).astype("<u4") | DIRECT
    return out


def slots_of(keys: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    bucket = (mix(keys, 0) % np.uint64(len(displacements))).astype(np.int64)
    d = displacements[bucket]
    return np.where(d & DIRECT, d & ~DIRECT, mix(keys, d) % np.uint64(n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 40) >> np.uint64(32)).astype("<u4")


def write_index(path: str, width: int, keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> None:
    disp, table = build_mph(keys), np.zeros(len(keys), SLOT)
    at = slots_of(keys, disp, len(keys))
    table["fingerprint"][at], table["shard"][at], table["offset"][at], table["length"][at] = fingerprints(keys), shard, offset, length
    system, p = _open(path)
    with system.open_output_stream(p) as f:
        f.write(MAGIC + struct.pack("<QQQ", len(keys), len(disp), width) + disp.tobytes() + table.tobytes())


def read_index(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Displacements, slots, and the bytes of an id."""
    system, p = _open(path)
    with system.open_input_file(p) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{path} is no index")
    n, buckets, width = struct.unpack("<QQQ", data[8:32])
    return np.frombuffer(data, "<u4", buckets, 32), np.frombuffer(data, SLOT, n, 32 + 4 * buckets), width


def look_up(keys: np.ndarray, disp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 where the fingerprint says that the key is unknown."""
    if not len(table):
        return np.full(len(keys), -1)
    at = slots_of(keys, disp, len(table))
    return np.where(table["fingerprint"][at] == fingerprints(keys), at, -1)


def key_of(group: pa.Table) -> np.ndarray:
    """A 64-bit key: the id itself for occurrence 0, else a hash of both; null ids hash apart."""
    missing = group["doc_id"].is_null().to_numpy()
    k, occurrence = group["doc_id"].fill_null(0).to_numpy().astype(np.int64).view(np.uint64), group["occurrence"].to_numpy().astype(np.uint64)
    return np.where(missing | (occurrence > 0), mix(k, occurrence + np.uint64(1 << 20) + (missing.astype(np.uint64) << np.uint64(50))), k)


@dataclass
class Store:
    """What a finished write left: placed(doc_id, occurrence, shard, file, width, offset, n_tokens), index(part, file, n), and the folder."""

    folder: str
    placed: DataFrame
    index: DataFrame
    parts: int

    def shards(self) -> DataFrame:
        """(shard, file, ids, before): ids of each shard and of all before it."""
        each = self.placed.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids"))
        before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
        return each.withColumn("before", F.coalesce(before, F.lit(0)))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> Store:
    """Write docs' ids and index under ``folder``; offsets of what is placed are in ids within the shard."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    shards = min(SHARDS, max(1, rows.select("doc_id").count() // ROWS_PER_SHARD))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name, offset, last, seen, stream = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.bin", 0, run, 0, None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids, out = part.column(0).to_pylist(), []
                payload, width = encode_texts(part.column(1).to_pylist(), tokenizer, end_id)
                if stream is None:
                    system, base = _open(folder)
                    system.create_dir(base)
                    stream = system.open_output_stream(f"{base}/{name}")
                for i, p in zip(ids, payload):
                    seen = seen + 1 if i == last else 0
                    out.append((i, seen, shard, name, width, offset, len(p) // width))
                    offset, last = offset + len(p) // width, i
                stream.write(b"".join(payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "occurrence", "shard", "file", "width", "offset", "n_tokens"])
        if stream is not None:
            stream.close()

    placed = keep(dealt.mapInArrow(run, "doc_id bigint, occurrence bigint, shard int, file string, width int, offset bigint, n_tokens bigint"), "placed")
    n = placed.count()
    files = max(1, min(n // KEYS_PER_INDEX, max(INDEX_FILES, n // KEYS_AT_MOST)))

    def index(group: pa.Table) -> pa.Table:
        part, keys = group["part"][0].as_py(), key_of(group)
        name = f"index-{part:06d}-{uuid.uuid4().hex[:8]}.mph"
        system, base = _open(folder)
        system.create_dir(base)
        write_index(f"{folder}/{name}", group["width"][0].as_py(), keys, group["shard"].to_numpy(), group["offset"].to_numpy(), group["n_tokens"].to_numpy())
        return pa.table({"part": pa.array([part], pa.int32()), "file": pa.array([name]), "n": pa.array([len(keys)], pa.int64())})

    indexed = keep(placed.withColumn("part", index_part(files)).groupBy("part").applyInArrow(index, "part int, file string, n bigint"), "indexed")
    return Store(folder, placed, indexed, files)


def index_part(files: int):
    return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(files)).cast("int")


def read(keys: DataFrame, store: Store) -> DataFrame:
    """Look keys(doc_id, occurrence) up in the store and read their ids back from the payload.

    Returns doc_id, occurrence, start (ids of all documents before it), n_tokens, ids_crc32; unknown keys give no row.
    """
    folder = store.folder
    places = {"doc_id": pa.int64(), "occurrence": pa.int64(), "shard": pa.int32(), "offset": pa.int64(), "n_tokens": pa.int64(), "width": pa.int32()}

    def find(group: pa.Table, indexed: pa.Table) -> pa.Table:
        if not len(group) or not len(indexed):
            return pa.table({n: pa.array([], k) for n, k in places.items()})
        disp, table, width = read_index(f"{folder}/{indexed['file'][0].as_py()}")
        at = look_up(key_of(group), disp, table)
        group, at = group.filter(pa.array(at >= 0)), at[at >= 0]
        cols = [table["shard"][at], table["offset"][at], table["length"][at], np.full(len(at), width)]
        return pa.table([group["doc_id"], group["occurrence"], *(pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(cols, list(places.values())[2:]))], names=list(places))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = f = None
        for batch in batches:
            offset, n, width = (batch[c].to_numpy() for c in ("offset", "n_tokens", "width"))
            crc = np.empty(len(n), np.int64)
            for i, file in enumerate(batch["file"].to_pylist()):
                if file != held:
                    if f:
                        f.close()
                    system, base = _open(folder)
                    held, f = file, system.open_input_file(f"{base}/{file}")
                w = int(width[i])
                crc[i] = zlib.crc32(np.frombuffer(f.read_at(w * int(n[i]), w * int(offset[i])), f"<u{w}").astype("<u4").tobytes())
            start = offset + batch["before"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["occurrence"], pa.array(start, pa.int64()), batch["n_tokens"], pa.array(crc)], names=["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, occurrence bigint, shard int, offset bigint, n_tokens bigint, width int"
    wanted = keys.select("doc_id", "occurrence").withColumn("part", index_part(store.parts))
    found = wanted.groupBy("part").cogroup(store.index.groupBy("part")).applyInArrow(find, schema)
    shards = keep(store.shards().select("shard", "file", "before"), "shards")
    by_shard = found.join(shards, "shard").repartitionByRange(max(1, shards.count()), "shard", "offset").sortWithinPartitions("shard", "offset")
    return by_shard.mapInArrow(fetch, "doc_id bigint, occurrence bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
