"""Chunks of ranges and parts against whole contents; tree nodes, descent and upkeep against plain snapshots."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.chunker import cuts
from tidemark.functions.ranges import Cutter, candidates, file_chunks, part_chunks
from tidemark.operators import diff as d
from tidemark.operators import trees

from test_core import POLY  # isort: skip

BOUNDS = {"least": 256, "most": 2048, "bits": 9}
ENTRY = "path array<string>, path_str string, kind string, exec boolean, mtime_sec bigint, mtime_nsec int, chunks array<struct<id:string,len:bigint>>, target string"


def contents():
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    return {"noise": noise, "zeros": bytes(9_000), "both": noise[:5_000] + bytes(7_001) + noise[5_000:9_000], "period": bytes(range(251)) * 60, "one": b"x", "least": noise[:256], "edge": noise[:4096], "none": b""}


def plain(data):
    return [(i, o, n, hashlib.sha256(data[o : o + n]).hexdigest()) for i, (o, n) in enumerate(cuts(data, POLY, **BOUNDS))]


@pytest.mark.parametrize("size", [64, 1_000, 1 << 20])
def test_chunks_of_ranges(spark, tmp_path, size):
    """Ranges shorter than a chunk, of about its length, and of whole files."""
    files = contents()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(f"{'file://' if i % 2 else ''}{tmp_path}/{n}", len(x)) for i, (n, x) in enumerate(files.items())], "path string, size bigint")
    got = {}
    for r in file_chunks(listed, POLY, size=size, **BOUNDS).orderBy("path", "ord").collect():
        got.setdefault(os.path.basename(r.path), []).append((r.ord, r.off, r.len, r.id))
    assert got == {n: plain(x) for n, x in files.items() if x}


def test_chunks_of_parts(spark):
    """Parts of any lengths from 63 bytes on; one file's last part is shorter."""
    rng, rows, files = np.random.default_rng(6), [], contents()
    for name, data in files.items():
        at = 0
        while at < len(data) or not data:
            n = int(rng.integers(63, 5_000))
            n = n if len(data) - at - n >= 63 or at + n >= len(data) else len(data) - at
            rows.append((name, at, data[at : at + n]))
            at += n
            if not data:
                break
    got = {}
    for r in part_chunks(spark.createDataFrame(rows, "path string, off bigint, data binary"), POLY, **BOUNDS).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.ord, r.off, r.len, r.id))
    assert got == {n: plain(x) for n, x in files.items() if x}


def test_missing_part_is_an_error(spark):
    rows = [("a", 0, bytes(500)), ("a", 700, bytes(500))]
    with pytest.raises(Exception, match="missing|no range"):
        part_chunks(spark.createDataFrame(rows, "path string, off bigint, data binary"), POLY, **BOUNDS).collect()
    with pytest.raises(ValueError, match="no range"):
        Cutter("a", 256, 2048).take(5, 10, np.empty(0, np.int64))
    with pytest.raises(ValueError, match="window"):
        part_chunks(spark.createDataFrame(rows, "path string, off bigint, data binary"), POLY, 32, 64, 4)


def test_candidates_need_the_bytes_before():
    data = contents()["noise"]
    whole = candidates(b"", data, 0, POLY, 7)
    assert (np.concatenate([candidates(data[max(0, i - 63) : i], data[i : i + 777], i, POLY, 7) for i in range(0, len(data), 777)]) == whole).all() and len(whole) > 100


# trees


def random_tree(rng, n=40):
    """path -> entry, directories of all files included, some empty."""
    out = {}
    for _ in range(n):
        path = tuple(f"d{rng.integers(0, 3)}" for _ in range(rng.integers(0, 4))) + (f"f{rng.integers(0, 9)}",)
        add(out, path, rng)
    return out


def add(tree, path, rng):
    for k in range(1, len(path)):
        if tree.get(path[:k], ("dir",))[0] != "dir":
            return
        tree.setdefault(path[:k], ("dir", False, 0, 0, (), None))
    kind = ["file", "file", "file", "link", "dir"][rng.integers(0, 5)]
    if tree.get(path, (kind,))[0] != kind:
        for p in [p for p in tree if p[: len(path)] == path]:
            del tree[p]
    tree[path] = (kind, bool(rng.integers(0, 2)) and kind == "file", int(rng.integers(0, 3)) if kind != "dir" else 0, 0, tuple((f"c{rng.integers(0, 4)}", 5) for _ in range(rng.integers(0, 3))) if kind == "file" else (), f"t{rng.integers(0, 2)}" if kind == "link" else None)


def edited(tree, rng):
    out, dirty = dict(tree), set()
    for _ in range(rng.integers(1, 6)):
        paths = sorted(out)
        path = paths[rng.integers(0, len(paths))]
        if rng.integers(0, 3) == 0:
            for p in [p for p in out if p[: len(path)] == path]:
                del out[p]
        else:
            add(out, path if rng.integers(0, 2) else (*path[:-1], f"n{rng.integers(0, 50)}"), rng)
        dirty.add(path[:-1])
        if not out:
            add(out, ("z",), rng)
            dirty.add(())
    return out, dirty


def frame(spark, tree):
    return spark.createDataFrame([(list(p), "/".join(p), *v) for p, v in tree.items()], ENTRY)


def rows_of(df):
    return {r.path_str: (r.kind, r.exec, r.mtime_sec, r.mtime_nsec, tuple((c.id, c.len) for c in r.chunks), r.target) for r in df.collect()}


def test_trees_over_random_edits(spark):
    """Fold then unfold is the identity; descent is the diff; upkeep is hashing anew, and hashes the closure alone."""
    for seed in range(2):
        rng = np.random.default_rng(seed * 7919 + 13)
        old = random_tree(rng)
        new, dirty = edited(old, rng)
        a, b = frame(spark, old), frame(spark, new)
        (ra, na), (rb, nb) = trees.fold(a), trees.fold(b)
        assert rows_of(trees.unfold(na, ra)) == {"/".join(p): v for p, v in old.items()}
        nodes = na.union(nb).dropDuplicates(["tree_id", "name"])
        changes, read = trees.descend(nodes, ra, rb)
        want = {(r.path_str, r.bucket) for r in d.diff(a, b).collect()}
        assert {(r.path_str, r.bucket) for r in changes.collect()} == want
        assert (ra == rb) == (old == new)
        cache = trees.tree_ids(a)
        ids, anew = trees.rebuilt(b, cache, spark.createDataFrame([(list(p),) for p in dirty], "path array<string>"))
        full = {r.path_str: r.tree_id for r in trees.tree_ids(b).collect()}
        assert {r.path_str: r.tree_id for r in ids.collect()} == full and full[""] == rb
        live = {"/".join(p) for p, v in new.items() if v[0] == "dir"} | {""}
        was = {"/".join(p) for p, v in old.items() if v[0] == "dir"}
        closure = {"/".join(p[:k]) for p in dirty for k in range(len(p) + 1)} | {"/".join(p[:k]) for p, v in new.items() if v[0] == "dir" and "/".join(p) not in was for k in range(len(p) + 1)}
        assert {r.path_str for r in anew.collect()} == closure & live


def test_equal_subtrees_are_one_node(spark):
    tree = {}
    for top in range(30):
        for p in ((), ("s",), ("s", "f"), ("s", "g"), ("e",)):
            tree[(f"t{top}", *p)] = ("file", False, 1, 2, (("c", 3),), None) if p and p[-1] in "fg" else ("dir", False, 0, 0, (), None)
    root, nodes = trees.fold(frame(spark, tree))
    assert nodes.select("tree_id").distinct().count() == 3 and nodes.count() == 30 + 2 + 2
    assert rows_of(trees.unfold(nodes, root)) == {"/".join(p): v for p, v in tree.items()}


def test_descent_reads_what_changed(spark):
    tree = {(f"t{i}",): ("dir", False, 0, 0, (), None) for i in range(40)} | {(f"t{i}", f"f{k}"): ("file", False, i, k, (), None) for i in range(40) for k in range(5)}
    new = {**tree, ("t7", "f1"): ("file", True, 7, 1, (), None)}
    (ra, na), (rb, nb) = trees.fold(frame(spark, tree)), trees.fold(frame(spark, new))
    changes, read = trees.descend(na.union(nb).distinct(), ra, rb)
    assert [(r.path_str, r.bucket) for r in changes.collect()] == [("t7/f1", "metadata_modified")]
    assert sorted((r.depth, r.side, r.n) for r in read.collect()) == [(0, "newer", 1), (0, "older", 1), (1, "newer", 1), (1, "older", 1)]


def test_empty_trees(spark):
    none = spark.createDataFrame([], ENTRY)
    root, nodes = trees.fold(none)
    assert root == trees.EMPTY and trees.unfold(nodes, root).count() == 0
    changes, read = trees.descend(nodes, root, root)
    assert changes.count() == read.count() == 0
    one = frame(spark, {("a",): ("dir", False, 0, 0, (), None), ("a", "b"): ("link", False, 1, 1, (), "t")})
    top, more = trees.fold(one)
    assert sorted((r.path_str, r.bucket) for r in trees.descend(nodes.unionByName(more), root, top)[0].collect()) == [("a", "added"), ("a/b", "added")]
    assert [(r.path_str, r.tree_id) for r in trees.tree_ids(none).collect()] == [("", trees.EMPTY)]
    assert {r.path_str for r in trees.rebuilt(none, trees.tree_ids(one), one.select("path"))[0].collect()} == {""}
    assert trees.tree_ids(one).where(F.col("path_str") == "").first().tree_id == top
