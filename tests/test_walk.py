"""Full scans, the chunker in SQL and secrets of shared files."""

import os

from pyspark.sql import functions as F

from tidemark.functions.chunker import cuts, register_chunker
from tidemark.operators import diff as d
from tidemark.operators.ignore import Policy
from tidemark.session import keep
from tidemark.sources import files, walk

from test_core import POLY  # isort: skip


def test_full_snapshot(spark, tmp_path):
    for p in ("sub/deep/empty", ".store/packs", "sub/.store"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(os.urandom(3000))
    (tmp_path / "sub" / "none").write_bytes(b"")
    (tmp_path / "sub" / "run").write_bytes(b"#!")
    (tmp_path / "sub" / "run").chmod(0o755)
    (tmp_path / "sub" / "é").write_bytes(b"accent")
    os.symlink("../a.txt", tmp_path / "sub" / "to")
    os.symlink("nowhere", tmp_path / "loose")
    open(os.fsencode(tmp_path) + b"/bad\xff", "wb").close()
    os.utime(tmp_path / "a.txt", ns=(0, 1_700_000_000_123_456_789))
    entries, refused = walk.full_snapshot(spark, str(tmp_path), POLY, None, 256, 1024, 8)
    first = keep(entries, "first")
    got = {r.path_str: r for r in first.collect()}
    assert {p: (r.kind, r.exec, r.target, sum(c.len for c in r.chunks)) for p, r in got.items()} == {
        "a.txt": ("file", False, None, 3000), "loose": ("link", False, "nowhere", 0), "sub": ("dir", False, None, 0), "sub/.store": ("dir", False, None, 0), "sub/deep": ("dir", False, None, 0),
        "sub/deep/empty": ("dir", False, None, 0), "sub/none": ("file", False, None, 0), "sub/run": ("file", True, None, 2), "sub/é": ("file", False, None, 6), "sub/to": ("link", False, "../a.txt", 0),
    }
    assert (got["a.txt"].mtime_sec, got["a.txt"].mtime_nsec) == (1_700_000_000, 123_456_789) and refused.count() == 1
    (tmp_path / "sub" / "run").write_bytes(b"#!/bin")
    again, _ = walk.full_snapshot(spark, str(tmp_path), POLY, first, 256, 1024, 8)
    assert {(r.path_str, r.bucket) for r in d.diff(first, again).collect()} == {("sub/run", "content_modified")}
    assert again.where("path_str = 'a.txt'").select("chunks").first() == first.where("path_str = 'a.txt'").select("chunks").first()


def test_empty_tree(spark, tmp_path):
    entries, refused = walk.full_snapshot(spark, str(tmp_path), POLY)
    assert entries.count() == 0 and refused.count() == 0


def test_chunker_in_sql(spark):
    body = os.urandom(5000)
    register_chunker(spark, POLY, "cut_up", 256, 1024, 8)
    spark.createDataFrame([("a", body), ("b", b""), ("c", None)], "k string, content binary").createOrReplaceTempView("bodies")
    got = spark.sql("select k, c.* from bodies, lateral cut_up(content) c order by ord").collect()
    assert [(r.k, r.off, r.len) for r in got] == [("a", o, n) for o, n in cuts(body, POLY, 256, 1024, 8)]


def test_secrets_of_shared_files(spark):
    texts = spark.createDataFrame([("logs/x.log", "password = hunter2hunter2"), ("a.txt", "fine\npassword = hunter2hunter2"), (".env", "")], "path string, text string")
    got = files.shared_secrets(texts, Policy(["*.log"]).ignored(F.col("path"), F.lit(False)))
    assert {(r.path, r.line, r["class"]) for r in got.collect()} == {("a.txt", 2, "assigned-secret"), (".env", None, "env-file")}
