"""Pulls, packs, releases and the streams' smaller parts, on small fixtures."""

import hashlib
import json

from pyspark.sql import functions as F
from test_core import file, folder, tree

from tidemark.operators import transfer
from tidemark.operators.converge import release
from tidemark.sources.files import get
from tidemark.streaming import watch


def test_pull_rounds(spark):
    roots, nodes = spark.createDataFrame([("a",), ("a",)], "id string"), spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "id string, child string")
    got, left = transfer.pull_rounds(roots, nodes)
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 2), ("d", 3)} and left == 0
    got, left = transfer.pull_rounds(roots, nodes, 1)
    assert [tuple(r) for r in got.collect()] == [("a", 1)] and left == 2
    assert transfer.pull_rounds(roots.limit(0), nodes)[0].count() == 0


def test_packs_are_read_back(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    bodies = [b"one", b"", b"three", bytes(range(256)), b"last"]
    rows = spark.createDataFrame([("data", i, "data", sha(b), b) for i, b in enumerate(bodies)], "pool string, n int, kind string, id string, body binary")
    packed = transfer.next_fit(rows.withColumn("size", F.length("body").cast("bigint")), "pool", ["n"], "size", 8)
    packs, index = transfer.written_packs(packed, "pool", ["n"])
    assert {bytes(r.body) for r in packs.collect()} == {b"onethree", bytes(range(256)), b"last"}
    assert all(r.pack == sha(bytes(r.body)) for r in packs.collect())
    found = get(rows.select("id"), index.withColumn("ord", F.lit(0)), packs).collect()
    assert {bytes(r.body) for r in found} == set(bodies) and all(r.error is None for r in found)
    assert transfer.written_packs(packed, "pool", ["n"], flush=False)[0].count() == 2


def test_referenced(spark):
    entries = tree(spark, folder("d"), file("d/x", "ab"), file("y", "b"))
    got = {tuple(r) for r in transfer.referenced(entries, spark.createDataFrame([("d", "t1"), ("gone", "t2")], "path_str string, tree_id string")).collect()}
    assert ("tree", "t1") in got and {k for k, _ in got} == {"tree", "data"} and len(got) == 3


def test_release_sums_over_peers(spark):
    base, local = tree(spark, file("a"), file("b")), tree(spark, file("a"), file("b", "mine", sec=1009))
    one, two = tree(spark, file("a", "new"), file("b", "theirs")), tree(spark, file("b"))
    out = release(local, {"b2" * 32: (base, one, 2), "c3" * 32: (base, two, 1), "d4" * 32: (base, one, 0)}, "a1" * 32)
    assert {(r.device_id[:2], r.held_entries, r.ops_applied, r.quarantined, r.conflicts_recorded) for r in out.peers.collect()} == {("b2", 2, 1, 1, 1), ("c3", 1, 1, 0, 0)}
    assert (out.total_ops, out.total_quarantined, out.total_conflicts, out.pin_ended) == (2, 1, 1, True)
    assert release(local, {}, "a1" * 32, pinned=False).peers.count() == 0


def test_streams(spark, tmp_path):
    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    line = {"ts": "t", "folder_id": "f", "path": "p", "kind": "add_vs_add", "winner": None, "loser": None, "quarantined_as": "q"}
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0.json").write_text(json.dumps(line) + "\n" + json.dumps(line | {"path": "r"}) + "\n")
    assert [r.path for r in run(watch.conflict_stream(spark, str(tmp_path / "log")), "tail", "append")] == ["p", "r"]
    signals = spark.createDataFrame([("f", "d", "unwatchable"), ("f", "d", "unwatchable"), ("f", "e", "changed")], "folder string, dir string, signal string")
    signals.write.parquet(f"{tmp_path}/signals")
    assert [tuple(r) for r in run(watch.polling(spark.readStream.schema(signals.schema).parquet(f"{tmp_path}/signals"), ["folder"]), "polled", "append")] == [("f", "d")]
    ticks = spark.range(21).select(F.timestamp_seconds("id").alias("ts"))
    assert [(r.ts.second, r.signal) for r in watch.periodic(ticks, audit=20).orderBy("ts", "signal").collect()] == [(0, "audit_due"), (0, "polled_tick"), (10, "polled_tick"), (20, "audit_due"), (20, "polled_tick")]
