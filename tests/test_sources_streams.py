"""Walks that obey rules, ledgers as a data source, packs read by range, regions, and the watch engine."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import regions
from tidemark.sources import ledgers, packs, walk
from tidemark.streaming import engine

TREE = {
    "tidemark.ignore": "*.log\n!node_modules/\n!.env\nscratch/\n", "README.md": "", ".env": "", "app/main.rs": "", "debug.log": "", "scratch/junk.bin": "", "scratch/tidemark.ignore": "!*",
    "sub/tidemark.ignore": "!keep.log\n", "sub/keep.log": "", "sub/other.log": "", "node_modules/pkg/index.js": "", ".DS_Store": "", "notes.txt~": "",
}
ADMITTED = ".env README.md app app/main.rs tidemark.ignore node_modules node_modules/pkg node_modules/pkg/index.js sub sub/tidemark.ignore sub/keep.log".split()


def grow(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_walk_obeys_rules_on_its_way(spark, tmp_path):
    grow(tmp_path, TREE)
    found, listed = walk.walk_admitted(spark, str(tmp_path))
    assert sorted(r.path_str for r in found.collect()) == sorted(ADMITTED)
    assert {r.raw for r in listed.collect()} == {"", "app", "node_modules", "node_modules/pkg", "sub"}


def test_nested_rules_presets_and_overrides(spark, tmp_path):
    """Deeper files override shallower ones, two files of one directory hold in order, rules of a directory don't hold beside it."""
    grow(tmp_path, {
        ".gitignore": "*.tmp\nbuild/\n", "a/.gitignore": "*.txt\n", "a/tidemark.ignore": "!b.txt\n", "a/b.txt": "", "a/c.txt": "", "a/deep/tidemark.ignore": "!c.txt\n*.md\n", "a/deep/c.txt": "", "a/deep/b.txt": "", "a/deep/x.md": "",
        "a/x.md": "", "b/c.txt": "", "b/c.tmp": "", "build/c.txt": "", "b/build/x": "", "cache/x": "", "kept.conflict.1.tmp": "", "é/.gitignore": "x\n", "é/x": "", "é/y": "",
    })
    names = lambda **k: {r.path_str for r in walk.walk_admitted(spark, str(tmp_path), walk.RuleSet(**k))[0].where("kind = 'file'").collect()} - {".gitignore"}
    all_of = {"a/.gitignore", "a/tidemark.ignore", "a/b.txt", "a/deep/tidemark.ignore", "a/deep/c.txt", "a/deep/b.txt", "a/x.md", "b/c.txt", "cache/x", "kept.conflict.1.tmp", "é/.gitignore", "é/y"}
    assert names() == all_of
    assert names(presets=("opencode",)) == all_of - {"cache/x"}
    assert names(overrides=("!*.tmp", "a/")) == {x for x in all_of if not x.startswith("a/")} | {"b/c.tmp"}
    assert names(names=()) >= {"a/c.txt", "build/c.txt", "b/build/x"}
    entries, refused = walk.full_snapshot(spark, str(tmp_path), (1 << 53) | 0b1000111, rules=walk.RuleSet())
    assert {r.path_str for r in entries.where("kind = 'file'").collect()} - {".gitignore"} == all_of and refused.count() == 0


# ledgers

SCHEMA = "n bigint, text string, at struct<device:string,sec:int>, ids array<string>"


def line(n, text="x"):
    return json.dumps({"n": n, "text": text, "at": {"device": "d", "sec": n}, "ids": ["a", "b"], "more": 1}) + "\n"


def read(spark, path, **options):
    return ledgers.register(spark).read.format("jsonl_ledger").schema(SCHEMA).options(path=str(path), **options).load()


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ledger_in_ranges(spark, tmp_path, size):
    """Every line is read once, wherever the ranges end."""
    texts = ["", "é" * 30, "y" * 200, "line\nbreak", "z"]
    (tmp_path / "a.jsonl").write_text("\n".join(line(i, t)[:-1] + "\n" * (i % 3) for i, t in enumerate(texts)) + "\n  \n")
    if size > 1:
        (tmp_path / "b.jsonl").write_text(line(9))
    rows = read(spark, tmp_path, range_bytes=size).orderBy("n").collect()
    assert [r.text for r in rows] == [*texts, *["x"] * (size > 1)] and rows[0].at == ("d", 0) and rows[0].ids == ["a", "b"]


def test_malformed_lines_are_named(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    for bad, reason in (('{"n": 1,', "Expecting"), ('{"n": "one"}', "n: .*bigint"), ("[1]", "no object"), ('{"at": {"sec": 3000000000}}', "sec: .*int")):
        path.write_text(line(1) + "\n" + line(2) * 3 + bad + "\n" + line(3))
        with pytest.raises(Exception, match=rf"log.jsonl, line 6: .*{reason}"):
            read(spark, path, range_bytes=50).collect()
    path.write_bytes(line(1).encode() + b"\xff\n")
    with pytest.raises(Exception, match="line 2"):
        read(spark, path).collect()
    assert read(spark, tmp_path / "none.jsonl").count() == 0


def test_torn_last_line(spark, tmp_path):
    path = tmp_path / "held.jsonl"
    path.write_text(line(1) + line(2)[:-5])
    assert [r.n for r in read(spark, path, torn="drop").collect()] == [1]
    with pytest.raises(Exception, match="line 2"):
        read(spark, path).collect()
    path.write_text(line(1) + line(2)[:-1])
    assert [r.n for r in read(spark, path, torn="drop").orderBy("n").collect()] == [1, 2]
    path.write_text(line(1)[:-5] + "\n" + line(2))
    with pytest.raises(Exception, match="line 1"):
        read(spark, path, torn="drop").collect()


@pytest.mark.parametrize("on_shrink, again", [("start", [8, 9]), ("end", [])])
def test_ledger_as_a_stream(spark, tmp_path, on_shrink, again):
    """The log grows, tears, grows on and is rewritten; the query is stopped and started between."""
    log, out = tmp_path / "log.jsonl", str(tmp_path / "out")
    seen = []

    def step():
        stream = ledgers.register(spark).readStream.format("jsonl_ledger").schema(SCHEMA).options(path=str(log), on_shrink=on_shrink, range_bytes=100).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        now = sorted(r.n for r in spark.read.schema(SCHEMA).parquet(out).collect()) if os.path.isdir(out) else []
        new = list(now)
        for x in seen:
            new.remove(x)
        seen[:] = now
        return new

    log.write_text(line(1) + line(2))
    assert step() == [1, 2]
    with log.open("a") as f:
        f.write(line(3) + line(4)[:9])
    assert step() == [3]
    with log.open("a") as f:
        f.write(line(4)[9:] + line(5))
    assert step() == [4, 5]
    fresh = tmp_path / "fresh"
    fresh.write_text(line(8) + line(9))
    os.replace(fresh, log)
    assert step() == again
    with log.open("a") as f:
        f.write(line(10))
    assert step() == [10]


# packs


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_packs_by_range(spark, tmp_path):
    folder = str(tmp_path / "packs")
    body = {k: k.encode() * 50 for k in "abcdefg"}
    ids = {k: sha(v) for k, v in body.items()}
    rows = [("p", ids[k], body[k]) for k in "abcde"] + [("q", ids[k], body[k]) for k in "abf"] + [("r", ids["c"], b"damaged"), ("s", ids["g"], b"damaged as well")]
    index = packs.write(spark.createDataFrame(rows, "pack string, id string, body binary"), f"file://{folder}")
    at = {(r.pack, r.id): (r.plain_off, r.plain_len) for r in index.collect()}
    assert len(at) == len(rows) and sorted(os.listdir(folder)) == ["p.pack", "q.pack", "r.pack", "s.pack"]
    (tmp_path / "packs" / "t.pack").write_bytes(b"short")
    places = [(ids["a"], "p", *at["p", ids["a"]], 1), (ids["b"], "gone", 0, 5, 0), (ids["b"], "q", *at["q", ids["b"]], 1), (ids["c"], "r", *at["r", ids["c"]], 0), (ids["c"], "p", *at["p", ids["c"]], 1)]
    places += [(ids["d"], "p", 1, 50, 0), (ids["e"], "t", 0, 5, 0), (ids["e"], "p", *at["p", ids["e"]], 2), (ids["g"], "s", *at["s", ids["g"]], 0), (ids["g"], "gone", 0, 1, 1), (sha(b"x"), "gone", 0, 1, 0)]
    staged = spark.createDataFrame([(ids["f"], body["f"]), (ids["a"], b"wrong")], "id string, body binary")
    wanted = spark.createDataFrame([(x,) for x in [*ids.values(), sha(b"x"), sha(b"y")]], "id string")
    got = {r.id: (r.pack, r.body and bytes(r.body), r.error) for r in packs.get(wanted, spark.createDataFrame(places, "id string, pack string, plain_off bigint, plain_len bigint, ord int"), f"file://{folder}", staged).collect()}
    assert got == {
        ids["a"]: (None, None, "hash_mismatch"), ids["b"]: ("q", body["b"], None), ids["c"]: ("p", body["c"], None), ids["d"]: ("p", None, "disagreement"), ids["e"]: ("p", body["e"], None), ids["f"]: (None, body["f"], None),
        ids["g"]: (None, None, "hash_mismatch"), sha(b"x"): (None, None, "not_found"), sha(b"y"): (None, None, "not_found"),
    }


def test_regions(spark, tmp_path, monkeypatch):
    data = bytes(range(256)) * 4
    regions_of = lambda d, n: [(sha(d[i : i + n]), len(d[i : i + n])) for i in range(0, len(d), n)]
    cases = {"same": (data, None), "first": (b"!" + data[1:], 0), "last": (data[:-1] + b"!", 10), "short": (data[:650], 6), "cut": (data[:600], 6), "longer": (data + b"more", None), "empty": (b"", 0)}
    for name, (body, _) in cases.items():
        (tmp_path / name).write_bytes(body)
    listed = [(str(tmp_path / n), regions_of(data, 100)) for n in [*cases, "gone"]] + [(str(tmp_path / "same").replace(str(tmp_path), str(tmp_path) + "/."), [])]
    wanted = spark.createDataFrame(listed, "path string, chunks array<struct<id:string,len:bigint>>")
    for size in (64 << 20, 150):
        monkeypatch.setattr(regions, "STRETCH", size)
        got = {r.path.rpartition("/")[2] if "/./" not in r.path else "none": r.mismatch for r in regions.file_mismatches(wanted).collect()}
        assert got == {**{n: bad for n, (_, bad) in cases.items()}, "gone": 0, "none": None}
    rows = spark.createDataFrame([(n, body, regions_of(data, 100)) for n, (body, _) in cases.items()], "name string, data binary, chunks array<struct<id:string,len:bigint>>")
    assert {r.name: r.bad for r in rows.select("name", regions.first_mismatch(F.col("data"), F.col("chunks")).alias("bad")).collect()} == {n: bad for n, (_, bad) in cases.items()}


# watch

SIGNALS = [
    # root, second, signal, dir
    ("a", 0.0, "changed", "x"), ("a", 0.3, "changed", "y"), ("a", 0.7, "polled_changed", "x"), ("a", 2.0, "unwatchable", "net"), ("a", 2.1, "overflow", None), ("a", 9.0, "root_absent", None), ("a", 9.1, "root_absent", None),
    ("a", 13.0, "root_present", None), ("a", 21.0, "changed", "z"), ("a", 41.0, "changed", ""), ("b", 1.0, "root_present", None), ("b", 5.0, "changed", "q"), ("b", 45.0, "changed", "end"),
]
#: What a reader of the rules expects: quiet for half a second ends a batch, net is swept each 5 seconds but while the root is gone, audits are due each 20.
ACTIONS = [
    ("a", 1200, "incremental", "poll", ["x", "y"]), ("a", 2000, "start_polling", "events", ["net"]), ("a", 2600, "full_rescan", "overflow_recovery", []), ("a", 7000, "sweep", "poll", ["net"]), ("a", 9000, "root_vanished", "events", []),
    ("a", 13500, "full_rescan", "overflow_recovery", []), ("a", 17000, "sweep", "poll", ["net"]), ("a", 20500, "audit", "audit", []), ("a", 21500, "incremental", "events", ["z"]), ("a", 22000, "sweep", "poll", ["net"]), ("a", 27000, "sweep", "poll", ["net"]),
    ("a", 32000, "sweep", "poll", ["net"]), ("a", 37000, "sweep", "poll", ["net"]), ("a", 40500, "audit", "audit", []), ("b", 5500, "incremental", "events", ["q"]), ("b", 21500, "audit", "audit", []), ("b", 41500, "audit", "audit", []),
]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", engine.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def signal_files(folder, parts):
    folder.mkdir(exist_ok=True)
    for k, rows in parts:
        text = "\n".join(json.dumps({"root": r, "ts": f"2026-01-01T00:00:{s:09.6f}Z", "seq": i, "signal": x, "dir": d}) for i, (r, s, x, d) in rows)
        (folder / f"part-{k}.json").write_text(text)


def test_watch_engine_over_restarts(rocks, tmp_path):
    """The same actions however the signals are split and wherever the query is stopped."""
    origin = 1767225600000
    for cuts in ([len(SIGNALS)], [3, 6, 8, 9]):
        base = tmp_path / str(len(cuts))
        base.mkdir()
        rows, k = sorted(enumerate(SIGNALS), key=lambda x: x[1][1]), 0
        for n, upto in enumerate([*cuts, len(SIGNALS)] if len(cuts) > 1 else cuts):
            signal_files(base / "in", [(n, rows[k:upto])])
            k = upto
            stream = rocks.readStream.schema("root string, ts timestamp, seq int, signal string, dir string").json(str(base / "in")).withWatermark("ts", "0 seconds")
            q = engine.watched(stream, True, poll_ms=5_000, audit_ms=20_000).writeStream.format("parquet").option("checkpointLocation", str(base / "state")).trigger(availableNow=True).start(str(base / "out"))
            q.awaitTermination()
        got = [(r.root, r.at_ms - origin, r.action, r.trigger, r.dirs) for r in rocks.read.parquet(str(base / "out")).collect()]
        end = 41_000 if len(cuts) > 1 else 45_000
        assert sorted(x for x in got if x[1] <= 41_000) == sorted(x for x in ACTIONS if x[1] <= 41_000), end


def test_watch_engine_by_the_clock(rocks, tmp_path):
    """Processing time: a batch ends by its timer, and a polled directory is swept again and again, though no signal comes."""
    signal_files(tmp_path / "in", [(0, list(enumerate([("a", 0.0, "changed", "x"), ("a", 0.1, "unwatchable", "net")])))])
    stream = rocks.readStream.schema("root string, ts timestamp, seq int, signal string, dir string").json(str(tmp_path / "in"))
    q = engine.watched(stream, quiet_ms=300, poll_ms=700).writeStream.format("memory").queryName("by_the_clock").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until:
            rows = [(r.action, r.trigger, r.dirs) for r in rocks.table("by_the_clock").orderBy("at_ms").collect()]
            if sum(a == "sweep" for a, *_ in rows) >= 3:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert rows[0] == ("start_polling", "events", ["net"]) and ("incremental", "events", ["x"]) in rows and rows.count(("sweep", "poll", ["net"])) >= 3
