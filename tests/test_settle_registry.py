"""Whole syncs with their ledgers, releases of many peers, registries, the index as a folder, and pins' patterns."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import apply, ignore, ledger, ordered, registry
from tidemark.operators import settle as st
from tidemark.sources import index as ix

ENTRY = "path_str string, kind string, exec boolean, mtime_sec bigint, mtime_nsec int, chunks array<struct<id:string,len:bigint>>, target string"
MINE, THEIRS, NOW = st.Side("a1" * 32, "m1"), st.Side("b2" * 32, "m2"), (1_700_000_000, 7)


def tree(spark, **files):
    """Files by name (__ is a slash): (chunk, time); directories above them."""
    names = {n.replace("__", "/").replace("_dot_", "."): v for n, v in files.items()}
    dirs = {n.rpartition("/")[0] for n in names if "/" in n}
    rows = [(d, "dir", False, 1, 0, [], None) for d in dirs] + [(n, "file", False, t, 0, [(c, 5)], None) for n, (c, t) in names.items()]
    return spark.createDataFrame(rows, ENTRY).withColumn("path", F.split("path_str", "/"))


def test_settle(spark):
    base = tree(spark, a=("x", 1), d__b=("y", 1), d__c=("z", 1), e__gone=("g", 1))
    local = tree(spark, a=("mine", 2000), d__b=("y", 1), d__c=("edited", 5), e__gone=("g", 1), top=("t", 9))
    remote = tree(spark, a=("theirs", 3000), d__b=("y2", 7), top=("t2", 8))
    taken = local.unionByName(tree(spark, **{"a_dot_conflict_dot_a1a1a1a1-19700101-003320": ("q", 1), "a_dot_conflict_dot_a1a1a1a1-19700101-003320-2": ("q", 1)}))
    out = st.settle(base, local, remote, MINE, THEIRS, "f0" * 16, NOW, live=taken, stored=spark.createDataFrame([("y2",)], "id string"))
    assert [tuple(r) for r in out.missing.collect()] in ([("theirs", 5), ("t2", 5)], [("t2", 5), ("theirs", 5)])
    assert {(r.path_str, r.copy) for r in out.copies.collect()} == {("a", "a.conflict.a1a1a1a1-19700101-003320-3"), ("top", "top.conflict.b2b2b2b2-19700101-000008")}
    rows = {r.path: r for r in out.conflicts.collect()}
    assert rows["a"].ts == "2023-11-14T22:13:20Z" and rows["a"].kind == "both_changed" and rows["a"].winner.device == THEIRS.device and rows["a"].loser.mtime_sec == 2000
    assert rows["d/c"].kind == "delete_vs_edit" and rows["d/c"].loser.mtime_sec is None and rows["d/c"].quarantined_as is None and rows["top"].quarantined_as.startswith("top.conflict.")
    assert [(r.action, r.path_str) for r in out.steps.orderBy("position").collect()] == [("remove", "e/gone"), ("remove", "e"), ("write", "a"), ("write", "d/b")]
    assert out.agreement.count() == 0 and out.held.count() == 0 and out.divergences.count() == 0
    again = st.settle(remote, remote, remote, MINE, THEIRS, "f0" * 16, NOW)
    assert [tuple(r) for r in again.agreement.collect()] == [(THEIRS.device, "m2", *NOW)] and again.steps.count() == 0


def test_settle_with_a_pin(spark):
    base, remote = tree(spark, a=("x", 1), b=("y", 1), c=("z", 1)), tree(spark, a=("x2", 2), b=("y2", 2))
    had = spark.createDataFrame([(1, 1, "a", THEIRS.device, "m2", [], "remote_apply", None)], "held_sec bigint, held_nsec int, path string, device_id string, remote_manifest_id string, chunks array<struct<id:string,len:bigint>>, decision string, conflict_winner string")
    out = st.settle(base, base, remote, MINE, THEIRS, "f", NOW, held=F.col("path_str").isin("a", "c"), held_ledger=had)
    assert [(r.path, r.decision, r.held_sec) for r in out.held.collect()] == [("c", "remote_delete", NOW[0])]
    assert [(r.action, r.path_str) for r in out.steps.collect()] == [("write", "b")] and out.agreement.count() == 0


def test_touches_and_guards(spark):
    """A changed time alone is set, not written; what is live as desired is neither guarded nor done."""
    base, remote = tree(spark, a=("x", 1), b=("y", 1), c=("z", 1)), tree(spark, a=("x", 5), b=("y", 6), c=("z2", 7))
    live = tree(spark, a=("x", 1), b=("odd", 3), c=("z2", 7))
    out = st.settle(base, base, remote, MINE, THEIRS, "f", NOW, live=live)
    assert [(r.action, r.path_str) for r in out.steps.orderBy("position").collect()] == [("write", "b"), ("touch", "a")]
    assert [tuple(r) for r in out.divergences.collect()] == [("b", "content_mismatch")]
    plan = spark.createDataFrame([("c", "upsert")], "path_str string, action string")
    assert [tuple(r) for r in apply.guarded(plan, base, live).collect()] == [("c", "content_mismatch")] and apply.guarded(plan, base, live, remote).count() == 0


def test_case_only_rename_is_written_anew(spark):
    old, new = tree(spark, Name=("x", 1)), tree(spark, NAME=("x", 1))
    plan = spark.createDataFrame([("Name", "remove"), ("NAME", "upsert")], "path_str string, action string")
    live = old.unionByName(new)  # a file system that doesn't tell cases apart shows both
    assert [(r.action, r.path_str) for r in apply.phases(plan, new, live).orderBy("position").collect()] == [("remove", "Name"), ("write", "NAME")]


def test_release_of_many_peers(spark):
    """The same as converging with each peer alone."""
    local, base = tree(spark, a=("mine", 5), d__b=("y", 1), c=("z", 1)), tree(spark, a=("x", 1), d__b=("y", 1), c=("z", 1))
    remotes = {"b2" * 32: tree(spark, a=("theirs", 9), d__b=("y2", 1)), "0c" * 32: tree(spark, a=("other", 5), d__b=("y", 1), c=("z", 1)), "ee" * 32: base}
    of = lambda frames: __import__("functools").reduce(lambda x, y: x.unionByName(y), (f.withColumn("device_id", F.lit(d)) for d, f in frames.items()))
    held = spark.createDataFrame([(d, p) for d in list(remotes)[:2] for p in ("a", "a", "b")], "device_id string, path string")
    peers, plan = st.release_all(local, of(dict.fromkeys(remotes, base)), of(remotes), held, MINE.device)
    got = {r.device_id: (r.held_entries, r.held_paths, r.ops_applied, r.quarantined, r.conflicts_recorded) for r in peers.collect()}
    want = {}
    for d in list(remotes)[:2]:
        one = st.settle(base, local, remotes[d], MINE, st.Side(d, "m"), "f", NOW)
        want[d] = (3, 2, one.plan.materialize.count(), one.plan.quarantine.count(), one.plan.conflicts.count())
    assert got == want and got["b2" * 32][2:] == (3, 1, 1) and got["0c" * 32][2:] == (0, 1, 1)
    assert tuple(st.release_totals(peers).first()) == (2, 2, 3, True)


def test_registering_one_after_the_other(spark):
    """Each is refused by what was registered before it, not by what was refused."""
    records = spark.createDataFrame([("r", "/r/x", "t")], "folder_id string, path string, added_at string")
    paths = ["/a/b", "/a", "/a/b/c", "/a/d/", "/a/d", "/r", "/r/x/y", "/rx", "rel", "/z/1/2", "/z/1", "/z"]
    wanted = spark.createDataFrame([(f"w{i}", p, "t", i) for i, p in enumerate(paths)], "folder_id string, path string, added_at string, ord int")
    out, refused = registry.register(records, wanted)
    have, no = ["/r/x"], {}
    for p in paths:
        bare = p.rstrip("/")
        if not p.startswith("/"):
            no[p] = "bad_path"
        elif any(bare == h.rstrip("/") or bare.startswith(h.rstrip("/") + "/") or h.startswith(bare + "/") for h in have):
            no[p] = "already_synced"
        else:
            have.append(p)
    assert sorted(r.path for r in out.collect()) == sorted(have) and {r.path: r.error for r in refused.collect()} == no
    none = records.limit(0)
    assert registry.register(none, wanted.limit(0))[0].count() == 0 and registry.unregister(records, records.select("folder_id"))[0].count() == 0


def test_index_folder(spark, tmp_path):
    index = ix.Index(spark, f"file://{tmp_path}/index")
    assert index.load().count() == 0 and not index.compact(1)
    row = lambda i, pack: ("data", f"id{i}", pack, i, 1)
    for part in ([row(1, "p"), row(2, "p")], [row(2, "p"), row(3, "q")], [row(1, "q"), row(3, "q")]):
        index.append(spark.createDataFrame(part, ix.COLUMNS))
    assert index.parts() == ["part-00000001", "part-00000002", "part-00000003"] and not index.compact(4)
    first = {(r.id, r.pack): r.ord.part for r in index.places().collect()}
    assert first == {("id1", "p"): "part-00000001", ("id2", "p"): "part-00000001", ("id3", "q"): "part-00000002", ("id1", "q"): "part-00000003"}
    (tmp_path / "index" / "part-00000009").mkdir()  # a part that was cut off has no mark of success
    assert len(index.parts()) == 3 and index.compact(3)
    assert index.parts() == ["part-00000010-all"] and {(r.id, r.pack) for r in index.load().collect()} == set(first)
    order = [r.id + r.pack for r in index.load().orderBy("ord").collect()]
    assert order.index("id3q") > max(order.index("id1p"), order.index("id2p")) and order[-1] == "id1q"
    index.append(spark.createDataFrame([row(1, "p")], ix.COLUMNS))
    # a compaction that was cut off before it deleted what it stands for
    spark.createDataFrame([row(7, "old")], ix.COLUMNS).write.parquet(f"{tmp_path}/index/part-00000004")
    assert index.parts() == ["part-00000010-all", "part-00000011"] and index.load().where("id = 'id7'").count() == 0


def test_pins_are_refused(spark):
    with pytest.raises(ignore.BadPattern, match="bad pattern: a\\["):
        ignore.held_column(F.col("path"), ["ok", "a["])
    assert ignore.validated_pins(["a[", "*"]) == ["a[", "*"]
    pins = spark.createDataFrame([(1, "ok"), (1, "a["), (2, "a["), (2, "*"), (3, None), (3, "# [")], "pin int, pattern string")
    assert [tuple(r) for r in ignore.bad_pins(pins, "pin", "pattern").collect()] == [(1, "a[")]


def test_changes_of_one_key_in_blocks(spark, monkeypatch):
    """One key over many blocks, nulls among the values, columns that have the names used inside."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 10)
    rows = [(1, i, None if i // 7 % 3 == 0 else f"v{i // 7 % 2}", 5) for i in range(200)] + [(None, 1, None, 5), (None, 2, "x", 5)]
    out = ledger.changes(spark.createDataFrame(rows, "k int, at int, v string, before int"), "k", ["at"], ["v"])
    want = [(k, at) for j, (k, at, v, _) in enumerate(rows) if j == 0 or rows[j - 1][0] != k or rows[j - 1][2] != v]
    assert sorted(((r.k or 0, r["at"]) for r in out.collect())) == sorted((k or 0, at) for k, at in want) and out.columns == ["k", "at", "v", "before"]


def test_long_rule_lists_drop_the_same_events(spark):
    lines = [f"x{i}.txt" for i in range(40)] + ["*.log", "build/", "!keep.log", "a/**/z", "docs/*"] + [f"!y{i}" for i in range(20)]
    rules = ignore.compile_rules(lines)
    paths = ["x3.txt", "a/x3.txt", "k.log", "keep.log", "build", "build/x", "q/build/x", "a/b/z", "a/z/c", "docs/a", "docs/a/b", ".store/x", "q/.store", "", "plain", "docs", "y3"]
    frame = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    assert len(rules) > ignore.LONG
    long, short = (frame.select("path", ignore.event_dropped(F.col("path"), rules).alias("d")) for _ in range(2))
    try:
        ignore.LONG, kept = 10_000, ignore.LONG
        short = frame.select("path", ignore.event_dropped(F.col("path"), rules).alias("d"))
    finally:
        ignore.LONG = kept
    want = {r.path: r.d for r in short.where("path is not null").collect()}
    assert {r.path: r.d for r in long.where("path is not null").collect()} == want and sum(want.values()) >= 10


def test_tidy_keeps_what_is_asked_for(spark):
    from tidemark.session import is_kept, keep, tidy

    first = keep(spark.range(3), "first")
    with tidy(spark) as stay:
        gone, out = keep(spark.range(4), "gone"), keep(spark.range(5), "out")
        stay.append(out)
    assert is_kept(first) and is_kept(out) and not is_kept(gone)
def test_decisions_carry_digests_and_whole_brings_the_lists(spark):
    from tidemark.operators import reconcile as rc

    base, local, remote = tree(spark, a=("x", 1), b=("y", 1)), tree(spark, a=("AB" * 32, 2), b=("y", 1)), tree(spark, a=("x", 1), b=("ab" * 32, 3))
    plan = rc.reconcile(base, local, remote, "a1" * 32, "b2" * 32)
    assert plan.materialize.select("result.chunks").dtypes == [("chunks", "binary")]  # before: the list, through every join
    (row,) = plan.whole(plan.materialize, "base", "result").collect()
    assert [c.id for c in row.base.chunks] == ["y"] and [c.id for c in row.result.chunks] == ["ab" * 32]
    assert [tuple(r) for r in plan.send.collect()] == [("AB" * 32, 5)] and [tuple(r) for r in plan.fetch.collect()] == [("ab" * 32, 5)]
