"""Tables of a store and guards of applying, on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_core import file, folder, tree

import __spark_entry__ as entry
from tidemark.operators import apply, store
from tidemark.plans import queries

SF = "/root/testdata/sf0.001"


def test_guard_reasons(spark):
    base = tree(spark, file("kept"), file("size", "a"), file("body", "ab"), file("flag"), folder("d"), file("d/x"), file("gone"), folder("dirs"))
    live = tree(spark, file("kept"), file("size", "abc"), file("body", "cd"), file("flag", exec_=True), folder("d"), file("d/x"), file("d/new"), file("appeared"), folder("dirs", 9))
    plan = spark.createDataFrame([(p, a) for a, ps in {"upsert": ["kept", "size", "body", "flag", "gone", "appeared", "dirs", "fresh"], "remove": ["d", "d/x", "unknown"]}.items() for p in ps], "path_str string, action string")
    got = {(r.path_str, r.reason) for r in apply.guarded(plan, base, live).collect()}
    assert got == {("size", "size_mismatch"), ("body", "content_mismatch"), ("flag", "exec_mismatch"), ("gone", "expected_present"), ("appeared", "expected_absent"), ("unknown", "not_in_base"), ("d/new", "expected_absent")}
    assert [r.path_str for r in apply.order(plan.where("path_str like 'd%'")).collect()] == ["d/x", "d", "dirs"]


def test_steps(spark):
    desired, live = tree(spark, file("a"), file("b", sec=5), file("c", "new"), file("readme")), tree(spark, file("a"), file("b"), file("c"), file("readme"))
    removed = spark.createDataFrame([("README",)], "path_str string")
    assert {(r.path_str, r.action) for r in apply.steps(desired, live, removed).collect()} == {("a", "skip"), ("b", "touch"), ("c", "write"), ("readme", "write")}


def test_index_tables(spark):
    entry = "array<struct<kind:string,id:string,plain_off:bigint,plain_len:bigint>>"
    good = hashlib.sha256(b"body").hexdigest()
    footers = spark.createDataFrame([(good, True, [("data", "i", 0, 4)]), ("x" * 64, True, []), ("0" * 64, False, [])], f"pack string, ok boolean, entries {entry}")
    index, bad = store.rebuilt_index(footers)
    assert [tuple(r) for r in index.collect()] == [("data", "i", good, 0, 4)] and bad.count() == 2
    packs = spark.createDataFrame([(good, b"body", [("data", "i", 0, 4), ("data", "j", 0, 1)]), ("1" * 64, b"forged", [("data", "k", 0, 1)])], f"pack string, body binary, entries {entry}")
    new, refused = store.adopted(packs, index)
    assert [r.id for r in new.collect()] == ["j"] and [r.pack for r in refused.collect()] == ["1" * 64]
    assert store.merged_index(index, index).count() == 1 and [r.pack for r in store.distinct_packs(index).collect()] == [good]
    many = spark.range(512)
    assert store.compacted_index(many, index).count() == 1 and store.compacted_index(many.limit(3), index) is None


def test_canonical_ids_leave_times_out(spark):
    ids = lambda *rows: {r.path_str: r.tree_id for r in store.canonical_ids(tree(spark, *rows)).collect()}
    one = ids(folder("a"), file("a/x"), folder("a/e"), file("y"))
    assert one == ids(folder("a", 7), file("a/x", sec=9), folder("a/e", 8), file("y", nsec=3)) and set(one) == {"", "a", "a/e"}
    other = ids(folder("a"), file("a/x", "new"), folder("a/e"), file("y"))
    assert other["a/e"] == one["a/e"] and other["a"] != one["a"] and other[""] != one[""]


def test_canonical_ids_of_large_directories_are_hashed_in_parts(spark, monkeypatch):
    one = {r.path_str: r.tree_id for r in store.canonical_ids(tree(spark, *(file(f"f{i}") for i in range(1500)))).collect()}
    other = {r.path_str: r.tree_id for r in store.canonical_ids(tree(spark, *(file(f"f{i}", "new") if i == 700 else file(f"f{i}") for i in range(1500)))).collect()}
    assert set(one) == set(other) == {""} and one != other
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    join = lambda rows: sha(json.dumps([{"name": n, "id": i} for n, i in sorted(rows)], separators=(",", ":")))
    monkeypatch.setattr(store, "FOLD", 3, raising=False)
    rows = [("big", f"n{i}", f"e{i}") for i in range(2000)] + [("small", "a", "e1"), ("small", "b", "e2")]
    got = {r.path_str: r.tree_id for r in store.folded(spark.createDataFrame(rows, "parent string, name string, id string")).collect()}
    parts = {}
    for _, n, i in rows[:2000]:
        parts.setdefault(sha(n)[:4], []).append((n, i))
    above = {}
    for k, v in parts.items():
        above.setdefault(k[:2], []).append((k, "t" + join(v)))
    assert got == {"big": join([(k, "t" + join(v)) for k, v in above.items()]), "small": join([("a", "e1"), ("b", "e2")])}


def test_canonical_ids_of_the_tables(spark):
    """The query against a plain fold of the same entries, deepest first."""
    sha = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()
    below, empty = {"": []}, hashlib.sha256(b"").hexdigest()
    for r in sorted(queries.Tables(spark, SF).version("local").collect(), key=lambda r: (-len(r.path), r.path_str)):
        own = {"kind": r.kind, "exec": r.exec, "chunks": [c.asDict() for c in r.chunks], "target": r.target}
        mine = below.setdefault(r.path_str, []) if r.kind == "dir" else None
        of = "e" + sha(own) if mine is None else "d" + (sha(sorted(mine, key=lambda c: c["name"])) if mine else empty)
        below.setdefault("/".join(r.path[:-1]), []).append({"name": r.path[-1], "id": of})
    want = {d: sha(sorted(c, key=lambda x: x["name"])) if c else empty for d, c in below.items()}
    assert {r.path_str: r.tree_id for r in entry.queries()["canonical_ids"](spark, SF).collect()} == want and len(want) > 50


def test_choices(spark):
    rows = [((1, 0, 5, "d"), (0, None, 9, "d"), "first"), ((1, 1, 5, "d"), (2, 1, 1, "d"), "second"), ((1, 0, 5, "d"), (2, 0, 6, "d"), "second"), ((0, 0, 9, "d"), (2, 2, 1, "d"), "second"), ((1, 0, 5, "e"), (2, 0, 5, "d"), "first")]
    flat = [(a[0], a[1], a[2], a[3], b[0], b[1], b[2], b[3], w) for a, b, w in rows]
    f = spark.createDataFrame(flat, "ar int, ab int, ac int, ad string, br int, bb int, bc int, bd string, want string")
    side = lambda x: F.struct(F.col(x + "r").alias("root_tree_id"), F.col(x + "b").alias("baseline"), F.col(x + "c").alias("created_sec"), F.lit(0).alias("created_nsec"), F.col(x + "d").alias("device_id"))
    assert f.where(store.donor(side("a"), side("b"), F.lit(0)) != F.col("want")).isEmpty()
    z = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", store.ZERO)], "cur string, off string")
    assert [r[0] for r in z.select(store.pull_needed(F.col("cur"), F.col("off"))).collect()] == [True, False, False]


def test_registry(spark):
    ok = "a" * 32
    rows = [(ok, "/a", "2026-01-01T00:00:00Z"), ("b" * 64, "/a/b", "2026-01-01T00:00:00Z"), ("c" * 31, "/c", "2026-01-01T00:00:00Z"), ("d" * 32, "rel", "2026-01-01T00:00:00Z"), ("e" * 32, "/e", "later"), ("e" * 32, "/f", "2026-01-01T00:00:00Z")]
    got = {(r.folder_id[0], r.error) for r in store.registry_errors(spark.createDataFrame(rows, "folder_id string, path string, added_at string")).collect()}
    assert got == {("a", "overlapping_path"), ("b", "overlapping_path"), ("c", "invalid_id"), ("d", "relative_path"), ("e", "invalid_time"), ("e", "duplicate_id")}


@pytest.mark.parametrize("seen,total,lines", [(2, 4, [2, 3]), (9, 4, [0, 1, 2, 3])])
def test_tail(spark, seen, total, lines):
    log = spark.range(4).select(F.col("id").alias("line"))
    assert [r.line for r in store.conflict_tail(log, seen, total).orderBy("line").collect()] == lines


def test_small_tables(spark):
    wanted = spark.createDataFrame([("d", "n"), ("d", "n"), ("d", "m")], "dir string, name string")
    existing = spark.createDataFrame([("d", "n"), ("d", "n-3"), ("e", "m")], "dir string, name string")
    assert sorted(r.copy for r in store.numbered_copies(wanted, existing).collect()) == ["m", "n-2", "n-4"]
    found, more = store.shown_findings(spark.range(25), ["id"])
    assert found.count() == 20 and more == 5
    conflicts, copies = spark.createDataFrame([("a",), ("b",)], "path_str string"), spark.createDataFrame([("a", "a.2", 0), ("a", "a.1", 1)], "path_str string, copy string, ord int")
    assert {tuple(r) for r in store.quarantine_of(conflicts, copies).collect()} == {("a", "a.2"), ("b", None)}
    manifests = spark.createDataFrame([("m", "f", True), ("n", "f", False), ("o", "g", True)], "id string, folder_id string, parsed boolean")
    assert [r.id for r in store.usable_parent(manifests, manifests.select("id", F.lit("f").alias("folder_id"))).collect()] == ["m"]
    assert [r.path for r in store.deepest_first(spark.createDataFrame([(["a"],), (["a", "b"],), (["b"],)], "path array<string>")).collect()] == [["a", "b"], ["a"], ["b"]]
    assert spark.range(1).select(store.no_change(F.lit("r"), F.lit("r"), F.lit("old"), F.lit("new"))).first()[0] == "old"
