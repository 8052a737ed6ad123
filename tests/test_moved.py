"""What is written and shuffled: chunk lists move where they are asked for, with packed ids, and nowhere else."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import diff as d
from tidemark.operators import apply, reconcile, trees
from tidemark.plans import queries, snapshots

SF = "/root/testdata/sf0.001"
ENTRY = "path array<string>, path_str string, kind string, exec boolean, mtime_sec bigint, mtime_nsec int, chunks array<struct<id:string,len:bigint>>, target string"


def shuffled(df) -> list[str]:
    """Schemas of what is repartitioned in a plan."""
    todo, out = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "RepartitionByExpression":
            out.append(plan.schema().json())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.fixture
def written(monkeypatch):
    """(label, schema) of the tables that trees write."""
    out, keep = [], trees.keep
    monkeypatch.setattr(trees, "keep", lambda df, label: (out.append((label, dict(df.dtypes))), keep(df, label))[1])
    return out


@pytest.mark.parametrize("name", ["tree_descent", "tree_nodes_read", "tree_upkeep"])
def test_trees_are_compared_without_chunk_lists(spark, written, name):
    assert entry.queries()[name](spark, SF).count() > 0
    assert written and not any("array<struct" in t for _, kept in written for t in kept.values())


def test_round_trip_writes_each_list_once(spark, written):
    assert entry.queries()["tree_round_trip"](spark, SF).count() > 0
    assert [(label, kept["chunks"]) for label, kept in written if "chunks" in kept] == [("nodes", "array<struct<id:binary,len:bigint>>")]


@pytest.mark.parametrize("name", ["scan_counts", "scan_pass"])
def test_a_pass_adds_sizes_up_without_chunk_lists(spark, name):
    found = shuffled(entry.queries()[name](spark, SF))
    assert found and not any("_chunks" in x for x in found)


def test_changed_chunks_move_with_packed_ids(spark):
    sha = "ab" * 32
    one = lambda *ids: spark.createDataFrame([(["a"], "a", "file", False, 1, 0, [(i, 5) for i in ids], None)], ENTRY)
    changes = d.diff(one("x", sha), one("AB", sha, "abc"))
    assert {r.id for r in d.changed_chunks(changes).collect()} == {"AB", sha, "abc"}
    row = changes.first()
    assert [c.id for c in row.before.chunks] == ["x", sha] and [tuple(c) for c in row.after.chunks] == [("AB", 5), (sha, 5), ("abc", 5)]
    lists = [x for x in shuffled(changes) if "_chunks" in x]
    assert lists and all('"name":"id","type":"binary"' in x for x in lists)


@pytest.fixture
def kept(monkeypatch):
    """Labels of the tables that plans and guards write."""
    out = []
    for module in (apply, reconcile):
        monkeypatch.setattr(module, "keep", lambda df, label, keep=module.keep, **more: (out.append(label), keep(df, label, **more))[1])
    return out


@pytest.mark.parametrize("name", ["reconcile_errors", "reconcile_fold", "settle_conflicts", "release_many", "converge_mutations"])
def test_states_of_a_plan_are_written_once_with_their_decisions(spark, kept, name):
    entry.queries()[name](spark, SF).count()
    assert "three" not in kept and kept.count("decisions") == 1


def test_guards_read_each_state_once(spark, monkeypatch):
    met, whole = [], apply.paired
    monkeypatch.setattr(apply, "paired", lambda *a, **sides: (met.append(sorted(sides)), whole(*a, **sides))[1])
    assert entry.queries()["apply_guard"](spark, SF).count() > 0
    assert met == [["e", "v", "w"]]


def test_guards_of_odd_plans(spark):
    def tree(**files):
        return spark.createDataFrame([([n], n, k, False, t, 0, [("x", 5)] if k == "file" else [], None) for n, (k, t) in files.items()], ENTRY)

    base = tree(a=("file", 1), b=("file", 1), d=("dir", 1))
    live = tree(b=("file", 1), d=("dir", 9), B=("file", 7), n=("file", 7))
    desired = tree(B=("file", 7), n=("file", 7), d=("dir", 3), only=("file", 1))
    plan = spark.createDataFrame([("a", "remove"), ("a", "upsert"), ("b", "remove"), ("B", "upsert"), ("n", "upsert"), ("d", "upsert"), ("only", "remove"), ("nowhere", "remove"), ("nowhere", "upsert")], "path_str string, action string")
    got = sorted(map(tuple, apply.guarded(plan, base, live, desired).collect()))
    # B is live as desired, but b, which differs by case alone, is removed
    assert got == [("B", "expected_absent"), ("a", "expected_present"), ("a", "expected_present"), ("nowhere", "not_in_base"), ("only", "not_in_base")]


@pytest.fixture
def exchanges(spark):
    """Schemas, by origin, of what a plan shuffles where nothing is broadcast; what is read again counts once."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)

    def of(df):
        todo, out = [df._jdf.queryExecution().executedPlan()], []
        while todo:
            plan = todo.pop()
            if plan.nodeName() == "Exchange":
                out.append((plan.shuffleOrigin().toString(), plan.schema().json()))
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
        return out

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def test_orders_go_to_customers_without_their_lines(spark, exchanges):
    found = exchanges(snapshots.with_lines(queries.Tables(spark, SF)))
    assert found and not any('"name":"lines"' in schema for _, schema in found)


def test_what_is_hidden_is_found_in_the_exchange_of_states(spark, exchanges):
    decided = reconcile.decide(*queries.versions(queries.Tables(spark, SF)), "a1" * 32, "b2" * 32)
    by_path = [schema for origin, schema in exchanges(decided) if origin == "REPARTITION_BY_COL"]
    assert len(by_path) == 1 and '"name":"chunks","type":"binary"' in by_path[0]


def test_components_of_paths_are_not_written(spark, monkeypatch):
    out, keep = {}, reconcile.keep
    monkeypatch.setattr(reconcile, "keep", lambda df, label, **more: (out.setdefault(label, df.columns), keep(df, label, **more))[1])
    made = queries.plan(queries.Tables(spark, SF))
    assert set(out) == {"decisions", "materialize"} and not any("path" in c for c in out.values())
    for rows in (made.decisions, made.materialize, made.quarantine, made.conflicts):
        assert rows.where("path is null or array_join(path, '/') <> path_str").isEmpty() and not rows.isEmpty()


def test_what_appears_below_a_changed_type_is_hidden_on_its_side_alone(spark):
    def tree(**of):
        rows = [(n.split("_"), n.replace("_", "/"), k, False, t, 0, [("x", t)] if k == "file" else [], None) for n, (k, t) in of.items()]
        return spark.createDataFrame(rows, ENTRY)

    base = tree(d=("dir", 1), d_a=("file", 1), d_e=("dir", 1), d_e_b=("file", 1), f=("file", 1), g=("dir", 1), g_c=("file", 1))
    local = tree(d=("file", 2), f=("dir", 1), f_n=("file", 3), g=("dir", 9), g_c=("file", 1))
    remote = tree(d=("dir", 1), d_a=("file", 5), d_e=("dir", 1), d_e_b=("file", 1), f=("file", 1), g=("dir", 1))
    got = {r.path_str: (r.decision, r.conflict, r.winner) for r in reconcile.decide(base, local, remote, "a", "b").collect()}
    # d/a went locally below what became a file: only the remote change of it is told; d/e/b and f/n aren't mentioned
    assert got == {"d": ("keep_local", None, None), "d/a": ("apply_remote", None, None), "f": ("keep_local", None, None), "g/c": ("apply_remote", None, None)}


def test_released_trees_are_dealt_by_path_in_one_exchange(spark, exchanges, monkeypatch):
    """What many peers' trees have alike goes to the same place, side by side, once."""
    out, kept_by_path = [], reconcile.kept_by_path
    monkeypatch.setattr(reconcile, "kept_by_path", lambda rows, label: (out.append((label, exchanges(rows))), kept_by_path(rows, label))[1])
    entry.queries()["release_many"](spark, SF)
    by_path = [schema for origin, schema in dict(out)["decisions"] if origin == "REPARTITION_BY_COL"]
    assert len(by_path) == 1 and '"name":"device_id"' in by_path[0]


def test_what_is_hidden_is_so_in_its_own_tree_alone(spark):
    def tree(root, **of):
        rows = [(n.split("_"), n.replace("_", "/"), k, False, t, 0, [("x", t)] if k == "file" else [], None, root) for n, (k, t) in of.items()]
        return spark.createDataFrame(rows, ENTRY + ", device_id string")

    base = {"d": ("dir", 1), "d_a": ("file", 1), "d_e": ("dir", 1), "d_e_b": ("file", 1), "f": ("file", 1), "f2": ("link", 1)}
    trees = {  # base, local and remote of each root
        "x": (base, {"d": ("file", 2), "f": ("dir", 1), "f_n": ("file", 3)}, base),
        "y": (base, base, {"d": ("file", 5), "f": ("dir", 1), "f_n": ("file", 4), "f2": ("file", 1)}),
        "z": (base, {k: v for k, v in base.items() if k != "d_a"}, base | {"d_n": ("file", 9), "f_n": ("file", 3)}),
    }
    rows = lambda df: sorted(map(tuple, df.select("path", "path_str", "b", "l", "r", "decision", "conflict", "winner").collect()), key=lambda r: r[1])
    many = [tree(next(iter(trees)), **sides[i]).limit(0) for i in range(3) for sides in (next(iter(trees.values())),)]
    want = []
    for root, sides in trees.items():
        one = [tree(root, **s) for s in sides]
        many = [m.unionByName(o) for m, o in zip(many, one)]
        want += [([root, *r[0]], f"{root}/{r[1]}", *r[2:]) for r in rows(reconcile.decide(*one, "a", "b"))]
    got = rows(reconcile.decide(*many, "a", "b", "device_id"))
    assert got == sorted(want, key=lambda r: r[1]) and {r[1] for r in got} == {"x/d", "x/f", "x/f2", "y/d", "y/f", "y/f2", "z/d/a", "z/d/n", "z/f/n"}
