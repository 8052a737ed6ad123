"""Converging two sides as one call."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import converge, ledger

ENTRY = "path_str string, kind string, exec boolean, mtime_sec bigint, mtime_nsec int, chunks array<struct<id:string,len:bigint>>, target string"


@pytest.fixture(scope="module")
def tree(spark):
    def make(**files):
        rows = [("d", "dir", False, 1, 0, [], None)] + [(n.replace("__", "/"), "file", False, t, 0, [(c, 5)], None) for n, (c, t) in files.items()]
        return spark.createDataFrame(rows, ENTRY).withColumn("path", F.split("path_str", "/"))

    return make


def test_converge(spark, tree):
    base = tree(d__a=("x", 1), d__b=("y", 1), c=("z", 1))
    local, remote = tree(d__a=("x", 1), d__b=("y2", 5), c=("z", 1)), tree(d__a=("x9", 7), d__b=("y", 1))
    out = converge.converge(base, local, remote, "a1" * 32, "b2" * 32, live=tree(d__a=("odd", 3), d__b=("y2", 5), c=("z", 1)))
    assert [(r.path_str, r.action) for r in out.mutations.orderBy("position").collect()] == [("c", "remove"), ("d/a", "upsert")]
    assert out.held_paths == 0 and out.diverged and not out.agrees and not out.is_noop()
    assert {tuple(r) for r in out.divergences.collect()} == {("d/a", "content_mismatch")}
    held = converge.converge(base, local, remote, "a1" * 32, "b2" * 32, held=F.col("path_str") == "c")
    assert [r.path_str for r in held.mutations.collect()] == ["d/a"] and [r.decision for r in held.held.collect()] == ["remote_delete"]
    same = converge.converge(base, base, base, "a1" * 32, "b2" * 32)
    assert same.is_noop() and same.agrees and not same.diverged


def test_unproven_base_is_empty(spark, tree):
    base = tree(c=("z", 1))
    line = spark.createDataFrame([("m", None), ("l", "m"), ("r", "m"), ("o", None)], "id string, parent_manifest_id string")
    assert converge.base_of(base, line, "m", "l", "r").count() == 2 and converge.base_of(base, line, "o", "l", "r").count() == 0
    assert converge.base_of(base, None, None, None, None).count() == 2


def test_registry(spark):
    have, more = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "new"), (3, "c")]))
    assert sorted(map(tuple, ledger.ensured(have, more, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, ledger.forgotten(have, more, ["id"]).collect())) == [(1, "a")]
