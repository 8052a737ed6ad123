"""Folds in blocks against plain loops over rows."""

import random

import pytest

from tidemark.operators import ledger, ordered, store, transfer


def fit(sizes, target):
    out, used, number = [], 0, 0
    for n in sizes:
        if used and used + n > target:
            used, number = 0, number + 1
        used += n
        out.append(number)
    return out


def cut(sizes, most, flush):
    out, n, size, number = [], 0, 0, 0
    for x in sizes:
        out.append(number)
        n, size = n + 1, size + x
        if n >= most or size >= flush:
            n, size, number = 0, 0, number + 1
    return out


@pytest.mark.parametrize("seed,block", [(0, 1), (1, 3), (2, 7), (3, 1000)])
def test_bins_do_not_depend_on_blocks(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    r = random.Random(seed)
    sizes = {"hot": [r.choice([0, 0, 1, 2, 5, 9, 10, 11, 30]) for _ in range(70)], "a": [0, 12, 0, 0], "b": [3], None: [4, 4, 4, None], "zeros": [0] * 9 + [11, 1]}
    rows = spark.createDataFrame([(k, i, n) for k, v in sizes.items() for i, n in enumerate(v)], "pool string, i int, n bigint")
    for made, column, plain in ((transfer.next_fit(rows, "pool", ["i"], "n", 10), "bin", lambda v: fit(v, 10)), (store.item_batches(rows, "pool", ["i"], "n", 4, 15), "batch", lambda v: cut(v, 4, 15))):
        assert {(x.pool, x.i): x[column] for x in made.collect()} == {(k, i): b for k, v in sizes.items() for i, b in enumerate(plain([n or 0 for n in v]))}
    assert transfer.next_fit(rows.limit(0), "pool", ["i"], "n", 10).count() == 0


@pytest.mark.parametrize("seed,block", [(0, 1), (1, 5), (2, 1000)])
def test_activity_log_by_the_row_before(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    r = random.Random(seed)
    events = [(k, i, r.choice(["warn", "info"]), r.choice(["offline", "closed", "up", "x"])) for k in ("hot", "b") for i in range(60 if k == "hot" else 5)]
    off = lambda e: e[2] == "warn" and e[3] in ("offline", "closed")
    want, last = [], {}
    for e in events:
        was = last.get(e[0])
        if was is None or not (was[2:] == e[2:] or off(was) and off(e)):
            last[e[0]] = e
            want.append(e[:2])
    rows = spark.createDataFrame([(*e, off(e)) for e in events], "k string, i int, level string, message string, disconnect boolean")
    assert sorted((x.k, x.i) for x in ledger.activity_log(rows, "k", ["i"]).collect()) == sorted(want)
