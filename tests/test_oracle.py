"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(x: pd.DataFrame) -> list[str]:
    x = x[sorted(x.columns)]
    plain = lambda v: None if v is None or not isinstance(v, (list, dict)) and pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return sorted(str(tuple(plain(v) for v in r)) for r in x.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["index_rebuild", "index_rebuild_refused", "pack_adoption"])
def test_packs_whose_hash_begins_like_a_bad_name(spark, tmp_path, name):
    import hashlib

    hit = [k for k in range(200_000) if hashlib.sha256(str(k).encode()).hexdigest().startswith("bad")][:3]
    c = duckdb.connect()
    c.execute(f"copy (select * replace ({hit[0]} + c_custkey * 0 as c_custkey) from '{SF}/customer.parquet' where c_mktsegment = 'FURNITURE' limit 1) to '{tmp_path}/a.parquet' (format parquet)")
    c.execute(f"copy (select * from '{tmp_path}/a.parquet' union all select * from '{SF}/customer.parquet' where c_custkey <> {hit[0]}) to '{tmp_path}/customer.parquet' (format parquet)")
    c.execute(f"copy (select * replace (case when o_orderkey % 50 = 0 then {hit[0]} else o_custkey end as o_custkey) from '{SF}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    for t in ("customer", "orders"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    assert len(got) > 0 and rows(got) == rows(want)
