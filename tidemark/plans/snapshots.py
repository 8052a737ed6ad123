"""Three versions of a tree of entries, derived from the star-schema tables.

Every order is a file below its customer's directory, its line items are the file's chunks. The versions differ by
the orders' own columns: which of them exist, which line items they hold, and their times and flags.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSIONS = {
    "base": {"absent": "1-URGENT", "drop": "false", "time": "0", "exec": "o_totalprice > 100000", "link": "false", "flat": "false"},
    "local": {"absent": "2-HIGH", "drop": "o_orderstatus = 'F' and l_returnflag = 'R'", "time": "case when o_orderstatus = 'F' then 1800 else 0 end", "exec": "o_totalprice > 100000", "link": "o_orderstatus = 'P' and o_totalprice > 200000", "flat": "c_mktsegment = 'MACHINERY' and c_acctbal < 0"},
    "remote": {"absent": "3-MEDIUM", "drop": "o_orderpriority = '5-LOW' and l_linestatus = 'O'", "time": "case when o_orderpriority = '5-LOW' then case when o_totalprice > 150000 then 3600 else 1800 end else 0 end", "exec": "o_totalprice > 150000", "link": "false", "flat": "false"},
}
LOCAL_DEVICE, REMOTE_DEVICE = "a1" * 32, "b2" * 32


def with_lines(table) -> DataFrame:
    """Orders with what the versions ask of their customer, and with their line items: what all versions are made of.

    Line items go to their orders once, as numbers; ids of chunks are made where a version is read.
    """
    line = ["l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("len"), "l_returnflag", "l_linestatus"]
    lines = table("lineitem").select("l_orderkey", *line).repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*(c for c in lines.columns if c != "l_orderkey"))).alias("lines"))
    flat = F.coalesce(F.expr(VERSIONS["local"]["flat"]), F.lit(False)).alias("flat")
    customers = table("customer").select(F.col("c_custkey").alias("o_custkey"), flat).where("flat")
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    # customers come first, so that orders go to them without their lines
    orders = orders.join(customers, "o_custkey", "left").withColumn("flat", F.coalesce("flat", F.lit(False)))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def snapshot(stored: DataFrame, version: str) -> DataFrame:
    """The entries of one version; ``stored`` are orders with their lines."""
    v = VERSIONS[version]
    orders = stored.where(F.col("o_orderpriority") != v["absent"])
    flat = F.col("flat") if v["flat"] != "false" else F.lit(False)
    mtime = F.col("mtime")
    none = F.array().cast("array<struct<id:string,len:bigint>>")
    held = F.expr(f"filter(lines, l -> not ({re.sub('l_(?=return|line)', 'l.l_', v['drop'])}))")
    chunk = lambda l: F.struct(l["l_linenumber"].alias("n"), F.sha2(F.concat_ws("/", l["l_partkey"], l["l_suppkey"]), 256).alias("id"), l["len"].alias("len"))
    chunks = F.transform(F.sort_array(F.transform(held, chunk)), lambda x: F.struct(x["id"].alias("id"), x["len"].alias("len")))
    is_link = F.expr(v["link"])
    entries = orders.where(~flat).select(
        F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")).alias("path"),
        F.when(is_link, "link").otherwise("file").alias("kind"),
        (F.expr(v["exec"]) & ~is_link).alias("exec"),
        (mtime + F.expr(v["time"])).cast("bigint").alias("mtime_sec"),
        (F.col("o_orderkey") % 1000).cast("int").alias("mtime_nsec"),
        F.when(is_link, none).otherwise(F.coalesce(chunks, none)).alias("chunks"),
        F.when(is_link, F.concat(F.lit("../c"), "o_custkey")).alias("target"),
    )
    per = orders.groupBy("o_custkey").agg(F.max(mtime).alias("mtime_sec"), F.max(flat).alias("flat"))
    tops = per.select(F.array(F.concat(F.lit("c"), "o_custkey")).alias("path"), F.when(F.col("flat"), "file").otherwise("dir").alias("kind"), F.lit(False).alias("exec"), F.col("mtime_sec").cast("bigint").alias("mtime_sec"), F.lit(0).alias("mtime_nsec"), none.alias("chunks"), F.lit(None).cast("string").alias("target"))
    return entries.unionByName(tops).withColumn("path_str", F.array_join("path", "/"))


def chunk_text(chunks) -> F.Column:
    return F.array_join(F.transform(chunks, lambda c: F.concat(c["id"], F.lit(":"), c["len"].cast("string"))), ",")


def snapshot_sql(version: str) -> str:
    """The same entries for the oracle: path_str, kind, exec, mtime_sec, mtime_nsec, chunks (as text), target."""
    v = VERSIONS[version]
    one = "sha256(l_partkey || '/' || l_suppkey)"
    return f"""select 'c' || o_custkey || '/o' || o_orderkey as path_str, case when {v['link']} then 'link' else 'file' end as kind,
    ({v['exec']}) and not ({v['link']}) as exec, cast(epoch(o_orderdate) as bigint) + {v['time']} as mtime_sec, cast(o_orderkey % 1000 as int) as mtime_nsec,
    case when {v['link']} then '' else coalesce(held, '') end as chunks, case when {v['link']} then '../c' || o_custkey end as target
  from orders left join customer on o_custkey = c_custkey
    left join (select l_orderkey, string_agg({one} || ':' || cast(l_quantity as bigint), ',' order by l_linenumber, {one}, cast(l_quantity as bigint)) as held
      from lineitem join orders on o_orderkey = l_orderkey where not ({v['drop']}) group by l_orderkey) h on h.l_orderkey = o_orderkey
  where o_orderpriority <> '{v['absent']}' and not coalesce({v['flat']}, false)
  union all
  select 'c' || o_custkey, case when bool_or(coalesce({v['flat']}, false)) then 'file' else 'dir' end, false, cast(max(epoch(o_orderdate)) as bigint), 0, '', null
  from orders left join customer on o_custkey = c_custkey where o_orderpriority <> '{v['absent']}' group by o_custkey"""


#: Common table expressions of the three versions and of what each side changed.
SQL = (
    "with "
    + ",\n".join(f"{v} as ({snapshot_sql(v)})" for v in VERSIONS)
    + "".join(
        f""",
{name}_all as (select coalesce(a.path_str, b.path_str) as path_str, a is null as fresh, b is null as gone, a, b,
    case when a.path_str is null then 'added' when b.path_str is null then 'removed' when a.kind <> b.kind then 'type_changed'
      when a.kind = 'file' then case when a.chunks <> b.chunks then 'content_modified' when a.exec <> b.exec or a.mtime_sec <> b.mtime_sec or a.mtime_nsec <> b.mtime_nsec then 'metadata_modified' end
      when a.kind = 'link' then case when a.target <> b.target then 'content_modified' when a.mtime_sec <> b.mtime_sec or a.mtime_nsec <> b.mtime_nsec then 'metadata_modified' end end as bucket
  from {x} a full join {y} b on a.path_str = b.path_str),
{name} as (select * from {name}_all d where bucket is not null and not (bucket in ('added', 'removed') and exists (select 1 from {name}_all t where t.bucket = 'type_changed' and contains(d.path_str, '/') and t.path_str = split_part(d.path_str, '/', 1))))"""
        for name, x, y in (("d_local", "base", "local"), ("d_remote", "base", "remote"), ("d_sides", "local", "remote"))
    )
)
