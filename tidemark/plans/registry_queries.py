"""Queries over folder registries, the index as a folder, pins' patterns and composed names, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import ignore, registry
from ..session import scratch
from ..sources.index import Index
from .queries import query

#: A supplier of the first ten nations is a folder below its nation's.
RECORDS = "r as (select cast(s_suppkey as varchar) as folder_id, '/n' || s_nationkey || '/s' || s_suppkey as path, s_nationkey from supplier where s_nationkey < 10)"


def records(table):
    s = table("supplier").where("s_nationkey < 10")
    path = F.concat(F.lit("/n"), "s_nationkey", F.lit("/s"), "s_suppkey")
    return s.select(F.col("s_suppkey").cast("string").alias("folder_id"), path.alias("path"), F.lit("2026-01-01T00:00:00Z").alias("added_at"))


def wanted(table):
    """Of each nation its folder, one below it, and one that isn't absolute; even nations' own folder comes first."""
    k = F.col("n_nationkey")
    one = lambda name, path, at: F.struct(F.concat(F.lit(name), k).alias("folder_id"), path.alias("path"), at.alias("ord"))
    top = F.concat(F.lit("/n"), k)
    rows = F.array(one("top", F.concat(top, F.lit("/")), 3 * k + k % 2), one("sub", F.concat(top, F.lit("/sub")), 3 * k + 1 - k % 2), one("rel", F.concat(F.lit("rel"), k), 3 * k + 2))
    return table("nation").select(F.explode(rows).alias("w")).select("w.*").withColumn("added_at", F.lit("2026-02-01T00:00:00Z"))


#: What becomes of the wanted folders: nations that have a folder below can't be one, nor can what such a one has above.
OUTCOMES = f"""with {RECORDS}, w as (select n_nationkey as k, n_nationkey in (select s_nationkey from r) as has from nation),
o as (select 'top' || k as folder_id, '/n' || k || '/' as path, case when has or k % 2 = 1 then 'already_synced' end as error from w
  union all select 'sub' || k, '/n' || k || '/sub', case when not has and k % 2 = 0 then 'already_synced' end from w union all select 'rel' || k, 'rel' || k, 'bad_path' from w)"""


@query(OUTCOMES + " select folder_id, path from r union all select folder_id, path from o where error is null")
def folder_register(spark, table):
    return registry.register(records(table), wanted(table))[0].select("folder_id", "path")


@query(OUTCOMES + " select path, error from o where error is not null")
def folder_refused(spark, table):
    return registry.register(records(table), wanted(table))[1]


@query(
    f"""with {RECORDS}, w as (select folder_id, case when s_nationkey % 2 = 0 then path else '/moved/' || folder_id end as path from r where s_nationkey < 5
  union all select 'new' || n_nationkey, '/n' || n_nationkey from nation where n_nationkey between 7 and 8),
kept as (select folder_id, path from r where folder_id not in (select folder_id from w) and s_nationkey not between 7 and 8)
select folder_id, path from kept union all select folder_id, path from w"""
)
def folder_ensured(spark, table):
    """Some folders are where they were, some have moved, and two new ones lie above folders of others, which give way."""
    r = records(table).withColumn("k", F.regexp_extract("path", "^/n(\\d+)", 1).cast("int"))
    path = F.when(F.col("k") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/moved/"), "folder_id"))
    new = table("nation").where("n_nationkey between 7 and 8").select(F.concat(F.lit("new"), "n_nationkey").alias("folder_id"), F.concat(F.lit("/n"), "n_nationkey").alias("path"), F.lit("t").alias("added_at"))
    want = r.where("k < 5").select("folder_id", path.alias("path"), "added_at").unionByName(new)
    return registry.ensure(records(table), want).select("folder_id", "path")


@query(f"with {RECORDS}, g as (select cast(s_suppkey as varchar) as folder_id from supplier where s_suppkey % 2 = 0) select folder_id, 'kept' as outcome from r where folder_id not in (select folder_id from g) union all select folder_id, 'not_found' from g where folder_id not in (select folder_id from r)")
def folder_unregister(spark, table):
    gone = table("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("folder_id"))
    rest, missing = registry.unregister(records(table), gone)
    return rest.select("folder_id", F.lit("kept").alias("outcome")).unionByName(missing.withColumn("outcome", F.lit("not_found")))


@query(
    f"""with {RECORDS}, c as (select '/' as parent, 'n' || n_nationkey as name, n_regionkey <> 0 as is_dir from nation
  union all select '/n' || n_nationkey, case when n_nationkey % 2 = 0 then '.git' else '.store' end, true from nation)
select parent, name, is_dir, is_dir and parent = '/' and cast(substr(name, 2) as int) % 2 = 0 as is_repository, is_dir and parent = '/' and cast(substr(name, 2) as int) % 2 = 1 as initialized,
  is_dir and parent = '/' and name in (select 'n' || s_nationkey from r) as synced from (select * from c where parent = '/') union all select parent, name, is_dir, false, false, false from c where parent <> '/'"""
)
def folder_listing(spark, table):
    n = table("nation")
    tops = n.select(F.lit("/").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("name"), (F.col("n_regionkey") != 0).alias("is_dir"))
    inside = n.select(F.concat(F.lit("/n"), "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, ".git").otherwise(".store"), F.lit(True))
    return registry.listing(tops.union(inside), records(table))


#: An index part for each of three return flags, with overlapping rows.
INDEX = "i as (select 'data' as kind, cast(l_partkey as varchar) as id, cast(l_suppkey as varchar) as pack, l_linenumber as plain_off, cast(l_quantity as bigint) as plain_len, l_returnflag as flag from lineitem)"


def index_folder(spark, table) -> Index:
    rows = table("lineitem").select(F.lit("data").alias("kind"), F.col("l_partkey").cast("string").alias("id"), F.col("l_suppkey").cast("string").alias("pack"), F.col("l_linenumber").cast("bigint").alias("plain_off"), F.col("l_quantity").cast("bigint").alias("plain_len"), "l_returnflag")
    index = Index(spark, scratch(spark, "index"))
    for flag in "RAN":
        index.append(rows.where(F.col("l_returnflag") == flag))
    return index


@query(f"with {INDEX} select distinct kind, id, pack, plain_off, plain_len from i")
def index_compacted(spark, table):
    """Three parts become one."""
    index = index_folder(spark, table)
    if not index.compact(3) or len(index.parts()) != 1:
        raise AssertionError("the parts weren't compacted")
    return index.load().drop("part", "ord")


@query(f"with {INDEX} select kind, id, pack, plain_off, plain_len, 'part-0000000' || min(case flag when 'R' then 1 when 'A' then 2 else 3 end) as part from i group by all")
def index_in_order(spark, table):
    """The part in which each row stands first, by the parts' names."""
    return index_folder(spark, table).places().select("kind", "id", "pack", "plain_off", "plain_len", "ord.part")


@query("select p_partkey as pin, p_brand || '[' as pattern from part where p_partkey % 3 = 0 and p_partkey % 2 = 1")
def pin_refused(spark, table):
    """Every third pin has a class that isn't closed; even ones hold everything."""
    lines = F.array(F.lit("ok/**"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("["))).otherwise(F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, "*").otherwise("docs/"))
    return ignore.bad_pins(table("part").select(F.col("p_partkey").alias("pin"), F.explode(lines).alias("pattern")), "pin", "pattern")


@query("select p_partkey, replace(p_name, 'o', chr(246)) as composed, p_name like '%o%' as changed from part")
def names_composed(spark, table):
    """Names whose o's carry a combining mark behind them are composed to one character each."""
    given = F.regexp_replace("p_name", "o", "ö")
    return table("part").select("p_partkey", names.nfc(given).alias("composed"), (names.nfc(given) != given).alias("changed"))


_kept = ["settings.json", "memory/x", "deep/agents/y", "projects/a/memory/b"]
_gone = ["projects/a/sessions/b", "a.log", "deep/b.log", "cache/z", "telemetry/q"]


@query(f"""with x as (select p_partkey, unnest([{', '.join(repr(x) for x in (*_kept, *_gone))}]) as tail from part)
select p_partkey, tail, tail in ({', '.join(map(repr, _gone))}) as ignored from x""")
def ignore_presets(spark, table):
    """A preset keeps what it re-includes, below every part's directory or not, and drops the rest of what it excludes."""
    rows = table("part").select("p_partkey", F.explode(F.array(*map(F.lit, (*_kept, *_gone)))).alias("tail"))
    policy = ignore.Policy(ignore.preset_lines("claude"))
    return rows.withColumn("ignored", policy.ignored(F.col("tail"), F.lit(False)))
