"""Queries over shared tree nodes, upkeep of their ids, and chunks of files in parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranges import part_chunks
from ..operators import diff as d
from ..operators import regions, store, trees
from ..session import scratch
from ..sources import packs
from . import snapshots as sn
from .host_queries import BLOBS, blobs
from .queries import POLYNOMIAL, query, reread, versions


@query()
def ranged_chunks(spark, table):
    """A file of every hundred documents, whose parts are the documents, each with its digest behind it."""
    docs = table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    data = F.concat("text", F.lit("\n"), F.sha2("text", 256)).cast("binary")
    parts = docs.select(F.floor(F.col("doc_id") / 100).cast("string").alias("path"), "doc_id", data.alias("data"))
    before = Window.partitionBy("path").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)  # a hundred rows
    placed = parts.withColumn("off", F.coalesce(F.sum(F.length("data")).over(before), F.lit(0)).cast("bigint"))
    return part_chunks(placed.select("path", "off", "data"), POLYNOMIAL, 2048, 32768, 12)


@query(sn.SQL + " select path_str, kind, exec, mtime_sec, mtime_nsec, chunks, target from local")
def tree_round_trip(spark, table):
    root, nodes = trees.fold(versions(table, "local")[0])
    out = trees.unfold(nodes, root)
    return out.select("path_str", "kind", "exec", "mtime_sec", "mtime_nsec", sn.chunk_text(F.col("chunks")).alias("chunks"), "target")


def both_roots(table):
    base, local = map(d.lean, versions(table, "base", "local"))
    (older, a), (newer, b) = trees.fold(base), trees.fold(local)
    return a.unionByName(b), older, newer


@query(sn.SQL + " select path_str, bucket from d_local")
def tree_descent(spark, table):
    return trees.descend(*both_roots(table))[0].select("path_str", "bucket")


#: Directories of both versions, with all that is below as a text.
DIRS = """,
below as (select v, split_part(path_str, '/', 1) as dir, string_agg(concat_ws('|', path_str, kind, exec, mtime_sec, mtime_nsec, chunks, target), ';' order by path_str) as all_below
  from (select 'older' as v, * from base union all select 'newer', * from local) where contains(path_str, '/') group by 1, 2),
dirs as (select v, path_str, mtime_sec from (select 'older' as v, * from base union all select 'newer', * from local) where kind = 'dir' and not contains(path_str, '/')),
other as (select v, path_str from (select 'older' as v, * from base union all select 'newer', * from local) where kind <> 'dir' and not contains(path_str, '/')),
pairs as (select o.path_str, o.v, b.all_below, p.all_below as across, p.dir is null as alone from dirs o
  left join below b on b.dir = o.path_str and b.v = o.v left join below p on p.dir = o.path_str and p.v <> o.v
  where not exists (select 1 from other x where x.path_str = o.path_str and x.v <> o.v))"""


@query(
    sn.SQL
    + DIRS
    + """ select cast(0 as int) as depth, v as side, cast(1 as bigint) as n from (values ('older'), ('newer')) s(v)
union all select cast(1 as int), v, count(*) from pairs where all_below is distinct from across group by v"""
)
def tree_nodes_read(spark, table):
    return trees.descend(*both_roots(table))[1]


def kept_up(table):
    """Ids of base kept up with what local changed: all ids, those hashed anew, and those of base."""
    base, local = map(d.lean, versions(table, "base", "local"))
    cache = trees.tree_ids(base)
    dirty = d.diff(base, local).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    return (*trees.rebuilt(local, cache, dirty), cache)


@query(
    sn.SQL
    + DIRS
    + """, parents as (select distinct case when contains(path_str, '/') then split_part(path_str, '/', 1) else '' end as dir from d_local
  union select '' union select path_str from dirs where v = 'newer' and path_str not in (select path_str from dirs where v = 'older'))
select dir as path_str, case when dir = '' then true else p.all_below is distinct from p.across end as changed from parents left join pairs p on p.path_str = dir and p.v = 'newer'
where dir = '' or dir in (select path_str from dirs where v = 'newer')"""
)
def tree_upkeep(spark, table):
    _, anew, cache = kept_up(table)
    was = cache.withColumnRenamed("tree_id", "was")
    return anew.join(was, "path_str", "left").select("path_str", (~F.col("tree_id").eqNullSafe(F.col("was"))).alias("changed"))


@query(
    sn.SQL
    + """, now as (select count(*) filter (kind = 'file') as files, count(*) filter (kind = 'dir') as dirs, count(*) filter (kind = 'link') as links from local),
read as (select unnest(string_split(b.chunks, ',')) as c from d_local where bucket <> 'removed' and b.kind = 'file'),
n as (select count(*) as files_rehashed from d_local where bucket <> 'removed' and b.kind = 'file'),
parents as (select distinct case when contains(path_str, '/') then split_part(path_str, '/', 1) else '' end as dir from d_local
  union select '' union select path_str from local where kind = 'dir' and path_str not in (select path_str from base where kind = 'dir'))
select files, dirs, links, cast((select coalesce(sum(try_cast(split_part(c, ':', 2) as bigint)), 0) from read) as bigint) as bytes_chunked, files_rehashed,
  (select count(*) from parents where dir = '' or dir in (select path_str from local where kind = 'dir')) as dirty_dirs from now, n"""
)
def scan_pass(spark, table):
    base, local = versions(table, "base", "local")
    return store.scan_counts(local, reread(base, local), kept_up(table)[1])


@query(
    f"""with {BLOBS} select id, case when pr in ('1-URGENT', '5-LOW') then 'q' || o_custkey // 20 when pr = '3-MEDIUM' then 'p' || o_custkey // 20 end as pack,
  case when pr in ('1-URGENT', '5-LOW', '4-NOT SPECIFIED') then body end as body, case pr when '2-HIGH' then 'hash_mismatch' when '3-MEDIUM' then 'disagreement' end as error from b"""
)
def blob_get_rounds(spark, table):
    """Urgent orders' first pack is missing, low ones' is damaged there, high ones' everywhere; medium ones' index is wrong; the others are staged."""
    b, folder = blobs(table).withColumn("group", F.floor(F.col("o_custkey") / 20).cast("string")), scratch(spark, "packs")
    bad = lambda *kinds: F.when(F.col("pr").isin(*kinds), F.concat(F.lit(b"!"), "body")).otherwise(F.col("body"))
    kept = b.where("pr <> '4-NOT SPECIFIED'")
    first = kept.where("pr <> '1-URGENT'").select(F.concat(F.lit("p"), "group").alias("pack"), "id", bad("2-HIGH", "5-LOW").alias("body"))
    second = kept.select(F.concat(F.lit("q"), "group").alias("pack"), "id", bad("2-HIGH").alias("body"))
    index = packs.write(first.union(second), folder).withColumn("ord", F.when(F.startswith("pack", F.lit("p")), 0).otherwise(1))
    moved = kept.where("pr = '3-MEDIUM'").select("id", F.lit(1).alias("by"))
    index = index.join(moved, "id", "left").withColumn("plain_off", F.col("plain_off") + F.when(F.col("ord") == 0, F.coalesce("by", F.lit(0))).otherwise(0)).drop("by")
    gone = kept.where("pr = '1-URGENT'").select("id", F.concat(F.lit("gone"), "group").alias("pack"), F.lit(0).cast("bigint").alias("plain_off"), F.lit(1).cast("bigint").alias("plain_len"), F.lit(0).alias("ord"))
    out = packs.get(b.select("id"), index.unionByName(gone), folder, b.where("pr = '4-NOT SPECIFIED'").select("id", "body"))
    return out.withColumn("body", F.col("body").cast("string"))


@query("""with d as (select doc_id, octet_length(encode(coalesce(text, ''))) as n from documents)
select doc_id, cast(case when n > 0 and doc_id % 3 = 1 then doc_id % n // 100 when n > 0 and doc_id % 3 = 2 then n // 2 // 100 end as int) as mismatch from d""")
def region_mismatch(spark, table):
    """Regions of a hundred bytes; every third document has another byte somewhere, every third is cut in the middle."""
    docs = table("documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("was"))
    n = F.length("was")
    body = lambda i: F.substring("was", (i * 100 + 1).cast("int"), F.lit(100))
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 100)), lambda i: F.struct(F.sha2(body(i), 256).alias("id"), F.length(body(i)).cast("bigint").alias("len"))))
    at, none = (F.col("doc_id") % F.greatest(n, F.lit(1))).cast("int"), F.array().cast("array<struct<id:string,len:bigint>>")
    other = F.concat(F.substring("was", F.lit(1), at), F.lit(b"\x00"), F.substring("was", at + 2, n))
    live = F.when(F.col("doc_id") % 3 == 1, other).when(F.col("doc_id") % 3 == 2, F.substring("was", F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.col("was"))
    return docs.select("doc_id", regions.first_mismatch(live, F.coalesce(listed, none)).alias("mismatch"))
