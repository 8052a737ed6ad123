"""Queries of whole syncs and releases over a variant of the three versions that has no structural conflict, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settle as st
from ..operators.diff import lean
from ..operators.reconcile import conflict_name
from . import snapshots as sn
from .queries import DECIDED, _mismatch, query, versions

FLAT = "c_mktsegment = 'MACHINERY' and c_acctbal < 0"
#: The decisions without customers whose directory is a file on one side.
SYNC = DECIDED.replace("from orders left join", f"from (select * from orders where o_custkey not in (select c_custkey from customer where {FLAT})) orders left join")
FOLDER, NOW = "f0" * 16, (1_787_574_896, 5)
MINE, THEIRS = st.Side(sn.LOCAL_DEVICE, "m1" * 32), st.Side(sn.REMOTE_DEVICE, "m2" * 32)


def sides(table):
    return tuple(sn.snapshot(table.with_lines().where("not flat"), v) for v in sn.VERSIONS)


def settled(table, **more) -> st.Settled:
    return st.settle(*sides(table), MINE, THEIRS, FOLDER, NOW, **more)


#: Where a loser is kept, if nothing has that name.
COPY = f"""q as (select path_str, state, path_str || '.conflict.' || case when side = 'local' then '{sn.LOCAL_DEVICE[:8]}' else '{sn.REMOTE_DEVICE[:8]}' end
    || '-' || strftime(make_timestamp(state.mtime_sec * 1000000), '%Y%m%d-%H%M%S') as copy from quarantine)"""


@query(
    SYNC
    + f""", {COPY} select d.path_str as path, conflict as kind, case when winner = 'local' then '{sn.LOCAL_DEVICE}' else '{sn.REMOTE_DEVICE}' end as winner,
  case when winner = 'local' then l.mtime_sec else r.mtime_sec end as winner_sec, case when winner = 'local' then r.mtime_sec else l.mtime_sec end as loser_sec,
  case when cast(regexp_extract(d.path_str, '[0-9]+$') as bigint) % 3 = 0 then copy || '-2' else copy end as quarantined_as
from decided d left join q on q.path_str = d.path_str where decision = 'conflict'"""
)
def settle_conflicts(spark, table):
    """Losers of every third order find the name of their copy taken in the live tree."""
    _, local, remote = sides(table)
    third = F.expr("try_cast(substring(get(path, 1), 2) as bigint) % 3 = 0")
    taken = lambda df, device: df.where(third).withColumn("path", F.array(F.col("path")[0], conflict_name(F.get("path", F.lit(1)), device, F.col("mtime_sec"))))
    there = taken(local, sn.LOCAL_DEVICE).unionByName(taken(remote, sn.REMOTE_DEVICE)).withColumn("path_str", F.array_join("path", "/"))
    rows = settled(table, live=local.unionByName(there)).conflicts
    return rows.select("path", "kind", F.col("winner.device").alias("winner"), F.col("winner.mtime_sec").alias("winner_sec"), F.col("loser.mtime_sec").alias("loser_sec"), "quarantined_as")


@query(
    SYNC
    + f""", desired as (select path_str, result from writes where result.kind is not null union all select b.path_str, d.b from back b join decided d on d.path_str = b.path_str),
each as (select e.path_str, case when v.path_str is null or ({_mismatch('e.result', 'v')}) is not null then 'write'
    when e.result.mtime_sec = v.mtime_sec and e.result.mtime_nsec = v.mtime_nsec then 'skip' else 'touch' end as action, e.result.kind = 'dir' as is_dir
  from desired e left join local v on v.path_str = e.path_str),
todo as (select path_str, 'remove' as action, 0 as phase from writes where result.kind is null and base.kind is not null
  union all select path_str, 'write', 1 from each where action = 'write' union all select path_str, 'touch', 2 from each where action = 'touch' or action = 'write' and is_dir)
select path_str, action, row_number() over (order by phase, case when phase <> 1 then string_split(path_str, '/') end desc, case when phase = 1 then string_split(path_str, '/') end) - 1 as position from todo"""
)
def settle_steps(spark, table):
    return settled(table).steps


PIN = "ends_with(split_part(path_str, '/', 1), '7')"


@query(
    SYNC
    + f""", rows as (select path_str, 'm' as of, result as state, cast(null as varchar) as winner from writes union all select b.path_str, 'm', d.b, null from back b join decided d on d.path_str = b.path_str
  union all select path_str, 'q', case when side = 'remote' then state end, null from quarantine union all select path_str, 'c', null, winner from decided where decision = 'conflict'),
one as (select path_str, bool_or(of = 'c') as c, bool_or(of = 'm') as m, max(winner) as winner, max(case when of = 'm' then state.kind end) as kind,
    max(case when of = 'm' then state.chunks end) as result, max(case when of = 'q' then state.chunks end) as loser from rows where {PIN} group by path_str)
select path_str as path, case when c then 'conflict' when m and kind is not null then 'remote_apply' when m then 'remote_delete' else 'conflict' end as decision, winner as conflict_winner,
  coalesce(result, loser, '') as chunks from one"""
)
def settle_held(spark, table):
    """A pin on the customers whose number ends in 7."""
    held = settled(table, held=F.endswith(F.col("path")[0], F.lit("7"))).held
    return held.select("path", "decision", "conflict_winner", sn.chunk_text(F.col("chunks")).alias("chunks"))


@query(
    SYNC
    + """ select 'apart' as pair, (select count(*) from decided where decision = 'conflict') as conflicts, cast(0 as bigint) as held,
  (select count(*) from decided where decision = 'keep_local' or winner = 'local') as local_wins, false as agrees, cast(0 as bigint) as recorded
union all select 'behind', 0, 0, 0, true, 1"""
)
def settle_agreements(spark, table):
    """The two sides that changed, and a side that changed nothing with one that did: the second pair may agree."""
    base, _, remote = sides(table)
    out = None
    for name, s in (("apart", settled(table)), ("behind", st.settle(base, base, remote, MINE, THEIRS, FOLDER, NOW))):
        recorded = s.agreement.agg(F.count("*").alias("recorded"))
        told = s.tally.withColumn("recorded", F.lit(0).cast("bigint")).unionByName(recorded, allowMissingColumns=True)
        row = told.agg(*(F.sum(c).alias(c) for c in ("conflicts", "held", "local_wins")), F.bool_or("agrees").alias("agrees"), F.sum("recorded").alias("recorded")).withColumn("pair", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("pair", "conflicts", "held", "local_wins", "agrees", "recorded")


def _released(sql: str, device: str, held: int) -> str:
    return f"""select * from ({sql} select '{device}' as device_id, cast({held} as bigint) as held_entries, cast(2 as bigint) as held_paths,
  (select count(*) from materialize where base_kind is not null or result_kind is not null) as ops_applied, (select count(*) from quarantine) as quarantined,
  (select count(*) from decided where decision = 'conflict') as conflicts_recorded)"""


SMALL = "0a" * 32


@query(
    _released(SYNC, sn.REMOTE_DEVICE, 3)
    + " union all "
    + _released(SYNC.replace("else false end as newer", "else true end as newer"), SMALL, 2)
    + f" union all select '{'c3' * 32}', 2, 2, 0, 0, 0"
)
def release_many(spark, table):
    """A peer that changed much, one with the same changes whose device yields in ties, one that changed nothing, one without held entries."""
    base, local, remote = sides(table)
    of = lambda df, *devices: lean(df).withColumn("device_id", F.explode(F.array(*map(F.lit, devices))))
    bases = of(base, sn.REMOTE_DEVICE, SMALL, "c3" * 32, "d4" * 32)
    remotes = of(remote, sn.REMOTE_DEVICE, SMALL, "d4" * 32).unionByName(of(base, "c3" * 32))
    pairs = [(sn.REMOTE_DEVICE, "a"), (sn.REMOTE_DEVICE, "a"), (sn.REMOTE_DEVICE, "b"), *((d, p) for d in (SMALL, "c3" * 32) for p in "ab")]
    held = spark.createDataFrame(pairs, "device_id string, path string")
    return st.release_all(local, bases, remotes, held, sn.LOCAL_DEVICE)[0]
