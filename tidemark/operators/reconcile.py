"""Three-way reconciliation of two snapshots against a base that both descend from.

Both sides are diffed against the base, the changed paths are joined, and one CASE decides each. All the rest is
unions, semi joins and anti joins over the decisions. What can't be resolved is a row of ``errors``, not an exception,
so callers decide; ``Plan.check`` raises on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import packed, packed_list, unpacked
from ..functions.paths import nested_pairs, proper_ancestors
from ..session import keep
from .diff import STATE, below_changed, bucket, digest, lean, paired


def newer_is_local(l: Column, r: Column, local_device: str, remote_device: str | Column) -> Column:
    """Whether the local state has the larger time; the larger device id decides a tie, and remote a tie of those.

    The remote device may be a column, where rows are of several peers.
    """
    a, b = F.struct(l["mtime_sec"], l["mtime_nsec"]), F.struct(r["mtime_sec"], r["mtime_nsec"])
    return F.when(a == b, F.lit(local_device) > (F.lit(remote_device) if isinstance(remote_device, str) else remote_device)).otherwise(a > b)


def decide(base: DataFrame, local: DataFrame, remote: DataFrame, local_device: str, remote_device: str | Column, root: str | None = None) -> DataFrame:
    """path, path_str, b, l, r, decision (nothing, keep_local, apply_remote, conflict), conflict, winner.

    States have a digest of their chunk list instead of the list (``diff.lean``), by which they are compared. With ``root``
    the entries are of many trees, each below the directory that this column names, with which their paths here begin.
    """
    b, l, r = F.col("b"), F.col("l"), F.col("r")
    moved = lambda x: (b.isNotNull() | x.isNotNull()) & bucket(b, x).isNotNull()
    # what appears, goes or changes its type has moved: ``hidden`` is found in the same rows, whose exchange serves both
    rows = paired(STATE, root, b=lean(base), l=lean(local), r=lean(remote)).where(moved(l) | moved(r))
    rows = rows.join(below_changed(rows, (b, l), (b, r), root=root), "path_str", "left")
    hidden = lambda i: F.array_contains(F.col("hidden")[i], F.col(root)) if root else F.col("hidden")[i]
    shown = lambda x, i: moved(x) & ~F.coalesce(hidden(i), F.lit(False))
    rows = rows.withColumns({"m": shown(l, 0), "t": shown(r, 1)}).where("m or t")
    if root:
        rows = rows.withColumn("path_str", F.concat(root, F.lit("/"), "path_str"))
    # a side whose change isn't mentioned stands at the base
    views = rows.select(F.split("path_str", "/").alias("path"), "path_str", "b", F.when(F.col("m"), l).otherwise(b).alias("l"), F.when(F.col("t"), r).otherwise(b).alias("r"))
    alike = F.when(l["kind"] == "link", l["target"].eqNullSafe(r["target"])).otherwise(l["chunks"].eqNullSafe(r["chunks"]))
    local_newer = newer_is_local(l, r, local_device, remote_device)
    present = l.isNotNull() & r.isNotNull()
    silent = present & (l["kind"] == r["kind"]) & alike
    decision = (
        F.when(l.eqNullSafe(r), "nothing")
        .when(r.eqNullSafe(b), "keep_local")
        .when(l.eqNullSafe(b), "apply_remote")
        .when(silent, F.when(local_newer, "keep_local").otherwise("apply_remote"))
        .otherwise("conflict")
    )
    conflict = F.when(~present, "delete_vs_edit").when(b.isNull(), "add_vs_add").otherwise("both_changed")
    winner = F.when(r.isNull(), "local").when(l.isNull(), "remote").when(local_newer, "local").otherwise("remote")
    rows = views.withColumn("decision", decision)  # views have ``path``, of which a column of the remote device may be made
    is_conflict = F.col("decision") == "conflict"
    return rows.withColumns({"conflict": F.when(is_conflict, conflict), "winner": F.when(is_conflict, winner)})


@dataclass
class Plan:
    """decisions as from ``decide``; materialize(path, path_str, base, result; a null result deletes); quarantine(path,
    path_str, side, state); conflicts; suppressed(path_str); errors(ancestor, path_str). Their states have digests of
    chunk lists; ``whole`` brings the lists. send(id, len) and fetch(id, len) are made when they are asked for."""

    decisions: DataFrame
    materialize: DataFrame
    quarantine: DataFrame
    conflicts: DataFrame
    suppressed: DataFrame
    errors: DataFrame
    sides: tuple[DataFrame, DataFrame, DataFrame]  # base, local and remote

    @cached_property
    def send(self) -> DataFrame:
        _, local, remote = self.sides
        return chunk_rows(local, self.decisions.where("l is not null and (decision = 'keep_local' or winner = 'local')"), remote)

    @cached_property
    def fetch(self) -> DataFrame:
        _, local, remote = self.sides
        lost = "winner = 'local' and r.kind <> 'dir'"
        return chunk_rows(remote, self.decisions.where(f"r is not null and (decision = 'apply_remote' or winner = 'remote' or {lost})"), local)

    def whole(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows(path_str, ...) with the chunk lists of the states in these columns instead of their digests."""
        lists = paired(["chunks"], **{f"of_{i}": s.select("path_str", F.struct(digest(F.col("chunks")).alias("sum"), F.col("chunks").alias("list")).alias("chunks")) for i, s in enumerate(self.sides)})
        joined, out = rows.join(lists, "path_str", "left"), {}
        for c in columns:
            found = F.coalesce(*(F.when(F.col(c)["chunks"] == F.col(f"of_{i}")["chunks"]["sum"], F.col(f"of_{i}")["chunks"]["list"]) for i in range(len(self.sides))))
            out[c] = F.when(F.col(c).isNotNull(), F.struct(*((found if f == "chunks" else F.col(c)[f]).alias(f) for f in STATE)))
        return joined.withColumns(out).select(*rows.columns)

    def has_local_wins(self) -> bool:
        return not self.decisions.where("decision = 'keep_local' or winner = 'local'").isEmpty()

    def check(self) -> None:
        first = self.errors.first()
        if first:
            raise ValueError(f"structural conflict: {first['path_str']} below {first['ancestor']}")


def chunk_rows(entries: DataFrame, paths: DataFrame, had: DataFrame) -> DataFrame:
    """Distinct (id, len) of the chunks of the entries at paths(path_str) that the snapshot ``had`` doesn't refer to.

    Of several lengths of an id the last in order of path and place counts.
    """
    of = entries.where(F.size("chunks") > 0).select("path_str", packed_list(F.col("chunks")).alias("chunks")).join(paths.select("path_str"), "path_str", "left_semi")
    each = of.select("path_str", F.posexplode("chunks").alias("at", "c")).select("c.id", "c.len", "path_str", "at")
    there = had.select(F.explode("chunks").alias("c")).select(packed(F.col("c.id")).alias("id"))
    rest = each.repartition("id").join(there.repartition("id"), "id", "left_anti")
    return rest.groupBy("id").agg(F.max_by("len", F.struct(F.split("path_str", "/"), "at")).alias("len")).select(unpacked(F.col("id")).alias("id"), "len")


def references(snapshot: DataFrame) -> DataFrame:
    """Distinct chunk ids of a snapshot."""
    return snapshot.select(F.explode("chunks").alias("c")).select("c.id").distinct()


def kept_by_path(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written and read back; components of paths aren't written, as their strings say them."""
    return keep(rows.drop("path"), label, clear=True).select(F.split("path_str", "/").alias("path"), "*")


def reconcile(base: DataFrame, local: DataFrame, remote: DataFrame, local_device: str, remote_device: str | Column, root: str | None = None) -> Plan:
    """The plan of two sides; ``root`` as in ``decide``."""
    d = kept_by_path(decide(base, local, remote, local_device, remote_device, root), "decisions")  # all tables below read it
    won = F.col("winner")
    writes = d.where((F.col("decision") == "apply_remote") | (won == "remote")).select("path", "path_str", F.col("b").alias("base"), F.col("r").alias("result"))
    conflicts = d.where("decision = 'conflict'")
    loser = F.when(won == "local", F.col("r")).otherwise(F.col("l"))
    lost = conflicts.select("path", "path_str", F.when(won == "local", "remote").otherwise("local").alias("side"), loser.alias("state")).where("state is not null")
    quarantine = lost.where("state.kind <> 'dir'")
    dir_losers = lost.where("state.kind = 'dir'").select(F.col("path_str").alias("ancestor"), "path_str")

    kept_local = d.where("decision = 'keep_local' and l is not null")

    # a directory stays while anything below it survives
    survivors = quarantine.select("path").union(d.where("winner = 'local'").select("path")).union(kept_local.select("path"))
    above = survivors.select(F.explode(proper_ancestors(F.col("path"))).alias("path_str")).distinct()
    removals, written = writes.where("result is null"), writes.where("result is not null")
    suppressed = removals.join(above, "path_str", "left_semi").select("path_str")

    # what is written needs directories above it: a deleted one comes back, anything else is an error
    final = F.when((F.col("decision") == "keep_local") | (won == "local"), F.col("l")).otherwise(F.col("r"))
    stays = d.where("decision <> 'nothing'").select(F.col("path_str").alias("up"), F.col("b.kind").alias("was"), final["kind"].alias("is")).where("is is null or is <> 'dir'")
    targets = d.where((F.col("decision").eqNullSafe("apply_remote") | won.eqNullSafe("remote")) & F.col("r").isNotNull() | (F.col("decision") == "conflict") & loser.isNotNull() & (loser["kind"] != "dir"))
    over = targets.select("path_str", F.explode(proper_ancestors(F.col("path"))).alias("up")).join(stays, "up").join(suppressed.select(F.col("path_str").alias("up")), "up", "left_anti")
    returns = F.col("is").isNull() & F.coalesce(F.col("was") == "dir", F.lit(False))
    errors = over.where(~returns).select(F.col("up").alias("ancestor"), "path_str")
    dirs = d.where("decision <> 'nothing' and b.kind = 'dir'").where(final.isNull())
    back = dirs.join(over.where(returns).select(F.col("up").alias("path_str")), "path_str", "left_semi").select("path", "path_str", F.lit(None).cast(dict(writes.dtypes)["base"]).alias("base"), F.col("b").alias("result"))
    materialize = written.unionByName(removals.join(suppressed, "path_str", "left_anti")).unionByName(back)
    sides = tuple(below(s, F.col(root)).drop(root) if root else s for s in (base, local, remote))
    return Plan(d, kept_by_path(materialize, "materialize"), quarantine, conflicts, suppressed, errors.union(dir_losers), sides)


def below(entries: DataFrame, root: Column) -> DataFrame:
    """Entries of a tree below a directory of this name."""
    return entries.withColumns({"path": F.concat(F.array(root), F.col("path")), "path_str": F.concat(root, F.lit("/"), F.col("path_str"))})


def conflict_name(name: Column, device: str, mtime_sec: Column, marker: str = ".conflict.") -> Column:
    """The name under which a loser is kept: its name, the marker, eight digits of its device and its time."""
    stamp = F.date_format(F.timestamp_seconds(mtime_sec), "yyyyMMdd-HHmmss")
    return F.concat(name, F.lit(marker + device[:8] + "-"), stamp)


def gate(plan: Plan, held: Column) -> tuple[Plan, DataFrame, DataFrame]:
    """What may be applied now, what is held, and pairs of held and free paths that nest (which must be none).

    ``held`` is a predicate over path_str and path. Sent and fetched chunks and local wins are those of the whole plan.
    """
    rows = plan.materialize.select("path_str", F.lit("m").alias("of"), F.col("result").alias("state"), F.lit(None).cast("string").alias("winner"), "path")
    rows = rows.union(plan.quarantine.select("path_str", F.lit("q"), F.when(F.col("side") == "remote", F.col("state")), F.lit(None).cast("string"), "path"))
    rows = rows.union(plan.conflicts.select("path_str", F.lit("c"), F.lit(None).cast(dict(rows.dtypes)["state"]), "winner", "path"))
    flagged = rows.withColumn("held", held)
    of = lambda k: F.max(F.col("of") == k)
    one = flagged.where("held").groupBy("path_str").agg(of("c").alias("c"), of("m").alias("m"), F.first(F.when(F.col("of") == "c", F.col("winner")), True).alias("winner"), F.first(F.when(F.col("of") == "m", F.col("state")), True).alias("result"), F.first(F.when(F.col("of") == "q", F.col("state")), True).alias("loser"))
    decision = F.when(F.col("c"), "conflict").when(F.col("m") & F.col("result").isNotNull(), "remote_apply").when(F.col("m"), "remote_delete").otherwise("conflict")
    lists = plan.sides[2].where(held).select("path_str", "chunks")  # what is applied or kept of a loser is the remote side's
    has = F.col("result.chunks").isNotNull() | F.col("loser.chunks").isNotNull()
    chunks = F.coalesce(F.when(has, F.col("chunks")), F.array().cast("array<struct<id:string,len:bigint>>"))
    held_rows = one.join(lists, "path_str", "left").select("path_str", decision.alias("decision"), "winner", chunks.alias("chunks"))
    split = nested_pairs(flagged.where("held").select("path_str").distinct(), flagged.where("not held").select("path_str").distinct())
    free = Plan(plan.decisions, plan.materialize.where(~held), plan.quarantine.where(~held), plan.conflicts.where(~held), plan.suppressed, plan.errors, plan.sides)
    return free, held_rows, split


def agreed(plan: Plan, held: DataFrame) -> bool:
    """Whether both sides may record an agreement: nothing in conflict, held or to send, and no local win."""
    return plan.conflicts.isEmpty() and held.isEmpty() and not plan.has_local_wins()  # what is sent is of local wins


def standing(plan: Plan, held: DataFrame, sent: bool = True) -> DataFrame:
    """One row: conflicts, held, to_send, local_wins, agrees; both sides agree if all are zero.

    All that is sent is of local wins, so ``sent=False`` leaves to_send out, whose chunks are most of the work.
    """
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    tables = {"conflicts": plan.conflicts, "held": held, **({"to_send": plan.send} if sent else {}), "local_wins": plan.decisions.where("decision = 'keep_local' or winner = 'local'")}
    rows = None
    for name, df in tables.items():
        rows = one(df, name) if rows is None else rows.union(one(df, name))
    wide = rows.agg(*(F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in tables))
    return wide.withColumn("agrees", F.expr("conflicts + held + local_wins = 0"))


def fold(plan: Plan) -> DataFrame:
    """The plan's writes as a change set: path_str, bucket."""
    base, result = F.col("base"), F.col("result")
    return plan.materialize.select("path_str", F.when(result.isNull() & base.isNull(), None).otherwise(F.coalesce(bucket(base, result), F.lit("metadata_modified"))).alias("bucket")).where("bucket is not null")
