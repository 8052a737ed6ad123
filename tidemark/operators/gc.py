"""Reachability and garbage collection over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, keep


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (kind, id) reachable from roots(kind, id) over edges(parent, kind, id), roots included.

    Level by level: each round joins only what the last one found. Every level is a written table, so lineage stays
    short whatever the depth; shared subtrees are met once. Edges are written once, so a level reads them, not what they
    were made of.
    """
    edges = keep(edges.select("parent", "kind", "id"), "edges")
    seen = keep(roots.select("kind", "id").distinct(), "level")
    levels = [seen]
    frontier = seen
    while True:
        found = frontier.select(F.col("id").alias("parent")).distinct().join(edges, "parent").select("kind", "id").distinct()
        frontier = keep(found.join(seen, ["kind", "id"], "left_anti"), "level")
        if frontier.isEmpty():
            drop(frontier, edges)
            return seen
        levels.append(frontier)
        seen = seen.union(frontier)


def lineage(manifests: DataFrame, of: DataFrame, limit: int = 256) -> DataFrame:
    """(start, id, depth): the manifests from which each of of(id) descends, itself at depth 0, over at most ``limit`` parents.

    By pointer doubling: with steps of 1, 2, 4, ... parents what is known grows to twice the depth each round.
    """
    ids = manifests.select("id").distinct()
    jump = keep(manifests.where("parent_manifest_id is not null").select("id", F.col("parent_manifest_id").alias("up")).join(ids.withColumnRenamed("id", "up"), "up", "left_semi"), "jump")
    out, step = keep(of.select(F.col("id").alias("start"), "id").join(ids, "id", "left_semi").select("start", "id", F.lit(0).alias("depth")), "lineage"), 1
    while step <= limit:
        further = out.join(jump, "id").select("start", F.col("up").alias("id"), (F.col("depth") + step).alias("depth")).where(F.col("depth") <= limit)
        wider = keep(out.union(further), "lineage")
        twice = keep(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")), "jump")
        drop(out, jump)
        out, jump, step = wider, twice, 2 * step
        if jump.isEmpty():
            break
    return out


def safe_base(local_lines: DataFrame, remote_lines: DataFrame, base_id: str) -> bool:
    """Whether the base is an ancestor of both sides (rows of ``lineage``); else the base is empty."""
    is_base = F.col("id") == base_id
    return not local_lines.where(is_base).isEmpty() and not remote_lines.where(is_base).isEmpty()


def proven(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """wanted(local_id, remote_id, base_id) with ``proven``: whether the base is an ancestor of both by rows of ``lineage``."""
    of = lambda side: wanted.join(lines.select(F.col("start").alias(side), F.col("id").alias("base_id")), [side, "base_id"], "left_semi").select(*wanted.columns)
    both = of("local_id").intersect(of("remote_id")).withColumn("proven", F.lit(True))
    return wanted.join(both, wanted.columns, "left").withColumn("proven", F.coalesce("proven", F.lit(False)))


def gc_roots(agreed: DataFrame, held: DataFrame) -> DataFrame:
    """Manifests that agreements and held entries name: distinct manifest ids as (kind, id)."""
    return agreed.select("manifest_id").union(held.select(F.col("remote_manifest_id"))).distinct().select(F.lit("manifest").alias("kind"), F.col("manifest_id").alias("id"))


def pack_states(packs: DataFrame, footer: DataFrame, reachable: DataFrame) -> DataFrame:
    """packs(pack, bytes, corrupt) with state: corrupt, live (a blob is reachable, or it holds a polynomial) or garbage."""
    live = footer.join(reachable, ["kind", "id"], "left_semi").select("pack").union(footer.where("kind = 'polynomial'").select("pack")).distinct().withColumn("live", F.lit(True))
    return packs.join(live, "pack", "left").select("pack", "bytes", F.when(F.col("corrupt"), "corrupt").when(F.col("live"), "live").otherwise("garbage").alias("state"))


def gc_report(states: DataFrame) -> DataFrame:
    """One row: scanned, live, garbage, corrupt, reclaimable_bytes."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.agg(F.count("*").alias("scanned"), n("live").alias("live"), n("garbage").alias("garbage"), n("corrupt").alias("corrupt"), F.coalesce(F.sum(F.when(F.col("state") == "garbage", F.col("bytes"))), F.lit(0)).cast("bigint").alias("reclaimable_bytes"))


def gc_collect(states: DataFrame, ledger: DataFrame, now_ns: int, grace_ns: int) -> DataFrame:
    """One row for each pack: pack, state, first_unref_ns (of the new ledger, null if not in it), newly_recorded, deleted.

    Garbage is recorded when first seen and deleted once ``grace_ns`` have passed since; a pack that is live again
    leaves the ledger; a corrupt one keeps its place in it and is never deleted.
    """
    rows = states.join(ledger, "pack", "left")
    garbage = F.col("state") == "garbage"
    first = F.when(garbage, F.coalesce("first_unref_ns", F.lit(now_ns))).when(F.col("state") == "corrupt", F.col("first_unref_ns"))
    rows = rows.select("pack", "state", (garbage & F.col("first_unref_ns").isNull()).alias("newly_recorded"), first.alias("first"))
    gone = garbage & (F.greatest(F.lit(now_ns) - F.col("first"), F.lit(0)) >= grace_ns)
    return rows.select("pack", "state", F.when(~gone, F.col("first")).alias("first_unref_ns"), "newly_recorded", gone.alias("deleted"))
