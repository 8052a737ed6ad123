"""One convergence of two sides: diff, reconcile, gate, what to apply and in which order, and whether both may agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .apply import guarded, order_position
from .gc import lineage, safe_base
from .reconcile import Plan, gate, reconcile, standing


@dataclass
class Outcome:
    """plan as reconciled, free of what is held; held(path_str, decision, winner, chunks); mutations(path_str, action,
    position) in the order of applying; divergences(path_str, reason) of a live tree that changed meanwhile."""

    plan: Plan
    held: DataFrame
    mutations: DataFrame
    divergences: DataFrame | None
    held_paths: int
    diverged: bool
    agrees: bool

    def is_noop(self) -> bool:
        return self.mutations.isEmpty()


def mutations(plan: Plan) -> DataFrame:
    """(path_str, action, position): removals deepest first, then what is written from the root down, quarantined copies apart."""
    action = F.when(F.col("result").isNull(), "remove").otherwise("upsert")
    changed = plan.materialize.where("base is not null or result is not null")
    return order_position(changed.select("path_str", action.alias("action")))


def base_of(base: DataFrame, manifests: DataFrame | None, base_id: str | None, local_id: str | None, remote_id: str | None) -> DataFrame:
    """The base, or an empty one if it isn't an ancestor of both sides by manifests(id, parent_manifest_id)."""
    if manifests is None:
        return base
    of = manifests.select("id").where(F.col("id").isin(local_id, remote_id))
    lines = lineage(manifests, of)
    proven = safe_base(lines.where(F.col("start") == local_id), lines.where(F.col("start") == remote_id), base_id)
    return base if proven else base.limit(0)


def converge(base: DataFrame, local: DataFrame, remote: DataFrame, local_device: str, remote_device: str, held: Column | None = None, live: DataFrame | None = None, **lines) -> Outcome:
    """Bring the local side to what both sides' changes since the base amount to.

    ``held`` says what a pin holds, ``live`` is the tree as it is now where that may differ from ``local``; ``lines``
    (manifests, base_id, local_id, remote_id) prove the base. Raises on structural conflicts and on a pin that splits
    what belongs together.
    """
    plan = reconcile(base_of(base, **({"manifests": None, "base_id": None, "local_id": None, "remote_id": None} | lines)), local, remote, local_device, remote_device)
    plan.check()
    free, back, split = gate(plan, F.lit(False) if held is None else held)
    first = split.first()
    if first:
        raise ValueError(f"the pin splits {first[0]} and {first[1]}")
    back = keep(back, "held")
    todo = keep(mutations(free), "mutations")
    odd = None if live is None else keep(guarded(todo.select("path_str", "action"), local, live), "divergences")
    flags = standing(plan, back, sent=False).first()  # one job for all that is asked of the plan
    return Outcome(free, back, todo, odd, flags["held"], flags["local_wins"] > 0, flags["agrees"])


PEER = "device_id string, held_entries bigint, ops_applied bigint, quarantined bigint, conflicts_recorded bigint"


@dataclass
class Released:
    """peers: a row of ``PEER`` each; what is materialized of each; totals over peers; whether a pin ended."""

    peers: DataFrame
    outcomes: dict[str, Outcome]
    total_quarantined: int
    total_conflicts: int
    total_ops: int
    pin_ended: bool


def release(local: DataFrame, peers: dict[str, tuple[DataFrame, DataFrame, int]], local_device: str, pinned: bool = True) -> Released:
    """Converge with each peer of which entries are held: {device: (base, its last held manifest's entries, held entries)}.

    Nothing is held this time, all start from the same local side, and peers without held entries are passed over. The
    pin ends in any case.
    """
    rows, outcomes = [], {}
    for device, (base, remote, held) in sorted(peers.items()):
        if held:
            out = outcomes[device] = converge(base, local, remote, local_device, device)
            rows.append((device, held, out.mutations.count(), out.plan.quarantine.count(), out.plan.conflicts.count()))
    total = lambda i: sum(r[i] for r in rows)
    return Released(local.sparkSession.createDataFrame(rows, PEER), outcomes, total(3), total(4), total(2), pinned)
