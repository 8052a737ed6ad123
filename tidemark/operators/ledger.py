"""Agreements, held entries, conflicts and logs: latest-of, summaries, bounded logs, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import spare
from .ordered import with_previous

CONFLICTS_KEPT, CONFLICTS_MOST, LOG_KEPT, FINDINGS_SHOWN, SUGGESTIONS = 1024, 4096, 100, 20, 8


def latest_agreement(agreements: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the agreement of the latest time, the greater peer of equals."""
    rest = [c for c in agreements.columns if c not in keys]
    return agreements.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("agreed_sec", "agreed_nsec", "peer")).alias("r")).select(*keys, "r.*")


def first_agreement(agreements: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the agreement of the least peer, whenever it was made."""
    rest = [c for c in agreements.columns if c not in keys]
    return agreements.groupBy(*keys).agg(F.min_by(F.struct(*rest), "peer").alias("r")).select(*keys, "r.*")


def recorded(agreements: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger after new records: one row a key, the new one where there is one."""
    return agreements.join(new.select(*keys), keys, "left_anti").unionByName(new)


def forgotten(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger without the rows of these keys."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def ensured(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """A registry with a row for each wanted key: the one that it has, else the wanted one."""
    return rows.unionByName(wanted.join(rows.select(*keys).distinct(), keys, "left_anti"))


def not_on_current(agreements: DataFrame, current: Column) -> DataFrame:
    """How many peers have not agreed to the current manifest."""
    return agreements.agg(F.count_if(~F.col("manifest_id").eqNullSafe(current)).alias("behind"))


def new_held(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Held entries to append: once each by path and manifest, and not in the ledger yet."""
    keys = ["path", "remote_manifest_id"]
    return batch.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def held_summary(held: DataFrame) -> DataFrame:
    """Of each peer its held paths, sorted, and their number."""
    return held.groupBy("peer").agg(F.array_sort(F.collect_set("path")).alias("paths")).withColumn("n", F.size("paths").cast("bigint"))


def keep_last(log: DataFrame, keys: list[str], order: list[Column], n: int = CONFLICTS_KEPT) -> DataFrame:
    """The last n rows of each key."""
    rn = spare(log.columns, "rn")
    back = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn(rn, F.row_number().over(back)).where(F.col(rn) <= n).drop(rn)


def compacted(log: DataFrame, keys: list[str], order: list[Column], most: int = CONFLICTS_MOST, kept: int = CONFLICTS_KEPT) -> DataFrame:
    """The log of each key cut to its last ``kept`` rows once it has more than ``most``."""
    sizes = log.groupBy(*keys).agg(F.count("*").alias("_n"))
    back = Window.partitionBy(*keys).orderBy(*order)
    return log.join(sizes, keys).withColumn("_rn", F.row_number().over(back)).where((F.col("_n") <= most) | (F.col("_rn") <= kept)).drop("_n", "_rn")


def changes(states: DataFrame, key: str, order: list[str], watched: list[str]) -> DataFrame:
    """The rows at which any watched column differs from the row before of its key, the first included."""
    before = spare(states.columns, "before")
    seen = with_previous(states, key, order, F.struct(F.struct(*watched).alias("s")), before)
    return seen.where(~F.col(before)["s"].eqNullSafe(F.struct(*watched))).drop(before)


def activity_log(events: DataFrame, key: str, order: list[str], kept: int = LOG_KEPT) -> DataFrame:
    """events(key, level, message, disconnect, ...) without what repeats the last kept row of its key, the last ``kept`` of each.

    A row repeats one of its level and message, and a disconnect repeats any disconnect; level and message tell what is
    one. Rows between the last kept row and a row that repeats the one before it repeat that kept row, too, so each
    row has to look at the row before only.
    """
    seen = with_previous(events, key, order, F.struct("level", "message", "disconnect"), "_before")
    now = F.struct("level", "message")
    same = F.struct("_before.level", "_before.message").eqNullSafe(now) | F.coalesce(F.col("_before.disconnect") & F.col("disconnect"), F.lit(False))
    return keep_last(seen.where(F.col("_before").isNull() | ~same).drop("_before"), [key], [F.desc(c) for c in order], kept)


def suggestions(paths: DataFrame, typed: str, n: int = SUGGESTIONS) -> DataFrame:
    """The first n paths that start with what was typed, whatever the case."""
    return paths.where(F.startswith(F.lower("path"), F.lit(typed.lower()))).orderBy("path").limit(n)


def dir_listing(entries: DataFrame) -> DataFrame:
    """Directories first, then by name."""
    return entries.orderBy(F.desc("is_dir"), "name")


def sync_state(connected: Column, raw: Column, pinned: Column, conflicts: Column, transferring: Column) -> Column:
    """The state to show, by priority."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(~connected & (s == "offline"), "offline")
        .when(pinned | (s == "pinned"), "pinned")
        .when((conflicts > 0) | (s == "conflict"), "conflict")
        .when((s == "syncing") | transferring, "syncing")
        .when(s.isin("synced", "idle", "error", "offline"), s)
        .otherwise("synced")
    )


def pin_active(released: Column, expires: Column, now: Column, alive: Column) -> Column:
    return ~released & ~F.coalesce(now >= expires, F.lit(False)) & alive


def peer_allowed(peers: DataFrame, offered: DataFrame) -> DataFrame:
    """offered(peer, ...) with ``allowed``: known peers are, and none is where no peer is known."""
    return offered.join(peers.select("peer").distinct().withColumn("_known", F.lit(True)), "peer", "left").withColumn("allowed", F.coalesce("_known", F.lit(False))).drop("_known")
