"""Change signals as a stream: debounced batches, what to do about each, and the state that a UI shows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import spare
from ..operators.ordered import with_previous
from ..sources.files import CONFLICT

QUIET = "500 milliseconds"
POLL_SECONDS, AUDIT_SECONDS = 10, 86_400
SIGNALS = "changed polled_changed overflow unwatchable polled_tick audit_due root_vanished root_returned".split()


def action(signal: Column) -> Column:
    return (
        F.when(signal.isin("changed", "polled_changed"), "rescan_subtrees")
        .when(signal.isin("overflow", "root_returned"), "full_rescan")
        .when(signal == "unwatchable", "start_polling")
        .when(signal == "audit_due", "run_audit")
        .otherwise("nothing")
    )


def debounced(signals: DataFrame, keys: list[str], quiet: str = QUIET) -> DataFrame:
    """signals(ts, signal, dir) in batches that end after a silence of ``quiet``: what to run and why.

    Works on a stream (with a watermark on ts) and on a table. A full rescan goes before an audit, an audit before
    dirty directories. The trigger is recovery if anything was lost, else that of the first audit or poll.
    """
    any_of = lambda *s: F.max(F.col("signal").isin(*s))
    first = F.min_by("signal", F.when(F.col("signal").isin("audit_due", "polled_changed"), F.col("ts")))
    out = signals.groupBy(*keys, F.session_window("ts", quiet).alias("w")).agg(
        F.count("*").alias("signals"), any_of("overflow", "root_returned").alias("full"), any_of("audit_due").alias("audit"), any_of("changed", "polled_changed").alias("dirty"), first.alias("first_special"), F.array_sort(F.collect_set(F.when(F.col("signal").isin("changed", "polled_changed"), F.col("dir")))).alias("dirs")
    )
    run = F.when(F.col("full"), "full_rescan").when(F.col("audit"), "audit").when(F.col("dirty"), "incremental").otherwise("nothing")
    trigger = F.when(F.col("full"), "overflow_recovery").when(run == "audit", "audit").when(F.col("first_special") == "polled_changed", "poll").otherwise("events")
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "signals", run.alias("run"), trigger.alias("trigger"), "dirs")


UI_STATE = "manifest string, conflicts bigint, pinned boolean, transferring boolean, raw string, connected boolean"


def ui_states(events: DataFrame, key: str = "folder_id") -> DataFrame:
    """A stream of events(folder_id, kind, manifest, n, flag) folded into each folder's state, one row for each batch and folder.

    A snapshot replaces the state, other events change their part of it; the shown state follows from ``sync_state``.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        manifest, conflicts, pinned, moving, raw, connected = state.get if state.exists else (None, 0, False, False, "idle", True)
        for pdf in batches:
            for e in pdf.sort_values("seq").itertuples():
                if e.kind == "snapshot":
                    manifest, conflicts, pinned, moving, raw = e.manifest, int(e.n or 0), bool(e.flag), False, "synced"
                elif e.kind == "conflict":
                    conflicts += int(e.n or 0)
                elif e.kind == "pin":
                    pinned = bool(e.flag)
                elif e.kind == "transfer":
                    moving = bool(e.flag)
                elif e.kind == "connection":
                    connected, raw = bool(e.flag), raw if e.flag else "offline"
        state.update((manifest, conflicts, pinned, moving, raw, connected))
        yield pd.DataFrame({key: [k[0]], "manifest": [manifest], "conflicts": [conflicts], "pinned": [pinned], "transferring": [moving], "raw": [raw], "connected": [connected]})

    out = f"{key} string, {UI_STATE}"
    return events.groupBy(key).applyInPandasWithState(fold, out, UI_STATE, "update", "NoTimeout")


def root_edges(seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """seen(key, ..., present): the rows at which a root vanished or returned; a return asks for a full rescan."""
    was = spare(seen.columns, "was")
    rows = with_previous(seen, key, order, F.struct("present"), was)
    before = F.col(was)["present"]
    edge = F.when(before & ~F.col("present"), "root_vanished").when(~before & F.col("present"), "root_returned")
    return rows.withColumn("signal", edge).where("signal is not null").drop(was)


def polling(signals: DataFrame, keys: list[str]) -> DataFrame:
    """The directories (keys, dir) that are polled: each that was unwatchable once, on a stream or a table."""
    return signals.where("signal = 'unwatchable'").select(*keys, "dir").dropDuplicates()


def periodic(ticks: DataFrame, ts: str = "ts", poll: int = POLL_SECONDS, audit: int = AUDIT_SECONDS) -> DataFrame:
    """(ts, signal) of ticks, one a second, as of Spark's rate source: polls and audits when they are due."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    due = F.array_compact(F.array(F.when(at % poll == 0, "polled_tick"), F.when(at % audit == 0, "audit_due")))
    return ticks.select(F.col(ts).alias("ts"), F.explode(due).alias("signal"))


def latest_offers(events: DataFrame, subscriber: str, order: list[str]) -> DataFrame:
    """What a slow subscriber gets: its newest event only, in update mode on a stream."""
    rest = [c for c in events.columns if c != subscriber]
    return events.groupBy(subscriber).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(subscriber, "r.*")


def conflict_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(CONFLICT).json(folder)
