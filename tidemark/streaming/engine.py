"""The watch engine of a root as a stateful stream: debounce, polls, audits and root edges with timers.

Signals of a root are folded by ``transformWithStateInPandas``. The state of a root is the open batch and its deadline,
the directories that are polled and when each is due, the next audit, and whether the root is there; it is in Spark's
state store, so a restarted query goes on where it stopped. Time is the processing time, or the event time of the signals
(with a watermark), which gives the same rows for the same signals however they are split into batches.

Everything that is due happens in the order of its time, before a later signal is taken: a batch ends when nothing has come
for ``quiet_ms``; every polled directory gives a ``sweep`` each ``poll_ms``, unless the root is gone; an audit joins the
batch each ``audit_ms``. Observations of the root (``root_absent``, ``root_present``) give signals at edges only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "root string, at_ms bigint, action string, trigger string, dirs array<string>"
#: Signals that open or prolong a batch.
QUEUED = ("changed", "polled_changed", "overflow", "audit_due", "root_returned", "unwatchable")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Watch:
    """What is known of one root."""

    quiet_ms: int = 500
    poll_ms: int = 10_000
    audit_ms: int = 86_400_000
    deadline: int | None = None
    signals: list[str] = field(default_factory=list)
    dirs: list[str] = field(default_factory=list)
    polled: dict[str, int] = field(default_factory=dict)
    audit: int | None = None
    gone: bool = False

    def due(self) -> int | None:
        """When something happens next, if no signal comes."""
        return min((t for t in (self.deadline, self.audit, *self.polled.values()) if t is not None), default=None)

    def advance(self, now: int) -> Iterator[tuple[int, str, str, list[str]]]:
        """All that is due up to now, in the order of time; at one time a batch ends first, then sweeps, then the audit."""
        while (at := self.due()) is not None and at <= now:
            if self.deadline == at:
                yield self.flushed()
                continue
            for d in sorted(d for d, t in self.polled.items() if t == at):
                self.polled[d] = at + self.poll_ms
                if not self.gone:
                    yield at, "sweep", "poll", [d]
            if self.audit == at:
                self.audit = at + self.audit_ms
                self.queue(at, "audit_due")

    def queue(self, at: int, signal: str, changed: str | None = None) -> None:
        self.deadline = at + self.quiet_ms
        self.signals.append(signal)
        if changed is not None and changed not in self.dirs:
            self.dirs.append(changed)

    def flushed(self) -> tuple[int, str, str, list[str]]:
        """The batch as one action: a full rescan goes before an audit, an audit before dirty directories."""
        s, at, dirs = self.signals, self.deadline, sorted(self.dirs)
        full, special = "overflow" in s or "root_returned" in s, next((x for x in s if x in ("audit_due", "polled_changed")), None)
        action = "full_rescan" if full else "audit" if "audit_due" in s else "incremental" if "changed" in s or "polled_changed" in s else "nothing"
        trigger = "overflow_recovery" if full else "audit" if action == "audit" else "poll" if special == "polled_changed" else "events"
        self.deadline, self.signals, self.dirs = None, [], []
        return at, action, trigger, dirs

    def take(self, at: int, signal: str, where: str | None) -> Iterator[tuple[int, str, str, list[str]]]:
        yield from self.advance(at)
        if self.audit is None:
            self.audit = at + self.audit_ms
        if signal in ("root_absent", "root_present"):
            was, self.gone = self.gone, signal == "root_absent"
            if self.gone and not was:
                yield at, "root_vanished", "events", []
            elif was and not self.gone:
                self.queue(at, "root_returned")
        elif signal in QUEUED:
            if signal == "unwatchable":
                self.polled.setdefault(where or "", at + self.poll_ms)
                yield at, "start_polling", "events", [where or ""]
            self.queue(at, signal, where or "" if signal in ("changed", "polled_changed") else None)


class Engine(StatefulProcessor):
    """One state and one timer for each root: the timer is for what is due next."""

    def __init__(self, settings: dict, event_time: bool):
        self.settings, self.event_time = settings, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("watch", "json string")

    def load(self) -> Watch:
        return Watch(**json.loads(self.kept.get()[0])) if self.kept.exists() else Watch(**self.settings)

    def now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def save(self, watch: Watch, now: int) -> None:
        self.kept.update((json.dumps(asdict(watch)),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (at := watch.due()) is not None:
            self.handle.registerTimer(max(at, now + 1))

    def rows(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watch, now, out = self.load(), self.now(timerValues), []
        batch = pd.concat(rows).sort_values(["ts_ms", "seq"])
        for ts, signal, where in zip(batch["ts_ms"], batch["signal"], batch["dir"]):
            out += watch.take(int(ts) if self.event_time else now, signal, where if isinstance(where, str) else None)
        out += watch.advance(now)
        self.save(watch, now)
        yield from self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch, now = self.load(), self.now(timerValues)
        out = list(watch.advance(now))
        self.save(watch, now)
        yield from self.rows(key, out)

    def close(self) -> None:
        """Spark closes the state."""


def watched(signals: DataFrame, event_time: bool = False, quiet_ms: int = 500, poll_ms: int = 10_000, audit_ms: int = 86_400_000) -> DataFrame:
    """A stream of signals(root, ts, seq, signal, dir) as actions: root, at_ms, action, trigger, dirs.

    Actions are incremental (rescan ``dirs``), full_rescan, audit, sweep (compare the stats of one directory), start_polling,
    root_vanished and nothing. With ``event_time`` signals need a watermark on ts; later ones than that are dropped. The
    query needs the state store ``STORE``.
    """
    settings = {"quiet_ms": quiet_ms, "poll_ms": poll_ms, "audit_ms": audit_ms}
    rows = signals.selectExpr("root", "ts", "unix_millis(cast(ts as timestamp)) as ts_ms", "seq", "signal", "dir")
    return rows.groupBy("root").transformWithStateInPandas(Engine(settings, event_time), OUT, "Append", "EventTime" if event_time else "ProcessingTime")
