"""Leases as a stateful stream: one value for each running job, a timer at the end of its lease, a list of its generations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Of one instant, what ends a lease comes before what extends it, and that before what starts the next one.
ORDER = {"succeed": 0, "fail": 1, "heartbeat": 2, "claim": 3}
ENDS = {"succeed": "succeeded", "fail": "failed"}


class _Lease(StatefulProcessor):
    def __init__(self, seconds: int, key_type: str) -> None:
        self.span, self.key_type = seconds * 1000, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "generation int, expires long, running boolean")
        self.history = handle.getListState("history", "generation int, status string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, expires, running = self.lease.get() if self.lease.exists() else (0, 0, False)
        events = pd.concat(list(rows))
        events = events.assign(at=events.ts.map(lambda t: t.value // 1_000_000), rank=events.kind.map(ORDER)).sort_values(["at", "rank", "generation"], kind="stable")
        out, ended, before = [], [], expires if running else None
        for kind, at, given in zip(events.kind, events["at"], events.generation, strict=True):
            at = int(at)
            if running and at >= expires:  # no event of the lease came in time
                ended.append((generation, "expired", expires))
                out.append(("expired", generation, expires, True))
                running = False
            known = not pd.isna(given) and int(given) != generation
            accepted = not running if kind == "claim" else kind in ORDER and running and not known
            if accepted and kind == "claim":
                generation, expires, running = generation + 1, at + self.span, True
            elif accepted and kind == "heartbeat":
                expires = at + self.span
            elif accepted:
                expires, running = at, False
                ended.append((generation, ENDS[kind], at))
            out.append(("running" if accepted and running else ENDS.get(kind, "running") if accepted else "refused", generation, expires, accepted))
        if ended:
            self.history.appendList(ended)
        self.lease.update((generation, expires, running))
        if before is not None and (not running or before != expires):
            self.handle.deleteTimer(before)
        if running and before != expires:
            self.handle.registerTimer(expires)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, expires, running = self.lease.get()
        out = []
        if running and expires <= expiredTimerInfo.getExpiryTimeInMs():
            self.history.appendValue((generation, "expired", expires))
            self.lease.update((generation, expires, False))
            out = [("expired", generation, expires, True)]
        yield self._frame(key, out)

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        d = pd.DataFrame(rows, columns=["status", "generation", "expires", "accepted"])
        d.insert(0, "job", pd.Series([key[0]] * len(d), dtype=object if self.key_type == "string" else None))
        ends = pd.Series([pd.Timestamp(e, unit="ms") if g else pd.NaT for g, e in zip(d.generation, d.expires, strict=True)], dtype="datetime64[ms]")
        return d.assign(generation=d.generation.astype("int32"), accepted=d.accepted.astype(bool), expires=ends)

    def close(self) -> None:
        pass


def leases(events: DataFrame, seconds: int = 90, late: str = "10 minutes") -> DataFrame:
    """job, status, generation, expires, accepted: one row for each event of a stream (job, kind: claim | heartbeat | succeed | fail, ts, generation), and one for each lease that runs out.

    A claim is accepted if no lease is running, and starts the next generation. The others are accepted in
    time (strictly before the lease's end) and for the running generation; a null generation is taken
    for the running one, one that is over is `refused`. A lease ends as `expired` when the watermark passes its end, or
    when a later event of the job shows it. Events of one batch are ordered by time, then by ORDER. A null
    job is a job; unknown kinds are refused; before a job's first claim the generation is 0 and expires is null; rows without ts are left out. State is small and bounded by jobs, but for the list of
    generations that ended. Needs the RocksDB state store.
    """
    kind = events.schema["job"].dataType.simpleString()
    rows = events.select("job", "kind", "ts", "generation").filter("ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(_Lease(seconds, kind), f"job {kind}, status string, generation int, expires timestamp, accepted boolean", "append", "eventTime")
