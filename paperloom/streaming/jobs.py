"""Streaming twins of the quota and job queries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.streaming.leases import ORDER


def hourly_counts(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """key, hour, n: counts by fixed hours of event time; events later than the watermark are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("window.start").alias("hour"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, stop, n: sessions closed by a gap."""
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def leases(events: DataFrame, seconds: int = 90) -> DataFrame:
    """job, status, generation, expires from a stream (job, kind: claim | heartbeat | succeed | fail, ts).

    State is one short tuple for each running job. A claim starts a new generation, a heartbeat in
    time extends the lease, and a lease without one is `expired` once the watermark passes its end.
    Events of one instant are taken in the order of leases.ORDER. One row for each batch of a job; for a
    row of each event, with generations and expiry by timer, see `leases.leases`.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        if state.hasTimedOut:
            generation, expires = state.get
            state.remove()
            yield pd.DataFrame({"job": [job], "status": ["expired"], "generation": [generation], "expires": [pd.Timestamp(expires, unit="ms")]})
            return
        generation, expires, status = (*state.get, "running") if state.exists else (0, 0, "idle")
        for f in frames:
            for kind, ts in sorted(zip(f.kind, f.ts, strict=True), key=lambda x: (x[1], ORDER.get(x[0], len(ORDER)))):
                at = int(ts.value // 1_000_000)
                if kind == "claim" and at >= expires:
                    generation, expires, status = generation + 1, at + seconds * 1000, "running"
                elif status == "running" and at < expires:
                    if kind == "heartbeat":
                        expires = at + seconds * 1000
                    else:
                        status = "succeeded" if kind == "succeed" else "failed"
                        expires = at
        if status == "running":
            state.update((generation, expires))
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job": [job], "status": [status], "generation": [generation], "expires": [pd.Timestamp(expires, unit="ms")]})

    kind = events.schema["job"].dataType.simpleString()
    return events.withWatermark("ts", "10 minutes").groupBy("job").applyInPandasWithState(step, f"job {kind}, status string, generation int, expires timestamp", "generation int, expires long", "append", GroupStateTimeout.EventTimeTimeout)


def write_events(stream: DataFrame, path: str, checkpoint: str) -> Any:
    """A sink by micro-batch: each batch's rows go to their own folder, so a replayed batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
