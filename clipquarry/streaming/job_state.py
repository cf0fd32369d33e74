"""Jobs as keyed state with event-time timers: an entry lives from its first event for one lifetime, whatever windows it crosses.

Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clipquarry.operators.jobs import LATENESS, job_status

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

CHANGES = "job_id bigint, created bigint, updated bigint, step string, events bigint, expired boolean"


class JobLives(StatefulProcessor):
    """Per job: the open entry, and events that the watermark has not passed. Events count in order of their moments, as the
    watermark passes them, so late arrivals within the allowed lateness change nothing. Timers wait for the next such event, or else for the end of the
    entry, whose state then goes."""

    def __init__(self, length: int):
        self.length = length  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created bigint, updated bigint, step string, events bigint")
        self.waiting = handle.getListState("waiting", "at bigint, event bigint, step string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            events = part["event"].astype(object).where(part["event"].notna(), None)
            self.waiting.appendList([(int(a), None if e is None else int(e), s) for a, e, s in zip(part["at"], events, part["step"])])
        yield from self._advanced(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key[0], timerValues.getCurrentWatermarkInMs())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        entry = int(row["created"]), int(row["updated"]), row["step"], int(row["events"])
        self.entry.update(entry)
        self._wait([], entry)

    def close(self) -> None:
        pass

    def _advanced(self, job, watermark: int) -> Iterator[pd.DataFrame]:
        limit = watermark * 1000
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        order = lambda w: (w[0], w[1] is not None, w[1] or 0)
        ready, rest = sorted((w for w in waiting if w[0] <= limit), key=order), [tuple(w) for w in waiting if w[0] > limit]
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        out = []
        for at, _, step in ready:
            if entry is None or at > entry[0] + self.length:
                if entry is not None:
                    out.append((*entry, True))
                entry = at, at, step, 0
            entry = entry[0], at, step, entry[3] + 1
        if entry is not None and limit > entry[0] + self.length:
            out.append((*entry, True))
            entry = None
        elif entry is not None and ready:
            out.append((*entry, False))
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
        self._wait(rest, entry)
        if out:
            made = pd.DataFrame([(job, *o) for o in out], columns=[c.split()[0] for c in CHANGES.split(", ")])
            yield made.astype({"created": "int64", "updated": "int64", "events": "int64", "expired": "bool"})

    def _wait(self, rest: list[tuple], entry: tuple | None) -> None:
        """One timer: the first millisecond at which the watermark changes something."""
        wakes = [-(-w[0] // 1000) for w in rest] + ([] if entry is None else [(entry[0] + self.length) // 1000 + 1])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wakes:
            self.handle.registerTimer(min(wakes))


def job_states(
    jobs: DataFrame, ttl: timedelta = timedelta(minutes=60), lateness: str = LATENESS, initial: DataFrame | None = None
) -> DataFrame:
    """Changes of the jobs' entries (update mode): a row when an entry has new events, and a last one, `expired`, when its lifetime is over.

    `initial` has the entries that were open when an earlier run ended, one row a job, in the columns of `jobs.job_lifetimes`. `version` rises
    with each change of a job.
    """
    micros = lambda name: F.unix_micros(name)
    rows = jobs.withWatermark("created_at", lateness).select(
        F.col("job_id").cast("bigint"), "created_at", micros("created_at").alias("at"), F.col("event_id").cast("bigint").alias("event"), "step"
    )
    if initial is not None:
        initial = initial.select(
            F.col("job_id").cast("bigint"), micros("created_at").alias("created"), micros("updated_at").alias("updated"), "step", "events"
        ).groupBy("job_id")
    length = ttl // timedelta(microseconds=1)
    changes = rows.groupBy("job_id").transformWithStateInPandas(JobLives(length), CHANGES, "update", "eventTime", initialState=initial)
    return changes.select(
        "job_id",
        F.timestamp_micros("created").alias("created_at"),
        F.timestamp_micros("updated").alias("updated_at"),
        "step",
        job_status(F.col("step")).alias("status"),
        "events",
        "expired",
        (F.col("updated") * 2 + F.col("expired").cast("bigint")).alias("version"),
    )
