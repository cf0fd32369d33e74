"""Job and artifact registries as tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lifetimes of registry entries.
ARTIFACT_TTL = "30 minutes"
JOB_TTL = "60 minutes"

# How late an event may come before "now" passes it.
LATENESS = "10 minutes"


# The steps of a job.
STEPS = ["queued", "downloading", "extracting_frames", "swapping_faces", "reassembling", "processing", "done", "error"]

# An entry's place in time is one whole number: microseconds, event, step. It sorts like the three of them, and the
# least or greatest of plain numbers is found in a hash aggregation.
EVENTS = Decimal(10) ** 19
CODES = Decimal(100)


def job_status(step: Column) -> Column:
    return F.when(step.isin("done", "error"), step).otherwise(F.lit("processing"))


def entry_order(created_at: Column, event_id: Column, step: Column) -> Column:
    """Time, event and step of an entry as one number. Events are not negative, and a null one comes before all others. A
    step that is not in STEPS is not in the number; `with_other_steps` finds it."""
    code = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STEPS]), step), F.lit(0)).cast("decimal(2,0)")
    moment = F.unix_micros(created_at).cast("decimal(17,0)")
    exact = F.lit(EVENTS * CODES).cast("decimal(22,0)")
    event = F.coalesce(event_id.cast("decimal(19,0)") + 1, F.lit(0)).cast("decimal(19,0)")
    return (moment * exact + event * F.lit(CODES) + code).cast("decimal(38,0)")


def ordered_entry(order: Column) -> dict[str, Column]:
    """What `entry_order` was made of."""
    exact = F.lit(EVENTS * CODES).cast("decimal(22,0)")
    rest = F.pmod(order, exact)
    code = F.pmod(rest, F.lit(CODES)).cast("int")
    micros = ((order - rest) / exact).cast("decimal(20,0)").cast("bigint")
    return {
        "created_at": F.timestamp_micros(micros),
        "event_id": (F.nullif(((rest - code) / F.lit(CODES)).cast("decimal(20,0)"), F.lit(0)) - 1).cast("bigint"),
        "step": F.get(F.array(*[F.lit(s) for s in STEPS]), code - 1),
    }


def with_other_steps(found: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """Add `other_step`, the step of the entry that `order` stands for if it is not in STEPS; of several the last in order.
    Only entries with such a step are joined."""
    entry = entry_order(F.col("created_at"), F.col("event_id"), F.col("step"))
    others = entries.filter(~F.col("step").isin(STEPS)).groupBy(F.col(key).alias("_key"), entry.alias("_order"))
    others = others.agg(F.array_max(F.collect_set("step")).alias("other_step"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_order"))
    return found.join(others, same, "left").drop("_key", "_order")


def latest_state(jobs: DataFrame) -> DataFrame:
    """Last step of each job; the maximum combines before the shuffle."""
    newest = F.max(entry_order(F.col("created_at"), F.col("event_id"), F.col("step"))).alias("newest")
    found = ordered_entry(F.col("newest"))
    folded = jobs.groupBy("job_id").agg(newest, F.count("*").alias("events"))
    return (
        with_other_steps(folded, jobs, "job_id", "newest")
        .select("job_id", F.coalesce(found["step"], "other_step").alias("step"), found["created_at"].alias("updated_at"), "events")
        .withColumn("status", job_status(F.col("step")))
    )


def known_jobs(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status of the asked ids that exist; a result is ready only when the job is done."""
    return asked.join(latest_state(jobs).select("job_id", "step", "status"), "job_id").withColumn(
        "ready", F.col("status") == "done"
    )


def missing_jobs(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    return asked.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def registry_clock(entries: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row with the registry's "now": the newest event less the allowed lateness, in milliseconds as
    the stream keeps it."""
    return entries.agg((F.date_trunc("millisecond", F.max("created_at")) - F.expr(f"interval {lateness}")).alias("now"))


def entry_expiry(entries: DataFrame, key: str, ttl: str, lateness: str = LATENESS) -> DataFrame:
    """Newest registration of each key and whether a sweep at "now" drops it: strictly older than the
    lifetime. Registering a key again renews it. The clock is a single row."""
    now = registry_clock(entries, lateness)
    newest = entries.groupBy(key).agg(F.max("created_at").alias("created_at"))
    return newest.select(
        key, "created_at", (F.col("created_at") < now.scalar() - F.expr(f"interval {ttl}")).alias("expired")
    )


LIVES = "job_id bigint, created_at timestamp, updated_at timestamp, step string, events bigint"


def job_lifetimes(jobs: DataFrame, ttl: timedelta = timedelta(minutes=60)) -> DataFrame:
    """One row per entry of a job: an event of a job that has none, or one strictly older than the lifetime, opens it. Later events do not renew
    it: they count and change its step until the lifetime is over.

    Each job's events go through one task in order, as where an entry opens depends on the one before; of a batch only the places where
    entries begin are looked up, and one open entry is carried on. Events without a moment are left out.
    """
    ordered = jobs.select(F.col("job_id").cast("bigint"), "created_at", "event_id", "step").filter(F.col("created_at").isNotNull())
    ordered = ordered.repartition("job_id").sortWithinPartitions("job_id", "created_at", "event_id")
    length = ttl // timedelta(microseconds=1)

    def rows(lives: list[list]) -> pa.RecordBatch:
        ids, opened, updated, steps, events = zip(*lives)
        stamp = pa.timestamp("us", "UTC")
        columns = [pa.array(ids, pa.int64()), pa.array(opened, pa.int64()).cast(stamp), pa.array(updated, pa.int64()).cast(stamp)]
        columns += [pa.array(steps, pa.string()), pa.array(events, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LIVES.split(", ")])

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        life: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at, done = batch.column("job_id").to_pylist(), batch.column("created_at").cast(pa.int64()).to_numpy(), []
            number, missing = batch.column("job_id").fill_null(0).to_numpy(), batch.column("job_id").is_null().to_numpy(zero_copy_only=False)
            new = (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(at)]
            for start, stop in zip(cuts, cuts[1:]):
                while start < stop:
                    if life is None or life[0] != ids[start] or at[start] > life[1] + length:
                        if life is not None:
                            done.append(life)
                        life = [ids[start], int(at[start]), 0, None, 0]
                    end = start + int(np.searchsorted(at[start:stop], life[1] + length, side="right"))
                    life[2:] = int(at[end - 1]), batch.column("step")[end - 1].as_py(), life[4] + end - start
                    start = end
            if done:
                yield rows(done)
        if life is not None:
            yield rows([life])

    return ordered.mapInArrow(folded, LIVES).withColumn("status", job_status(F.col("step")))


def job_expiry(jobs: DataFrame, ttl: timedelta = timedelta(minutes=60), lateness: str = LATENESS) -> DataFrame:
    """The newest entry of each job and whether a sweep at "now" drops it. Its age counts from when it was opened; steps do not renew it."""
    now = registry_clock(jobs, lateness)
    newest = job_lifetimes(jobs, ttl).groupBy("job_id").agg(F.max("created_at").alias("created_at"))
    return newest.select("job_id", "created_at", (F.col("created_at") < now.scalar() - F.lit(ttl)).alias("expired"))


def first_registrations(entries: DataFrame, key: str) -> DataFrame:
    """One row per key, the earliest; ties go to the lower event."""
    first = F.min(entry_order(F.col("created_at"), F.col("event_id"), F.col("step"))).alias("first")
    found = ordered_entry(F.col("first"))
    found["step"] = F.coalesce(found["step"], F.col("other_step"))
    folded = with_other_steps(entries.groupBy(key).agg(first), entries, key, "first")
    return folded.select(key, *[c.alias(name) for name, c in found.items()])


def activity_windows(jobs: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and started jobs per tumbling or sliding window."""
    frame = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return (
        jobs.groupBy(frame.alias("frame"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("step") == "downloading").alias("started"))
        .select(F.col("frame.start").alias("window_start"), F.col("frame.end").alias("window_end"), "events", "started")
    )


def activity_sessions(jobs: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions of each job: runs of events no further apart than the gap.

    Events are first folded into one row per job and minute, which combines before the shuffle, so a job
    with very many events enters the window with as many rows as the log has minutes. Gaps are measured
    between the real first and last moments of neighbouring minutes and stay exact.
    """
    minutes = jobs.groupBy("job_id", F.date_trunc("minute", "created_at").alias("minute")).agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count("*").alias("events")
    )
    line = Window.partitionBy("job_id").orderBy("minute")
    gap = F.expr(f"interval {gap_minutes} minutes")
    opens = F.lag("last").over(line).isNull() | (F.col("first") >= F.lag("last").over(line) + gap)
    return (
        minutes.withColumn("opens", opens.cast("int"))
        .withColumn("session", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("job_id", "session")
        .agg(F.min("first").alias("session_start"), (F.max("last") + gap).alias("session_end"), F.sum("events").alias("events"))
        .drop("session")
    )
