"""The registries as streams, with built-in state only.

Events carry a TIMESTAMP `created_at`. State is dropped once the watermark passes it, and a job with very
many events is folded per task before it reaches its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquarry.operators.jobs import JOB_TTL, LATENESS, entry_order, job_status, ordered_entry


def expired_entries(entries: DataFrame, key: str, ttl: str, lateness: str = LATENESS) -> DataFrame:
    """Entries whose lifetime is over (append mode): each run of registrations no further apart than the
    lifetime is one entry, as registering a key again renews it. Steps of a job do not; see `job_state`. The window is one millisecond longer
    than the lifetime, because only entries strictly older are dropped."""
    alive = F.session_window("created_at", f"{ttl} 1 millisecond")
    return (
        entries.withWatermark("created_at", lateness)
        .groupBy(alive.alias("alive"), key)
        .agg(F.max("created_at").alias("last_registered"), F.count("*").alias("registrations"))
        .select(key, "last_registered", "registrations", F.col("alive.end").alias("dropped_at"))
    )


def latest_job_state(jobs: DataFrame, ttl: str = JOB_TTL, lateness: str = LATENESS) -> DataFrame:
    """Last step of each job so far (update mode), one row per job and lifetime-long window of time. A job lives no
    longer than that, so a window's state goes once the watermark has passed it; `run.latest_rows` gives the newest."""
    newest = F.max(entry_order(F.col("created_at"), F.col("event_id"), F.col("step"))).alias("newest")
    found = ordered_entry(F.col("newest"))
    return (
        jobs.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", ttl).alias("alive"), "job_id")
        .agg(newest)
        .select("job_id", found["step"].alias("step"), found["created_at"].alias("updated_at"))
        .withColumn("status", job_status(F.col("step")))
    )


def deduplicated_artifacts(entries: DataFrame, key: str, lateness: str = LATENESS) -> DataFrame:
    """One registration per key within the watermark (append mode)."""
    return entries.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark([key])


def activity_windows(jobs: DataFrame, width: str, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Events and started jobs per closed window (append mode); rows later than the watermark are left out."""
    frame = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return (
        jobs.withWatermark("created_at", lateness)
        .groupBy(frame.alias("frame"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("step") == "downloading").alias("started"))
        .select(F.col("frame.start").alias("window_start"), F.col("frame.end").alias("window_end"), "events", "started")
    )


def activity_sessions(jobs: DataFrame, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Closed sessions of each job (append mode)."""
    return (
        jobs.withWatermark("created_at", lateness)
        .groupBy(F.session_window("created_at", gap).alias("frame"), "job_id")
        .agg(F.count("*").alias("events"))
        .select("job_id", F.col("frame.start").alias("session_start"), F.col("frame.end").alias("session_end"), "events")
    )
