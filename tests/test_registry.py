"""Registries: reads and lifetimes under lazy sweeps, job entries, and their streams against the batch forms."""

import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clipquarry import fixtures as fx
from clipquarry.operators import jobs, registry
from clipquarry.sources.tables import events
from clipquarry.streaming import job_state, reads, run

LOG = "registry string, key string, event_id bigint, at timestamp, sweeps boolean, registers boolean, reads boolean"
ZERO = datetime(2024, 3, 1, tzinfo=timezone.utc)
TTL = {"artifacts": 30, "jobs": 60}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_log(count, seed=3, minutes=0.5):
    """Few keys, equal moments, gaps of exactly a lifetime, null events."""
    draw, out, at = random.Random(seed), [], 0.0
    for n in range(count):
        at += draw.choice([0, 0, minutes, 5 * minutes, 30, 30.001 if draw.random() < 0.1 else 1])
        name = draw.choice(["artifacts", "artifacts", "jobs", "other"])
        act = draw.choice([(True, True, False), (False, True, False), (False, False, True), (False, False, True), (True, False, False), (None, None, True)])
        out.append((name, f"k{draw.randrange(4)}", n if draw.random() < 0.97 else None, ZERO + timedelta(minutes=at), *act))
    return out


def frame(spark, log):
    return spark.createDataFrame(log, LOG)


def replayed(log):
    """The registries as maps, one row of the log after the other; per registration where it ended."""
    held, fates, out = {}, [], []
    order = sorted(range(len(log)), key=lambda i: (log[i][3], log[i][2] is not None, log[i][2] or 0))
    swept = {}
    for i in order:
        name, key, event, at, sweeps, registers, read = log[i]
        if sweeps:
            swept[name] = at
            for (n, k), f in list(held.items()):
                if n == name and n in TTL and fates[f][3] < at - timedelta(minutes=TTL[n]):
                    fates[f][4:] = at, "swept"
                    del held[n, k]
        if registers:
            if (name, key) in held:
                fates[held[name, key]][4:] = at, "replaced"
            held[name, key] = len(fates)
            fates.append([name, key, event, at, None, "alive"])
        if read:
            out.append((name, key, event, at, (name, key) in held, 200 if (name, key) in held else 404))
    return out, [tuple(f) for f in fates]


def naive(found):
    return sorted((tuple(x.replace(tzinfo=timezone.utc) if isinstance(x, datetime) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("min_rows", [registry.HEAVY_ROWS, 5])
def test_reads_and_lifetimes_like_a_map(spark, min_rows):
    # Equal moments with null events have no order among each other, so events are given here.
    log = [(*r[:2], n, *r[3:]) for n, r in enumerate(random_log(500))]
    answers, fates = replayed(log)
    found = registry.registry_reads(frame(spark, log), min_rows=min_rows)
    assert naive(found.drop("registered_at", "swept_at").collect()) == sorted(answers, key=repr)
    assert len({a[4] for a in answers}) == 2
    assert naive(registry.registry_lifetimes(frame(spark, log), min_rows=min_rows).collect()) == sorted(fates, key=repr)
    assert {f[5] for f in fates} == {"swept", "replaced", "alive"}


def test_stale_entries_are_served_until_a_sweep(spark):
    minute = lambda m: ZERO + timedelta(minutes=m)
    log = [
        ("artifacts", "a", 1, minute(0), True, True, False),
        ("artifacts", "a", 2, minute(500), False, False, True),  # long over, but nothing has swept
        ("artifacts", "b", 3, minute(501), False, True, False),  # registers without sweeping
        ("artifacts", "a", 4, minute(502), False, False, True),
        ("jobs", "a", 5, minute(503), True, False, False),  # another registry's sweep
        ("artifacts", "a", 6, minute(504), False, False, True),
        ("artifacts", "b", 7, minute(531), True, False, False),  # b is exactly a lifetime old and stays
        ("artifacts", "a", 8, minute(532), False, False, True),
        ("artifacts", "b", 9, minute(533), False, False, True),
        ("artifacts", "c", 10, minute(534), False, False, True),
        ("artifacts", "c", 11, None, False, True, True),
    ]
    found = registry.registry_reads(frame(spark, log))
    assert sorted(map(tuple, found.select("event_id", "served").collect())) == [(2, True), (4, True), (6, True), (8, False), (9, True), (10, False)]
    assert registry.registry_reads(frame(spark, [])).count() == 0 == registry.registry_lifetimes(frame(spark, [])).count()


def test_no_task_sees_a_whole_registry(spark):
    """The window over a registry's rows is cut into stretches, also where one registry has all rows."""
    log = [("artifacts", f"k{n}", n, ZERO + timedelta(seconds=n), n % 3 == 0, n % 3 == 0, n % 3 > 0) for n in range(3000)]
    plan = registry.registry_reads(frame(spark, log), min_rows=100)._jdf.queryExecution().toString()
    assert "_bucket0" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def plain_lives(log, minutes=60):
    out = {}
    for job, at, event, step in sorted(log, key=lambda r: (repr(r[0]), r[1], r[2])):
        lives = out.setdefault(job, [])
        if not lives or at > lives[-1][0] + timedelta(minutes=minutes):
            lives.append([at, at, step, 0])
        lives[-1][1:] = at, step, lives[-1][3] + 1
    return sorted(((job, *life) for job, lives in out.items() for life in lives), key=repr)


def test_job_lifetimes(spark):
    draw = random.Random(1)
    log = []
    for n in range(900):
        at = ZERO + timedelta(minutes=draw.choice([0, 60, 60.00001, 119, 120, 121, 500]) + draw.randrange(40) * 30)
        log.append((draw.choice([1, 1, 1, 2, 3, None, 0]), at, n, draw.choice(["queued", "done", "strange"])))
    df = spark.createDataFrame(log, "job_id bigint, created_at timestamp, event_id bigint, step string")
    found = jobs.job_lifetimes(df.unionByName(df.limit(1).withColumn("created_at", F.lit(None).cast("timestamp"))))
    assert naive(found.drop("status").collect()) == plain_lives(log)
    assert jobs.job_lifetimes(df.limit(0)).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert naive(jobs.job_lifetimes(df).drop("status").collect()) == plain_lives(log)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_do_not_renew_a_job(spark):
    minute = lambda m: ZERO + timedelta(minutes=m)
    log = [(1, minute(0), 1, "queued"), (1, minute(50), 2, "done"), (2, minute(0), 3, "queued"), (2, minute(61), 4, "done"), (3, minute(75), 5, "queued")]
    df = spark.createDataFrame(log, "job_id bigint, created_at timestamp, event_id bigint, step string")
    assert rows(jobs.job_expiry(df).select("job_id", "expired")) == [(1, True), (2, False), (3, False)]
    assert rows(jobs.entry_expiry(df, "job_id", jobs.JOB_TTL).select("job_id", "expired")) == [(1, False), (2, False), (3, False)]


# --- streams ---


def arriving(spark, df, order, parts, late_by):
    """A stream of `parts` files, in the order of moments up to `late_by` minutes."""
    folder = tempfile.mkdtemp(prefix="run-")
    found = df.collect()
    draw = random.Random(5)
    found.sort(key=lambda r: r[order] + timedelta(minutes=draw.random() * late_by))
    size = -(-len(found) // parts)
    for n in range(parts):
        spark.createDataFrame(found[n * size : (n + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_reads_stream(spark, data):
    log = fx.registry_log(events(spark, data))
    folder = tempfile.mkdtemp(prefix="run-")
    reads.run_reads(arriving(spark, log, "at", 5, 9), "reads", folder, timeout_seconds=300)
    now = log.agg(F.date_trunc("millisecond", F.max("at")) - F.expr("interval 10 minutes")).first()[0]
    want = registry.registry_reads(log.filter(F.col("at") <= F.lit(now)))
    got = reads.answers(spark, folder)
    assert rows(got.select(want.columns)) == rows(want) and {r.served for r in got.collect()} == {True, False}
    assert spark.read.parquet(f"{folder}/late").count() == 0
    state = run.snapshot(spark, f"{folder}/state", 4)
    assert state.count() < 60 < log.count()


def test_late_rows_are_set_aside(spark):
    log = [("artifacts", "a", n, ZERO + timedelta(minutes=m), True, True, True) for n, m in enumerate([0, 40, 80, 20])]
    folder = tempfile.mkdtemp(prefix="run-")
    source = tempfile.mkdtemp(prefix="run-")
    for part in (log[:3], log[3:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        reads.run_reads(stream, "late_reads", folder, timeout_seconds=120)
    assert [r.event_id for r in spark.read.parquet(f"{folder}/late").collect()] == [3]
    assert sorted(r.event_id for r in reads.answers(spark, folder).collect()) == [0, 1]


@pytest.fixture
def keyed_state(spark):
    for name, value in job_state.STATE_STORE.items():
        spark.conf.set(name, value)
    yield
    for name in job_state.STATE_STORE:
        spark.conf.unset(name)


def run_states(spark, stream, name, initial=None):
    folder = tempfile.mkdtemp(prefix="run-")
    states = job_state.job_states(stream, initial=initial)
    running = (
        states.writeStream.outputMode("update")
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/progress")
        .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/changes"))
        .start()
    )
    assert running.awaitTermination(300)
    return spark.read.parquet(f"{folder}/changes"), running.recentProgress


def last_changes(changes):
    """The last change of each entry."""
    return changes.groupBy("job_id", "created_at").agg(F.max_by(F.struct("updated_at", "step", "events", "expired"), "version").alias("row")).select(
        "job_id", "created_at", "row.*"
    )


def batch_states(log):
    now = jobs.registry_clock(log).first().now
    lives = jobs.job_lifetimes(log.filter(F.col("created_at") <= F.lit(now)))
    return lives.withColumn("expired", F.col("created_at") < F.lit(now) - F.expr("interval 60 minutes")).drop("status")


def test_job_states_across_windows(spark, data, keyed_state):
    log = fx.job_events(events(spark, data))
    changes, progress = run_states(spark, arriving(spark, log, "created_at", 4, 9), "states")
    want = batch_states(log)
    got = last_changes(changes)
    assert rows(got.select(want.columns)) == rows(want)
    assert want.groupBy("job_id").count().filter("count > 3").count() > 5
    waiting = log.count() - want.agg(F.sum("events")).first()[0]
    left = [s.numRowsTotal for p in progress for s in p.stateOperators]
    alive = want.filter(~F.col("expired")).count()
    # Entries, waiting events, and a timer of each job with its index; nothing of entries that are over.
    assert left and left[-1] <= 4 * (alive + waiting) < 60 and alive < want.count() / 20


def test_job_states_go_on_from_a_table(spark, data, keyed_state):
    log = fx.job_events(events(spark, data))
    several = jobs.job_lifetimes(log).filter(F.col("events") > 1).filter(F.col("created_at") > F.lit(datetime(2024, 1, 10)))
    half = several.agg(F.min("created_at")).first()[0]  # this entry has a step after the break
    first, second = log.filter(F.col("created_at") <= F.lit(half)), log.filter(F.col("created_at") > F.lit(half))
    lives = jobs.job_lifetimes(first)
    open_ones = lives.filter(F.col("created_at") >= F.lit(half) - F.expr("interval 60 minutes"))
    assert open_ones.count() > 0
    changes, _ = run_states(spark, arriving(spark, second, "created_at", 3, 0), "resumed", open_ones)
    want = batch_states(log).filter(F.col("updated_at") > F.lit(half))
    got = last_changes(changes.filter(F.col("updated_at") > F.lit(half)))
    assert rows(got.select(want.columns)) == rows(want)
    crossing = want.filter(F.col("created_at") <= F.lit(half))
    assert crossing.count() > 0
