"""Parsing, result files, registry streams."""

import tempfile

from pyspark.sql import functions as F

from clipquarry import fixtures as fx
from clipquarry.operators import jobs
from clipquarry.sources import requests, runs, sinks
from clipquarry.sources.tables import events, table
from clipquarry.streaming import registry, run


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_requests(spark):
    bodies = ['{"videoUrl":"u","frames":6}', '{"videoUrl":""}', "{oops", "[]", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "req_id bigint, body string")
    got = rows(requests.scan_requests(df), "req_id")
    assert got[0] == (0, "u", "6", None)
    assert [r[3] for r in got[1:]] == ["missing_video_url", "bad_json", "bad_json", "bad_json"]


def test_transcript_response(spark):
    body = '{"text":"t","segments":[{"text":"a","no_speech_prob":0.1}],"words":[{"word":" a","start":0,"end":0.5},{"word":"b"}]}'
    df = spark.createDataFrame([(1, body), (2, '{"text":"x"}')], "response_id bigint, body string")
    parsed = requests.scan_transcripts(df)
    assert rows(requests.transcript_words(parsed)) == [(1, 0, " a", 0.0, 0.5), (1, 1, "b", None, None), (2, None, None, None, None)]
    assert rows(requests.transcript_segments(parsed))[0] == (1, 0, "a", 0.1, None, None)


def test_results_replace_their_partitions_only(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "day int, x string")
    sinks.write_results(first, folder, "day")
    sinks.write_results(spark.createDataFrame([(2, "c")], "day int, x string"), folder, "day")
    assert rows(spark.read.parquet(folder).select("day", "x")) == [(1, "a"), (2, "c")]


def test_runs_are_whole_and_repeatable(spark):
    folder = f"{tempfile.mkdtemp(prefix='run-')}/results"
    make = lambda *r: spark.createDataFrame(r, "day int, x string")
    schema = make((1, "a")).schema
    read = lambda: rows(runs.read_runs(spark, folder, schema))
    assert read() == []
    runs.stage_run(make((1, "lost")), folder, "day")
    assert read() == []
    assert runs.commit_run(make((1, "a"), (2, "b"), (None, "n"), (2, "b")), 1, folder, "day")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    seen = lambda: sorted((tuple(r) for r in runs.read_runs(spark, folder, schema).collect()), key=key)
    one = [(1, "a"), (2, "b"), (2, "b"), (None, "n")]
    assert seen() == one
    assert not runs.commit_run(make((1, "other")), 1, folder, "day") and seen() == one
    staged = runs.stage_run(make((2, "c")), folder, "day")
    assert seen() == one
    earlier = runs.read_runs(spark, folder, schema)
    runs.publish_run(spark, staged, 2, folder, schema)
    two = [(1, "a"), (2, "c"), (None, "n")]
    assert seen() == two and sorted((tuple(r) for r in earlier.collect()), key=key) == one
    runs.compact(spark, folder, schema, "day")
    assert seen() == two and {r.level for r in runs.newest_runs(spark, folder).collect()} == {1}
    runs.commit_run(make((1, "late")), 3, folder, "day")
    assert seen() == [(1, "late"), (2, "c"), (None, "n")]


def test_a_run_published_during_compaction_stays_the_newest(spark, monkeypatch):
    folder = f"{tempfile.mkdtemp(prefix='run-')}/results"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "day int, x string")
    runs.commit_run(old, 1, folder, "day")
    stage = runs.stage_run

    def and_meanwhile(results, *args):
        run = stage(results, *args)
        monkeypatch.setattr(runs, "stage_run", stage)
        runs.commit_run(spark.createDataFrame([(2, "new")], "day int, x string"), 2, folder, "day")
        return run

    monkeypatch.setattr(runs, "stage_run", and_meanwhile)
    runs.compact(spark, folder, old.schema, "day")
    assert rows(runs.read_runs(spark, folder, old.schema)) == [(1, "a"), (2, "new")]


def test_envelope(spark):
    df = spark.createDataFrame([(True, 1, None), (False, 2, "bad")], "ok boolean, n int, e string")
    got = [r[0] for r in df.select(sinks.result_envelope(F.col("ok"), [F.col("n")], F.col("e"))).collect()]
    assert got == ['{"success":true,"n":1}', '{"success":false,"error":"bad"}']


# --- Streams ---


def job_stream(spark, data):
    """The event log, fed in several micro-batches in time order."""
    folder = tempfile.mkdtemp(prefix="run-")
    log = table(spark, data, "events")
    size = log.count()
    for quarter in range(4):
        log.filter(F.col("event_id") * 4 >= quarter * size).filter(
            F.col("event_id") * 4 < (quarter + 1) * size
        ).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return fx.job_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))


def drain(spark, df, name):
    folder = tempfile.mkdtemp(prefix="run-")
    run.run_available(df, name, folder, timeout_seconds=240)
    return spark.read.parquet(folder)


def batch_jobs(spark, data):
    return fx.job_events(events(spark, data))


def test_latest_state_stream(spark, data):
    folder = tempfile.mkdtemp(prefix="run-")
    stream = registry.latest_job_state(job_stream(spark, data))
    run.run_available(stream, "latest_state", folder, "update", 240, key="job_id", newest_by="updated_at")
    want = jobs.latest_state(batch_jobs(spark, data)).select("job_id", "step", "updated_at", "status")
    assert rows(run.latest_rows(spark, folder).select(want.columns)) == rows(want)
    assert {r.turn for r in spark.read.parquet(folder).select("turn").distinct().collect()} == {0, 1}


def test_sliding_window_stream(spark, data):
    got = drain(spark, registry.activity_windows(job_stream(spark, data), "1 hour", "15 minutes"), "sliding")
    batch = jobs.activity_windows(batch_jobs(spark, data), "1 hour", "15 minutes")
    now = jobs.registry_clock(batch_jobs(spark, data)).first().now
    assert rows(got) == rows(batch.filter(F.col("window_end") <= F.lit(now)))


def test_times_do_not_depend_on_the_session_zone(spark, data):
    from clipquarry.queries import QUERIES

    names = ("iso_utc_timestamp", "job_latest_state", "job_activity_session", "artifact_expiry")
    want = {n: rows(QUERIES[n](spark, data)) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {n: rows(QUERIES[n](spark, data)) for n in names}
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


def test_window_stream(spark, data):
    got = drain(spark, registry.activity_windows(job_stream(spark, data), "1 hour"), "windows")
    batch = jobs.activity_windows(batch_jobs(spark, data), "1 hour")
    now = jobs.registry_clock(batch_jobs(spark, data)).first().now
    assert rows(got) == rows(batch.filter(F.col("window_end") <= F.lit(now)))


def test_session_stream(spark, data):
    got = drain(spark, registry.activity_sessions(job_stream(spark, data), "30 minutes"), "sessions")
    batch = jobs.activity_sessions(batch_jobs(spark, data), 30)
    now = jobs.registry_clock(batch_jobs(spark, data)).first().now
    assert rows(got) == rows(batch.filter(F.col("session_end") <= F.lit(now)).select(got.columns))


def test_expiry_stream(spark, data):
    got = drain(spark, registry.expired_entries(job_stream(spark, data), "job_id", jobs.JOB_TTL), "expired")
    dropped = {(r.job_id, r.last_registered) for r in got.collect()}
    for entry in jobs.entry_expiry(batch_jobs(spark, data), "job_id", jobs.JOB_TTL).collect():
        assert ((entry.job_id, entry.created_at) in dropped) == entry.expired


def test_dedup_stream(spark, data):
    keyed = job_stream(spark, data).withColumn("token", F.concat_ws("_", F.col("job_id").cast("string"), "step"))
    got = drain(spark, registry.deduplicated_artifacts(keyed, "token", "40 days"), "dedup")
    batch = batch_jobs(spark, data).withColumn("token", F.concat_ws("_", F.col("job_id").cast("string"), "step"))
    want = jobs.first_registrations(batch, "token").select("token").collect()
    assert sorted(r.token for r in got.collect()) == sorted(r.token for r in want)
