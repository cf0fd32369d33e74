"""Edges of the table operators, and hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipquarry.functions import phash
from clipquarry.operators import captions, detections, hashes, jobs, profiles, reels, speech
from clipquarry.plans import sampling
from clipquarry import skew
from clipquarry.skew import heavy_keys, salted_join, with_position, with_running_total


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- Hot keys ---


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows under one key."""
    return spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )


def test_position_of_a_hot_key(hot):
    for min_rows in (1, 50, 10_000):
        placed = with_position(hot, ["k"], ["v"], [F.expr("v div 640"), F.expr("v div 64")], "place", min_rows)
        places = rows(placed.filter("k = 7").select("v", "place"), "v")
        assert [p for _, p in places] == list(range(len(places))) and len(places) == 2001
        assert placed.count() == 4000 and placed.filter("k <> 7 and place <> 0").count() == 0


def test_heavy_keys(hot):
    assert rows(heavy_keys(hot, ["k"], min_rows=10)) == [(7, 2001)]
    assert heavy_keys(hot, ["k"]).count() == 0
    assert heavy_keys(hot, ["k"], min_rows=1).count() == 2000


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_keys", [0, 10_000])
def test_salted_join_keeps_every_row(spark, hot, how, broadcast_keys, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", broadcast_keys)
    many = hot.unionByName(spark.createDataFrame([(None, -1), (None, -2)], "k bigint, v bigint"))
    side = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for min_rows in (1, 50, 100_000):
        salted = salted_join(many, side, ["k"], ["v"], how, min_rows=min_rows)
        assert rows(salted.select("k", "v", "w"), "v") == rows(many.join(side, "k", how).select("k", "v", "w"), "v")


def test_missing_keys_are_spread(spark):
    many = spark.range(2000).select(F.when(F.col("id") > 1500, F.col("id")).alias("k"), F.col("id").alias("v"))
    side = spark.range(1400, 1900).select(F.col("id").alias("k"))
    assert _tasks_of(spark, lambda: salted_join(many, side, ["k"], ["v"], "left", min_rows=100), None) == 32
    assert rows(salted_join(many, side, ["k"], ["v"], min_rows=100).select("v")) == [(v,) for v in range(1501, 1900)]


def _tasks_of(spark, df, key):
    """Tasks that the rows of a key lie in after the join, without adaptive coalescing and broadcasts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return df().filter(F.col("k").eqNullSafe(F.lit(key))).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_every_hot_key_is_spread_by_its_size(spark):
    """A key of a third of all rows, and one of rank 10,001 among the hot ones."""
    ranks = spark.range(10_001).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    more = spark.range(10_000).select(F.col("id").alias("k"), F.lit(7).alias("n"))
    third = spark.range(30_000).select(F.lit(-1).cast("bigint").alias("k"), (F.col("id") + 100).cast("int").alias("n"))
    many = ranks.unionByName(more).unionByName(third)
    side = many.select("k").distinct()
    spread = lambda: salted_join(many, side, ["k"], ["n"], min_rows=3)
    assert _tasks_of(spark, spread, 10_000) > 1 and _tasks_of(spark, spread, -1) == 32


def test_running_total_of_a_hot_key(hot):
    for min_rows in (1, 50, 10_000):
        total = with_running_total(hot, ["k"], ["v"], [F.expr("v div 640")], F.col("v"), "sum", min_rows)
        got = rows(total.filter("k = 7").select("v", "sum"), "v")
        assert [s for _, s in got] == np.cumsum([v for v, _ in got]).tolist() and total.count() == 4000


def test_without_hot_keys_the_plan_is_plain(spark, data):
    """One window or join, one scan of each table, and no more than that."""
    from clipquarry.queries import QUERIES

    plan = QUERIES["word_normalize"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Window") == 1 and "Join" not in plan
    plan = QUERIES["vision_request_bundle"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") <= 4


# --- Speech ---


def segments(spark, *items):
    return spark.createDataFrame(
        [(1, i, *x) for i, x in enumerate(items)],
        "video_id bigint, seg_idx bigint, text string, no_speech_prob double, avg_logprob double, compression_ratio double",
    )


def test_confidence_limits_are_strict(spark):
    df = segments(spark, (" a ", None, None, None), ("b", 0.6, 0.0, 1.0), ("c", 0.59, -1.0, 1.0), ("d", 0.0, -0.9, 2.4), (" ", 0.0, 0.0, 1.0))
    assert rows(speech.transcript_assemble(df)) == [(1, "a", 2, 3, True)]


@pytest.mark.parametrize("part_segments", [4, 4096])
def test_long_transcript_is_one_row(spark, part_segments):
    said = [(f"w{i}", 0.9 if i < 4096 else 0.0, 0.0, 1.0) for i in range(5000)]
    got = rows(speech.transcript_assemble(segments(spark, *said), part_segments))
    assert got == [(1, " ".join(f"w{i}" for i in range(4096, 5000)), 904, 4096, True)]


def test_silent_transcript(spark):
    df = segments(spark, ("x", 0.9, 0.0, 1.0))
    assert rows(speech.transcript_assemble(df)) == [(1, "", 0, 1, False)]
    assert rows(speech.transcript_presence(df)) == [(1, 0, 1, False)]


def test_request_bundle_has_one_request_of_each_kind(spark):
    lists = spark.createDataFrame(
        [(1, "gateway", 80, 12.0, " a beach ", "0,4", " note"), (2, "direct", 5, 1.26, "  ", "0,1", ""), (3, "direct", 5, 1.0, None, "0", "")],
        "video_id bigint, route string, n_frames bigint, seconds double, brief string, frame_list string, note string",
    )
    transcripts = speech.transcript_assemble(segments(spark, *[(f"w{i}", 0.0, 0.0, 1.0) for i in range(3)]), part_segments=2)
    got = rows(speech.request_bundle(lists, transcripts, "Go.").select("video_id", "kind", "request_text"))
    start = "These %d frames were extracted from the video"
    own = "These %d frames were extracted from my own source video. Its exact duration is %s seconds — use this figure, do not estimate.\n\n"
    wish = "The background change I want: %s"
    assert got == [
        (1, "background", own % (80, "12") + wish % "a beach" + " note"),
        (1, "describe", start % 80 + '. Transcript: "w0 w1 w2"\n\nGo. note'),
        (2, "background", own % (5, "1.3") + wish % speech.NO_BRIEF),
        (2, "describe", start % 5 + " (no audio). Go."),
        (3, "background", own % (5, "1") + wish % speech.NO_BRIEF),
        (3, "describe", start % 5 + " (no audio). Go."),
    ]


def test_clips_without_words_are_silent(spark):
    clips = spark.createDataFrame([(1, 9.0), (2, 4.0), (3, None)], "video_id bigint, probe_duration double")
    assert rows(speech.speech_coverage(words(spark, ("a", 0.0, 1.5)), clips)) == [(1, 9.0, 1.5, 7.5), (2, 4.0, 0.0, 4.0), (3, 0.0, 0.0, 0.0)]


# --- Captions ---


def words(spark, *items):
    return spark.createDataFrame(
        [(1, i, *x) for i, x in enumerate(items)], "video_id bigint, word_idx bigint, word string, start_s double, end_s double"
    )


@pytest.mark.parametrize("count,sizes", [(3, [3]), (4, [3, 1]), (6, [3, 3])])
def test_chunk_sizes(spark, count, sizes):
    df = words(spark, *[(f" w{i}", i * 1.0, i + 0.5) for i in range(count)])
    got = rows(captions.caption_chunks(df).select("chunk_idx", "text", "start_s", "end_s"))
    assert [len(t.split()) for _, t, _, _ in got] == sizes
    assert got[-1][2:] == (float(count - sizes[-1]), count - 0.5)


def test_chunk_keeps_blank_words_and_missing_start(spark):
    df = words(spark, ("a", None, 1.0), (" ", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 3.0, 3.0))
    got = rows(captions.caption_chunks(df))
    assert got[0][2:] == ("a  b", None, 3.0, False) and got[1][2:] == ("c", 3.0, 3.0, False)
    assert captions.usable_chunks(df).count() == 0


def test_missing_times_of_client_cues_are_zero(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", None, "1"), (1, 1, "b", "abc", "1"), (1, 2, "c", "1", "1"), (1, 3, " ", "0", "1"), (1, 4, " d ", "", " 2 "), (1, 5, "e", "1", None)],
        "reel_id bigint, cue_idx bigint, text string, start_raw string, end_raw string",
    )
    assert rows(captions.usable_cues(df)) == [(1, 0, "a", 0.0, 1.0), (1, 4, "d", 0.0, 2.0)]


def test_overlay_is_closed_on_both_ends(spark):
    cues = spark.createDataFrame(
        [(1, 0, "a", "0", "1"), (1, 1, "b", "1", "1.05"), (1, 2, "c", "90", "99"), (2, 0, "z", "0", "9")],
        "reel_id bigint, cue_idx bigint, text string, start_raw string, end_raw string",
    )
    reel = spark.createDataFrame([(1, 2.0)], "reel_id bigint, seconds double")
    got = rows(captions.cue_frame_overlay(cues, reel), "cue_idx", "frame_idx")
    assert [(f, c) for _, f, c in got] == [(f, 0) for f in range(25)] + [(24, 1), (25, 1)]


def test_all_cues_count_unless_capped(spark):
    cues = spark.createDataFrame(
        [(1, i, f"c{i}", "0", "0.01") for i in range(300)], "reel_id bigint, cue_idx bigint, text string, start_raw string, end_raw string"
    )
    reel = spark.createDataFrame([(1, 2.0)], "reel_id bigint, seconds double")
    assert captions.cue_frame_overlay(cues, reel).count() == 300 and captions.cue_frame_overlay(cues, reel, cap=200).count() == 200


def test_caption_outcome_and_size(spark):
    cues = spark.createDataFrame(
        [(1, 0, "a", "0", "1"), (1, 1, " ", "0", "1"), (2, 0, "b", "x", "1")],
        "reel_id bigint, cue_idx bigint, text string, start_raw string, end_raw string",
    )
    assert rows(captions.caption_outcome(cues)) == [(1, True, None), (2, False, "no usable cues")]
    sized = lambda size: captions.cue_font_size(
        cues, spark.createDataFrame([(1, 1080, 1920, size)], "video_id bigint, width int, height int, size_name string")
    )
    assert [rows(sized(s))[0][2] for s in ("small", "XLARGE", None)] == [27, 54, 34]


def test_overlay_plan_has_no_range_join(spark, data):
    from clipquarry.queries import QUERIES

    for name in ("cue_frame_overlay", "word_shot_alignment", "near_duplicates", "phash_compare"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_frames_are_hashed_once(spark, data):
    """Every use of the hashes reads the same shuffle."""
    from clipquarry.queries import QUERIES

    for name in ("near_duplicates", "phash_compare"):
        df = QUERIES[name](spark, data)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("EvalPython") == 1, name


def test_cap_shuffles_nothing_again(spark, data):
    """The rank limit runs where the rows were numbered; on another table it runs before the shuffle too."""
    from clipquarry.queries import QUERIES

    plan = QUERIES["cap_per_group"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == plan.count("Exchange hashpartitioning") == 4
    capped = captions.first_per_group(spark.range(9).selectExpr("id % 2 as k", "id"), ["k"], ["id"], 2)
    assert capped._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


# --- Reels ---


def shots(spark, *items):
    return spark.createDataFrame(
        [(1, i, *x) for i, x in enumerate(items)],
        "reel_id bigint, shot_idx bigint, url string, kind string, seconds double, start_at double, fetched boolean",
    )


def test_failed_shot_moves_later_ones_earlier(spark):
    df = shots(spark, ("u", "still", 2.0, None, True), ("u", "video", 3.0, 70.0, False), (None, "still", 1.0, 0.0, True), ("u", "still", 0.0, 5.0, True), ("u", "still", 99.0, -5.0, True))
    got = rows(reels.shot_timeline(df).select("shot_idx", "seconds", "start_at", "start_s", "end_s"))
    assert got == [(0, 2.0, 0.0, 0.0, 2.0), (3, 1.0, 5.0, 2.0, 3.0), (4, 10.0, 0.0, 3.0, 13.0)]
    assert rows(reels.failed_shots(df)) == [(1, 1, "u")]
    assert rows(reels.reel_summary(*reel_inputs(spark, df, [(1, "", None)]))) == [(1, 4, 3, 13.0, "ok", False, False, None)]


def reel_inputs(spark, df, voices, ids=(1,), cues=()):
    return (
        spark.createDataFrame([(i,) for i in ids], "reel_id bigint"),
        df,
        spark.createDataFrame(voices, "reel_id bigint, audio_url string, delay_raw double"),
        spark.createDataFrame(list(cues), "reel_id bigint, cue_idx bigint, text string, start_raw string, end_raw string"),
    )


def test_refused_reels_are_rows_and_are_not_processed(spark):
    df = shots(spark, ("u", "still", 1.0, None, True), ("u", "still", 1.0, None, False))
    inputs = reel_inputs(spark, df, [(1, "a", None)], ids=(1, 2), cues=[(1, 0, "x", "0", "1")])
    assert rows(reels.reel_summary(*inputs)) == [(1, 2, 1, 1.0, "too_few_prepared", True, False, None), (2, 0, 0, 0.0, "too_few_requested", False, False, None)]
    assert reels.shot_timeline(df).count() == 0
    heard = rows(reels.word_shot_alignment(words(spark, ("a", 0.0, 0.1)), df, inputs[2]).select("word", "heard"))
    assert heard == [("a", False)]
    sources = rows(reels.valid_sources(inputs[0], df))
    assert sources == [(1, 0, "u", 2, True), (1, 1, "u", 2, True), (2, None, None, 0, False)]


def test_captions_of_accepted_reels(spark):
    df = shots(spark, ("u", "still", 1.0, None, True), ("u", "still", 1.0, None, True))
    burned = rows(reels.reel_summary(*reel_inputs(spark, df, [], cues=[(1, 0, "x", "0", "1")])))
    failed = rows(reels.reel_summary(*reel_inputs(spark, df, [], cues=[(1, 0, " ", "0", "1")])))
    assert burned[0][6:] == (True, None) and failed[0][6:] == (False, "no usable cues")


def test_caps_are_off_unless_asked_for_and_come_after_the_filter(spark):
    df = shots(spark, *[(None if i % 2 else f"u{i}", "still", 1.0, None, True) for i in range(120)])
    asked = spark.createDataFrame([(1,)], "reel_id bigint")
    assert reels.shot_timeline(df).count() == 60 and reels.shot_timeline(df, cap=40).count() == 40
    assert reels.stitch_order(asked, df).count() == 60
    sources = rows(reels.stitch_order(asked, df, cap=6))
    assert [(o, u, n) for _, o, u, n in sources] == [(i + 1, f"u{2 * i}", 6) for i in range(6)]


def test_words_past_the_picture_are_cut(spark):
    df = shots(spark, ("u", "still", 1.0, None, True), ("u", "still", 1.0, None, True))
    spoken = words(spark, ("a", 0.0, 0.1), ("b", 0.5, 0.6), ("c", 1.4, 1.5), ("d", 1.5, 2.0))
    voices = spark.createDataFrame([(1, "a", 0.5)], "reel_id bigint, audio_url string, delay_raw double")
    got = rows(reels.word_shot_alignment(spoken, df, voices).select("word", "shot_idx", "heard"))
    assert got == [("a", 0, True), ("b", 1, True), ("c", 1, True), ("d", None, False)]


def test_long_reels_are_aligned_across_tens_of_seconds(spark):
    df = shots(spark, *[("u", "video", 7.0, None, True) for _ in range(60)])
    spoken = words(spark, *[(f"w{i}", i * 3.5, i * 3.5 + 1) for i in range(130)])
    voices = spark.createDataFrame([], "reel_id bigint, audio_url string, delay_raw double")
    got = rows(reels.word_shot_alignment(spoken, df, voices).select("word_idx", "shot_idx"))
    assert got == [(i, i // 2 if i < 120 else None) for i in range(130)]


# --- Detections ---


def test_largest_box_and_ties(spark):
    frames = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False)], "frame_id bigint, job_id bigint, readable boolean")
    boxes = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 4.0, 1.0), (1, 1, 0.0, 0.0, 2.0, 2.0), (3, 0, 0.0, 0.0, 2.0, 2.0)],
        "frame_id bigint, det_idx bigint, x1 double, y1 double, x2 double, y2 double",
    )
    got = rows(detections.largest_detection(frames, boxes), "frame_id")
    assert got == [(1, 3, 1, 0.0, 0.0, 2.0, 2.0), (2, 0, None, None, None, None, None), (3, 0, None, None, None, None, None)]
    assert rows(detections.detection_coverage(frames, boxes)) == [(1, 3, 1, 0.333333)]


@pytest.mark.parametrize("total", [1, 19, 20, 21, 40, 5000])
def test_progress_marks(spark, total):
    frames = spark.range(total).select(F.col("id").alias("frame_id"), F.lit(1).alias("job_id"), (F.col("id") != 39).alias("readable"))
    got = [r.done for r in detections.progress_marks(frames).orderBy("done").collect()]
    assert got == [i for i in range(1, total + 1) if (i % 20 == 0 or i == total) and i != 40]


def test_numbers_are_folded_by_hashing(spark, data):
    from clipquarry.queries import QUERIES

    for name in ("largest_detection", "job_latest_state", "known_jobs", "artifact_dedup"):
        assert "SortAggregate" not in QUERIES[name](spark, data)._jdf.queryExecution().sparkPlan().toString(), name


def test_entry_order_is_that_of_its_parts(spark):
    entries = [("2024-01-01 00:00:00.000001", 5, "done"), ("2024-01-01 00:00:00.000001", 4, "error"), ("1969-12-31 23:59:59", 2**62, "odd")]
    df = spark.createDataFrame(entries, "t string, event_id bigint, step string").withColumn("created_at", F.col("t").cast("timestamp"))
    df = df.withColumn("order", jobs.entry_order(F.col("created_at"), F.col("event_id"), F.col("step")))
    back = df.orderBy("order").select(*[c.alias(n) for n, c in jobs.ordered_entry(F.col("order")).items()], "t")
    got = [(r.event_id, r.step, str(r.created_at) == r.t) for r in back.collect()]
    assert got == [(2**62, None, True), (4, "error", True), (5, "done", True)]


def test_any_step_and_entries_without_event_come_back(spark):
    entries = [("a", 1, 1, "queued"), ("a", 2, 2, "paused"), ("b", 1, None, "waiting"), ("c", 3, None, "done"), ("c", 3, 0, "odd"), ("d", 1, 1, None)]
    df = spark.createDataFrame(entries, "job_id string, at int, event_id bigint, step string")
    df = df.withColumn("created_at", F.timestamp_seconds("at"))
    got = rows(jobs.latest_state(df).select("job_id", "step", "status", "events"), "job_id")
    assert got == [("a", "paused", "processing", 2), ("b", "waiting", "processing", 1), ("c", "odd", "processing", 2), ("d", None, "processing", 1)]
    first = rows(jobs.first_registrations(df, "job_id").select("job_id", "event_id", "step"), "job_id")
    assert first == [("a", 1, "queued"), ("b", None, "waiting"), ("c", None, "done"), ("d", 1, None)]


# --- Hashes ---


def _slow_hash(gray):
    """Definition of the hash, term by term."""
    cos = [[np.cos((2 * x + 1) * u * np.pi / 64) for x in range(32)] for u in range(8)]
    rows_ = []
    for y in range(32):
        line = []
        for u in range(8):
            s = 0.0
            for x in range(32):
                s += float(gray[y * 32 + x]) * cos[u][x]
            line.append(s)
        rows_.append(line)
    coefs = []
    for u in range(8):
        for v in range(8):
            s = 0.0
            for y in range(32):
                s += rows_[y][v] * cos[u][y]
            coefs.append(s)
    ac = sorted(coefs[1:])
    middle = (ac[30] + ac[31]) / 2
    value = sum(1 << (63 - i) for i in range(64) if coefs[i] > middle)
    return value - 2**64 if value >= 2**63 else value


def test_hash_equals_its_definition():
    rng = np.random.default_rng(5)
    frames = np.vstack([rng.integers(0, 256, (6, 1024)), np.zeros((1, 1024)), np.full((1, 1024), 200), np.tile(np.arange(32) * 8, (1, 32))])
    assert phash.hash_frames(frames).tolist() == [_slow_hash(f) for f in frames]


def test_bad_frames_have_no_hash(spark):
    ramp = list(range(1024))
    frames = [(1, ramp), (2, [1] * 10), (3, None), (4, [None, *ramp[1:]]), (5, ramp), (6, [])]
    df = spark.createDataFrame(frames, "n int, gray array<int>").coalesce(1)
    got = dict(rows(df.select("n", phash.phash64("gray"))))
    assert got[1] == got[5] == _slow_hash(ramp) and [got[n] for n in (2, 3, 4, 6)] == [None] * 4


def test_brightness_does_not_move_the_hash(spark, data):
    from clipquarry.queries import QUERIES

    hashed = QUERIES["phash64"](spark, data)
    assert hashed.filter("bit_count(phash) <> 33").count() == 0
    kinds = hashed.filter("clip_id % 3 < 2").groupBy(F.expr("clip_id div 3"), "frame_idx").agg(F.count_distinct("phash").alias("n"))
    assert kinds.filter("n <> 1").count() == 0


@pytest.mark.parametrize("mean,want", [(10.0, "would still match"), (10.01, "borderline"), (20.0, "borderline"), (20.1, "likely distinct"), (None, None)])
def test_verdict_bands(spark, mean, want):
    df = spark.createDataFrame([(mean,)], "m double")
    assert df.select(phash.match_verdict(F.col("m"))).first()[0] == want


def _clips(spark, clips):
    return spark.createDataFrame(
        [(c, f, h) for c, hs in clips.items() for f, h in enumerate(hs)], "clip_id bigint, frame_idx int, phash bigint"
    )


def test_compare_pairs_up_to_the_shorter_clip(spark):
    df = _clips(spark, {1: [0, 0, 0], 2: [7, -1], 3: [0] * 12})
    requests = spark.createDataFrame([(1, [1, 2, 3, 9]), (9, [1])], "base_id bigint, candidates array<bigint>")
    got = rows(hashes.phash_compare(requests, df), "base_id", "index")
    assert [r[3:7] for r in got[:4]] == [(3, 3, 0.0, 0), (3, 2, 33.5, 64), (3, 3, 0.0, 0), (3, None, None, None)]
    assert [r[9] for r in got] == [None, None, None, "No frames hashed", "No frames hashed"] and got[4][3] == 0
    assert got[0][8] == phash.DETAILS["would still match"] and got[3][8] is None


def test_all_candidates_count_unless_capped(spark):
    requests = spark.createDataFrame([(1, list(range(100, 115)))], "base_id bigint, candidates array<bigint>")
    assert rows(hashes.candidate_pairs(requests)) == [(1, i + 1, 100 + i) for i in range(15)]
    assert rows(hashes.candidate_pairs(requests, cap=10)) == [(1, i + 1, 100 + i) for i in range(10)]


def test_long_clips_are_compared_to_the_end(spark):
    """Equal in twelve frames and opposite in eight: no copies."""
    df = _clips(spark, {1: [0] * 20, 2: [0] * 12 + [-1] * 8})
    requests = spark.createDataFrame([(1, [2])], "base_id bigint, candidates array<bigint>")
    got = rows(hashes.phash_compare(requests, df))[0]
    assert got[4:8] == (20, 25.6, 64, "likely distinct")
    assert [r[1:4] for r in rows(hashes.near_duplicates(df))] == [(1, 0, 0), (1, 0, 0)]


def _brute_force(clips, threshold):
    groups = {}
    for clip, hs in sorted(clips.items()):
        groups.setdefault(tuple(hs), []).append(clip)
    out = []
    for a, ids in groups.items():
        near = []
        for b, others in groups.items():
            if a != b:
                ds = [bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b)]
                if sum(ds) <= threshold * len(ds):
                    near.append((sum(ds) / len(ds), others[0], len(others)))
        best = min(near) if near else (None, None)
        out.append((ids[0], len(ids), len(near), sum(n[2] for n in near), best[1], None if best[0] is None else round(best[0], 6)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0, 3, 4, 10, 13, 17])
@pytest.mark.parametrize("heavy_rows,band_bits", [(5, 16), (10_000, 16), (5, 24), (10_000, 13)])
def test_near_duplicates_equal_brute_force(spark, threshold, heavy_rows, band_bits):
    """Random clips of up to fifteen frames, edited copies at all distances, exact copies and a frame all share."""
    rng = np.random.default_rng(threshold)

    def flipped(h, n):
        for bit in rng.choice(64, n, replace=False):
            h ^= 1 << int(bit)
        return h

    clips = {}
    for i in range(12):
        frames = [0 if f == 0 else int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2)) for f in range(int(rng.integers(1, 16)))]
        clips[len(clips)] = frames
        clips[len(clips)] = list(frames)
        for _ in range(4):
            clips[len(clips)] = [flipped(h, int(rng.integers(0, 2 * threshold + 2))) for h in frames]
    signed = {c: [h - 2**64 if h >= 2**63 else h for h in hs] for c, hs in clips.items()}
    got = hashes.near_duplicates(_clips(spark, signed), threshold, band_bits, heavy_rows)
    assert rows(got, "clip_id") == _brute_force(signed, threshold)


@pytest.mark.parametrize("rate", [24, 30, 7])
def test_overlay_runs_expand_to_the_overlay(spark, rate):
    rng = np.random.default_rng(rate)
    cues, reels_ = [], []
    for reel in range(12):
        reels_.append((reel, float(rng.integers(0, 200)) / 10))
        for cue in range(int(rng.integers(0, 14))):
            start = round(float(rng.integers(-10, 180)) / 12, 3)
            length = rng.choice([0.001, 0.5, 1 / 24, 1 / 7, 3.0, 0.0])
            cues.append((reel, cue, rng.choice(["hi", "hi", " "]), str(start), str(round(start + length, 3))))
    cues += [(99, 0, "no reel", "0", "5"), (3, 50, "null start", None, "1")]
    df = spark.createDataFrame(cues, "reel_id int, cue_idx int, text string, start_raw string, end_raw string")
    lengths = spark.createDataFrame(reels_, "reel_id int, seconds double")
    frames = {}
    for reel, frame, cue in rows(captions.cue_frame_overlay(df, lengths, rate).select("reel_id", "frame_idx", "cue_idx")):
        frames.setdefault((reel, frame), []).append(cue)
    runs = rows(captions.cue_overlay_runs(df, lengths, rate))
    opened = {(reel, f): sorted(map(int, shown.split(","))) for reel, first, last, shown in runs for f in range(first, last + 1)}
    assert opened == {k: sorted(v) for k, v in frames.items()} and frames
    assert sum(last - first + 1 for _, first, last, _ in runs) == len(frames)  # runs do not overlap
    assert all(not (a[0] == b[0] and a[2] + 1 == b[1] and a[3] == b[3]) for a in runs for b in runs)  # and are as long as they can be


def test_voice_over_fit(spark):
    shots = [(r, i, f"u{i}", "video", 4.0, 0.0, True) for r in (1, 2, 3, 4) for i in range(2)] + [(5, 0, "u", "video", 4.0, 0.0, True)]
    shots = spark.createDataFrame(shots, "reel_id bigint, shot_idx int, url string, kind string, seconds double, start_at double, fetched boolean")
    voices = [(1, "v", None), (2, "v", 6.0), (3, "v", 20.0), (4, "", None), (5, "v", None)]
    voices = spark.createDataFrame(voices, "reel_id bigint, audio_url string, delay_raw double")
    said = [("a", 0.5, 1.0), ("b", 0.8, 1.5), ("c", 1.75, 1.8), (" ", 5.0, 30.0), ("d", 3.0, 3.0)]
    words = spark.createDataFrame(
        [(r, i, *w) for r in (1, 2, 9) for i, w in enumerate(said)], "video_id bigint, word_idx int, word string, start_s double, end_s double"
    )
    got = rows(reels.voice_over_fit(words, shots, voices))
    assert got == [
        (1, 8.0, 0.0, 3.0, 5.0, 0.0, 4, 0, 0, 2, 1.05, 5.0),
        (2, 8.0, 6.0, 9.0, 0.0, 1.0, 4, 1, 0, 1, 1.05, 6.5),
        (3, 8.0, 15.0, 15.0, 0.0, 7.0, 0, 0, 0, 0, 0.0, 8.0),
    ]


@pytest.mark.parametrize("threshold, band_bits", [(4, 16), (10, 16), (20, 16)])
def test_common_frames_lose_no_near_pair(spark, threshold, band_bits):
    """Clips of one to nine frames of which up to all are shared by many, with copies near and far in the frames that are not."""
    rng = np.random.default_rng(threshold + 1)
    shared = [0, -1, 0x5555555555555555, 0x00FF00FF00FF00FF]
    clips = {}
    for i in range(20):
        size = int(rng.integers(1, 10))
        base = [shared[int(rng.integers(0, 4))] if rng.random() < 0.45 else int(rng.integers(-(2**63), 2**63 - 1)) for _ in range(size)]
        clips[len(clips)] = base
        for _ in range(3):
            copy = []
            for h in base:
                bits = rng.choice(64, int(rng.integers(0, 3 * threshold)), replace=False) if rng.random() < 0.5 else []
                for bit in bits:
                    h ^= (1 << int(bit)) if bit < 63 else -(2**63)
                copy.append(h)
            clips[len(clips)] = copy[: int(rng.integers(1, size + 1))]
    df = _clips(spark, clips)
    wanted = _brute_force(clips, threshold)
    for common_rows, heavy_rows in ((3, 10_000), (5, 6)):
        got = hashes.near_duplicates(df, threshold, band_bits, heavy_rows, common_rows)
        assert rows(got, "clip_id") == wanted


def test_one_shared_frame_brings_nobody_together(spark):
    """A hundred thousand clips that open with the same black frame, and one true copy."""
    count = 100_000
    made = [F.lit(0).cast("bigint"), *[F.xxhash64("id", F.lit(k)) for k in range(5)]]
    clips = spark.range(count).select(F.col("id").alias("clip_id"), F.array(*made).alias("signature"), F.lit(1).cast("bigint").alias("copies"))
    near = clips.filter("clip_id = 77").select(F.lit(count).cast("bigint").alias("clip_id"), F.expr("transform(signature, (h, i) -> if(i = 3, h ^ 5, h))").alias("signature"), "copies")
    groups = clips.unionByName(near)
    met = hashes._candidates(groups, 3, 16, hashes.HEAVY_ROWS, hashes.COMMON_ROWS)
    assert [tuple(r) for r in met.collect()] == [(77, count)]
    frames = spark.range(40).select(F.col("id").alias("clip_id"), F.array(*made).alias("signature"), F.lit(1).cast("bigint").alias("copies"))
    assert hashes._candidates(frames, 3, 16, 10_000, 10_000).count() == 40 * 39 // 2  # what a shared frame does where it is looked up


def test_every_copy_and_every_near_partner_is_named(spark):
    """Copies beside the smallest clip, and partners beside the nearest, whether or not the signature is salted."""
    clips = {n: [5, 9] for n in range(20, 40)} | {3: [5, 9], 50: [4, 9], 51: [4, 9], 60: [7, 9], 70: [-1, -1], 80: []}
    df = _clips(spark, clips)
    classes = {n: 3 for n in (3, *range(20, 40))} | {50: 50, 51: 50, 60: 60, 70: 70}
    sizes = {3: 21, 50: 2, 60: 1, 70: 1}
    for heavy_rows in (5, 10_000):
        got = rows(hashes.near_duplicate_members(df, heavy_rows), "clip_id")
        assert got == [(n, c, sizes[c]) for n, c in sorted(classes.items())]
        pairs = rows(hashes.near_duplicate_pairs(df, 4, heavy_rows=heavy_rows), "class_id", "other_id")
        assert pairs == [(3, 50, 0.5), (3, 60, 0.5), (50, 60, 1.0)]


# --- Plans ---


def test_dense_plan_stays_in_the_clip(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 0.05), (4, 7.3), (5, 599.9)], "video_id bigint, probe_duration double")
    counts = dict(rows(sampling.dense(df).groupBy("video_id").count()))
    assert counts == {1: 80, 2: 80, 3: 1, 4: 58, 5: 80}


def test_hook_stops_at_the_end(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 2.0), (3, 9.0)], "video_id bigint, probe_duration double")
    assert rows(sampling.hook(df).groupBy("video_id").count()) == [(2, 2), (3, 4)]


def test_fixed_rate_names(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 500.0)], "video_id bigint, s double")
    got = sampling.fixed_rate(df, F.col("s"))
    assert got.filter("video_id = 1").select("name").collect() == [("frame_0001.jpg",), ("frame_0002.jpg",)]
    assert got.filter("video_id = 2").count() == 12000 and got.agg(F.max(F.length("name"))).first()[0] == 15


# --- Registries and profiles ---


def test_profile_levels(spark):
    df = spark.createDataFrame(
        [(1, "car", False, None), (2, "car", True, None), (3, "car", True, "x"), (4, None, True, "-3"), (5, "studio", True, "-3")],
        "n int, profile string, has_level boolean, level_raw string",
    )
    got = rows(profiles.profile_lookup(df, profiles.profile_table(spark)).select("n", "profile", "level_db"), "n")
    assert got == [(1, "car", -26.0), (2, "car", 0.0), (3, "car", -26.0), (4, "room", -3.0), (5, "studio", None)]


def test_expiry_is_strict(spark):
    df = spark.sql(
        "select * from values ('a', timestamp'2024-01-01 00:00:00'), ('b', timestamp'2024-01-01 00:00:00.001'), "
        "('c', timestamp'2023-12-31 23:59:59.999'), ('z', timestamp'2024-01-01 00:40:00') t(k, created_at)"
    )
    got = rows(jobs.entry_expiry(df, "k", "30 minutes").select("k", "expired"))
    assert got == [("a", False), ("b", False), ("c", True), ("z", False)]


def test_frame_files_are_not_formatted_one_by_one(spark):
    at = [None, -1, -3, *range(12_000), 123_456]
    named = spark.createDataFrame([(i,) for i in at], "i bigint").select("i", sampling.frame_file(F.col("i")).alias("name"))
    other = {None: None, -1: "frame_0000.jpg", -3: "frame_00-2.jpg"}
    assert {r.i: r.name for r in named.collect()} == {i: other[i] if i in other else f"frame_{i + 1:04d}.jpg" for i in at}
    assert "[00,01,02" in named._jdf.queryExecution().optimizedPlan().toString()
