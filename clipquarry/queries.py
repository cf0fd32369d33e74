"""Every operator as a query over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry import fixtures as fx
from clipquarry.functions import draws, geometry, routing, text
from clipquarry.functions import phash as hashing
from clipquarry.functions.semantics import int_param, round_digits, round_half_up, utc_wall_time
from clipquarry.operators import captions, detections, hashes, hashindex, jobs, profiles, reels, registry, speech
from clipquarry.operators.links import landed
from clipquarry.plans import sampling
from clipquarry.session import bounded_batches
from clipquarry.sources import media, requests, runs, sinks
from clipquarry.sources.tables import events, table

Query = Callable[[SparkSession, str], DataFrame]

CLOSING = "Describe the clip."
ROW_CAPS = {"sources": 6, "candidates": 10, "shots": 40, "cues": 200}
LANE_LAYERS = {"AUTHENTIC": "Handheld phone look.", "HIGH-END": "Cinema camera look."}
LANE_SUFFIX = "Keep the setting."
SAMPLE_SEED = "run"
SAMPLE_SHARE = 0.1
SESSION_GAP_MINUTES = 30

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants as UTC wall times, like the tables store them."""
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, utc_wall_time(F.col(name)))
    return df


# --- Scans, sources, sinks ---


@query
def scan_requests(spark, root):
    body = F.expr(
        "case when req_id % 10 = 3 then '{\"videoUrl\": ' "
        "when req_id % 11 = 0 then concat('{\"frames\":\"', coalesce(raw, ''), '\"}') "
        "when raw is null then concat('{\"videoUrl\":\"v', req_id, '\",\"frames\":null}') "
        "else concat('{\"videoUrl\":\"v', req_id, '\",\"frames\":\"', raw, '\"}') end"
    )
    return requests.scan_requests(fx.params(spark, root).select("req_id", body.alias("body")))


def _responses(spark, root):
    """One transcription response per document, its words spoken at a steady pace."""
    body = F.expr(
        "to_json(named_struct('text', text, 'words', transform(split(text, ' '), (w, i) -> "
        "named_struct('word', w, 'start', i * 0.4e0, 'end', i * 0.4e0 + 0.3e0))))"
    )
    return table(spark, root, "documents").select(F.col("doc_id").alias("response_id"), body.alias("body"))


@query
def scan_transcripts(spark, root):
    return requests.transcript_words(requests.scan_transcripts(_responses(spark, root)))


@query
def probe_video_stream(spark, root):
    audio = "named_struct('codec_type', 'audio', 'width', cast(null as int), 'height', cast(null as int))"
    video = "named_struct('codec_type', 'video', 'width', width, 'height', height)"
    second = "named_struct('codec_type', 'video', 'width', 1, 'height', 1)"
    streams = F.expr(
        f"case video_id % 4 when 0 then array({audio}, {video}) when 1 then array({video}) "
        f"when 2 then array({audio}) else array({video}, {second}) end"
    )
    return requests.probe_video_stream(fx.videos(spark, root).select("video_id", streams.alias("streams")))


@query
def sink_results(spark, root):
    seconds = round_digits(sampling.clip_seconds(F.col("probe_duration")), 1).alias("durationSec")
    envelope = sinks.result_envelope(F.col("probe_duration").isNotNull(), [seconds, F.col("width")], F.lit("probe failed"))
    return fx.videos(spark, root).select("video_id", envelope.alias("envelope"))


@query
def sink_runs(spark, root):
    """All clips' results, then those that failed again, a repeated run, a run that stops before it is published, and a compaction."""
    folder = runs.scratch_folder(spark, "sink_runs")
    state = F.when(F.col("probe_duration").isNull(), "failed").otherwise("ok").alias("state")
    result = lambda text: F.concat_ws(" ", F.lit(text), "probe_duration").alias("result")
    clips = fx.videos(spark, root)
    first = clips.select("video_id", state, result("first"))
    again = clips.filter(F.col("probe_duration").isNull()).select("video_id", state, result("again"))
    runs.commit_run(first, 1, folder, "state")
    runs.commit_run(again, 2, folder, "state")
    runs.commit_run(clips.select("video_id", state, result("repeated")), 2, folder, "state")
    runs.stage_run(clips.select("video_id", state, result("stopped")), folder, "state")
    runs.compact(spark, folder, first.schema, "state")
    return runs.read_runs(spark, folder, first.schema, "run_number")


@query
def frame_data_url(spark, root):
    return table(spark, root, "documents").select("doc_id", text.data_url(F.encode("text", "UTF-8")).alias("data_url"))


# --- Projections, filters, predicates ---


@query
def url_route(spark, root):
    return (
        fx.urls(spark, root)
        .select("page_id", routing.platform(F.col("url")).alias("platform"))
        .select(
            "page_id",
            "platform",
            routing.fetcher(F.col("platform")).alias("fetcher"),
            routing.hosting_fetcher(F.col("platform")).alias("hosting_fetcher"),
        )
    )


@query
def payload_guard(spark, root):
    source = routing.platform(F.col("url"))
    return fx.urls(spark, root).select(
        "page_id",
        routing.analysis_reject_reason(source, F.col("content_type"), F.col("head"), F.col("bytes")).alias("analysis_reject"),
        routing.audio_reject_reason(source, F.col("bytes")).alias("audio_reject"),
        routing.speech_track_state(F.col("bytes")).alias("speech_track"),
        routing.extracted_track_state(F.col("bytes")).alias("extracted_track"),
        routing.timing_track_state(F.col("bytes")).alias("timing_track"),
    )


@query
def fetch_error_reason(spark, root):
    reason = routing.fetch_error_reason(F.col("error"), F.col("error_description"))
    return (
        fx.fetch_errors(spark, root)
        .select("event_id", reason.alias("reason"))
        .withColumn("message", routing.fetch_error_message(F.col("reason")))
    )


@query
def speech_segments(spark, root):
    return speech.speech_segments(fx.segments(spark, root)).select("video_id", "seg_idx", "text")


@query
def word_normalize(spark, root):
    return speech.word_normalize(fx.words(spark, root))


@query
def usable_cues_strict(spark, root):
    return captions.usable_chunks(fx.words(spark, root))


@query
def usable_cues_coerced(spark, root):
    return captions.usable_cues(fx.cues(spark, root))


@query
def valid_sources(spark, root):
    return reels.valid_sources(fx.reel_requests(spark, root), fx.shots(spark, root))


def _hashes(spark, root, parts=None):
    return hashes.hash_frames(fx.edited_frames(bounded_batches(spark), root, parts)).select("clip_id", "frame_idx", "phash")


def _compare_requests(spark, root):
    """Each clip against its own edits and against the nine clips after it."""
    clips = fx.gray_frames(spark, root).select("video_id").distinct()
    candidates = F.expr(
        "concat(array(video_id * 3, video_id * 3 + 1, video_id * 3 + 2), "
        "transform(sequence(1, 9), k -> (video_id + k) * 3))"
    )
    return clips.select(F.expr("video_id * 3").alias("base_id"), candidates.alias("candidates"))


def _distances(spark, root):
    return hashes.phash_distances(_compare_requests(spark, root), _hashes(spark, root))


@query
def match_verdict(spark, root):
    judged = _distances(spark, root).select("base_id", "index", hashing.match_verdict(F.col("mean_distance")).alias("verdict"))
    return judged.withColumn("detail", hashing.verdict_detail(F.col("verdict")))


# --- Frame-sampling plans ---


@query
def plan_dense(spark, root):
    return sampling.dense(fx.videos(spark, root))


@query
def plan_picker(spark, root):
    return sampling.picker(fx.videos(spark, root))


@query
def plan_vision_cap(spark, root):
    return sampling.vision_cap(fx.videos(spark, root))


@query
def plan_hook(spark, root):
    return sampling.hook(fx.videos(spark, root))


@query
def plan_opening(spark, root):
    return sampling.opening(fx.videos(spark, root))


def _plan_requests(spark, root):
    """Request parameters with the probe of the clip of the same number; other clips could not be probed."""
    probes = fx.videos(spark, root).select(F.col("video_id").alias("req_id"), "probe_duration")
    return fx.params(spark, root).join(probes, "req_id", "left")


@query
def plan_interior(spark, root):
    return sampling.interior(_plan_requests(spark, root))


@query
def plan_hash(spark, root):
    return sampling.hash_schedule(_plan_requests(spark, root))


@query
def plan_fixed_rate(spark, root):
    """All frames of all clips, then figures per clip that every one of its frames goes into."""
    clips = fx.videos(spark, root).select("video_id", sampling.clip_seconds(F.col("probe_duration")).alias("seconds"))
    # A clip becomes thousands of frames, so clips are dealt out first; the figures then need no further shuffle.
    clips = clips.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id")
    # Names have one byte a character; bytes need no counting.
    number = F.expr("cast(substring(name, 7, octet_length(name) - 10) as bigint)")
    return (
        sampling.fixed_rate(clips, F.col("seconds"))
        .groupBy("video_id")
        .agg(
            F.count("*").alias("frames"),
            F.sum("i").alias("index_sum"),
            F.round(F.sum("ts"), 3).alias("ts_sum"),
            F.max("ts").alias("last_ts"),
            F.sum(number).alias("name_sum"),
            F.sum(F.octet_length("name")).alias("name_length"),
        )
    )


@query
def plan_still_zoom(spark, root):
    """All frames of all stills, then figures per shot that every one of its frames goes into."""
    stills = fx.shots(spark, root).filter("kind = 'still' and url is not null").select(
        "reel_id", "shot_idx", reels.shot_seconds(F.col("seconds")).alias("seconds")
    )
    return (
        sampling.still_zoom(stills, F.col("seconds"))
        .groupBy("reel_id", "shot_idx")
        .agg(
            F.count("*").alias("frames"),
            F.sum("i").alias("index_sum"),
            F.round(F.sum("zoom"), 6).alias("zoom_sum"),
            F.round(F.sum(F.col("zoom") * F.col("i")), 4).alias("zoom_moment"),
            F.round(F.min("zoom"), 6).alias("first_zoom"),
            F.round(F.max("zoom"), 6).alias("last_zoom"),
        )
    )


# --- Scalar functions ---


@query
def param_clamp(spark, root):
    raw = F.col("raw")
    return fx.params(spark, root).select(
        "req_id",
        sampling.frame_count_param(raw).alias("frames"),
        int_param(raw, 60, 5, 120).alias("audio_seconds"),
        sampling.hash_count_param(raw).alias("hash_frames"),
        int_param(raw, 3, 1, 10).alias("copies"),
    )


@query
def shot_clamp(spark, root):
    return fx.shots(spark, root).select(
        "reel_id",
        "shot_idx",
        reels.shot_seconds(F.col("seconds")).alias("seconds"),
        reels.shot_start(F.col("start_at")).alias("start_at"),
        reels.voice_delay(F.col("start_at")).alias("delay"),
    )


@query
def output_canvas(spark, root):
    width, height = F.col("width"), F.col("height")
    stitch, reel = geometry.stitch_canvas(width, height), geometry.reel_canvas(width, height)
    return fx.videos(spark, root).select(
        "video_id", stitch[0].alias("stitch_w"), stitch[1].alias("stitch_h"), reel[0].alias("reel_w"), reel[1].alias("reel_h")
    )


@query
def letterbox_geometry(spark, root):
    parts = geometry.letterbox(F.col("width"), F.col("height"), F.lit(geometry.CANVAS_W), F.lit(geometry.CANVAS_H))
    return fx.videos(spark, root).select("video_id", *[c.alias(name) for name, c in parts.items()])


@query
def caption_style(spark, root):
    """Style requests in mixed case, with missing and unknown names."""
    asked = fx.videos(spark, root).select(
        "video_id",
        F.expr("coalesce(nullif(height, 0), 1920)").alias("height"),
        "size_name",
        F.expr("case video_id % 4 when 0 then 'middle' when 1 then 'Bottom' when 2 then 'lower' else null end").alias("position"),
        F.expr(
            "case video_id % 5 when 0 then 'Strong' when 1 then 'clean' when 2 then 'TypeWriter' when 3 then null else 'comic' end"
        ).alias("font"),
    )
    return asked.select(
        "video_id",
        geometry.caption_ratio(F.col("size_name")).alias("ratio"),
        geometry.caption_position(F.col("position")).alias("position"),
        F.round(geometry.caption_margin(F.col("position"), F.col("height")), 6).alias("margin"),
        geometry.caption_font(F.col("font")).alias("font"),
    )


@query
def caption_font_size(spark, root):
    clips = fx.videos(spark, root)
    chunks = captions.chunk_font_size(fx.words(spark, root), clips).withColumn("source", F.lit("chunks"))
    cues = captions.cue_font_size(fx.cues(spark, root), clips).withColumn("source", F.lit("cues"))
    return chunks.unionByName(cues)


@query
def meta_sanitize(spark, root):
    return fx.metadata(spark, root).select("video_id", "key", text.clean_metadata_value(F.col("value")).alias("clean"))


@query
def meta_allowlist(spark, root):
    pairs = F.create_map(F.col("key"), F.col("value"), F.lit("com.apple.quicktime.software"), F.expr("if(video_id % 2 = 0, 'v1', ' ')"))
    kept = fx.metadata(spark, root).select("video_id", text.allowed_metadata(pairs).alias("kept"))
    return kept.select(
        "video_id",
        F.size("kept").cast("bigint").alias("keys_kept"),
        *[F.try_element_at("kept", F.lit(k)).alias(k) for k in ("make", "model", "creation_time")],
        F.when(F.size("kept") == 0, "No recognised metadata keys supplied").alias("error"),
    )


@query
def llm_header_parse(spark, root):
    parts = text.parse_header(F.col("response"))
    return fx.lane_responses(spark, root).select("conv_id", "turn", *[c.alias(name) for name, c in parts.items()])


@query
def llm_sections(spark, root):
    parsed = fx.section_responses(spark, root).select("conv_id", "turn", text.parse_sections(F.col("response")).alias("s"))
    return parsed.select("conv_id", "turn", F.col("s.analysis").alias("analysis"), F.posexplode_outer("s.prompts").alias("pos", "p")).select(
        "conv_id",
        "turn",
        "analysis",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("p.id").alias("prompt_id"),
        F.col("p.label").alias("label"),
        F.col("p.text").alias("body"),
    )


@query
def prompt_compose(spark, root):
    layers = spark.createDataFrame(list(LANE_LAYERS.items()), "lane string, layer string")
    parsed = llm_header_parse(spark, root).filter("error is null")
    return parsed.join(F.broadcast(layers), "lane").select(
        "conv_id", "turn", F.concat_ws(" ", "body", "layer", F.lit(LANE_SUFFIX)).alias("prompt")
    )


@query
def error_message(spark, root):
    answer = F.expr(
        "case event_id % 3 when 0 then to_json(named_struct('error', named_struct('message', error))) "
        "when 1 then to_json(named_struct('message', error_description, 'msg', error)) end"
    )
    status = F.expr("case event_id % 4 when 0 then 404 when 1 then null when 2 then 0 else 503 end")
    return fx.fetch_errors(spark, root).select(
        "event_id",
        text.error_message(answer, F.lit("request failed")).alias("message"),
        text.error_status(status).alias("status"),
    )


@query
def text_truncate(spark, root):
    body = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id",
        text.truncated(body, text.PROMPT_MAX).alias("prompt_text"),
        text.truncated(body, text.ERROR_MAX).alias("error_text"),
        text.truncated(body, text.LOG_MAX).alias("log_text"),
    )


@query
def metadata_summary(spark, root):
    seconds = sampling.clip_seconds(F.col("probe_duration"))
    said = speech.transcript_presence(fx.segments(spark, root)).select("video_id", "has_audio")
    return fx.videos(spark, root).join(said, "video_id", "left").select(
        "video_id",
        F.concat(round_half_up(seconds).cast("string"), F.lit("s")).alias("duration"),
        round_digits(seconds, 1).alias("seconds_1"),
        round_digits(F.coalesce("probe_duration", F.lit(0.0)), 2).alias("seconds_2"),
        sampling.dense_count(F.col("probe_duration")).alias("frame_count"),
        F.coalesce("has_audio", F.lit(False)).alias("has_audio"),
    )


@query
def iso_utc_timestamp(spark, root):
    return events(spark, root).select("event_id", text.iso_utc(F.col("ts")).alias("stamp"))


@query
def artifact_key(spark, root):
    kind = F.expr(
        "case step when 'downloading' then 'room' when 'extracting_frames' then 'cap' when 'processing' then 'seq' "
        "when 'done' then 'reel' else 'stamp' end"
    )
    return fx.job_events(events(spark, root)).select(
        "event_id", text.artifact_key(kind, F.col("created_at"), F.col("event_id")).alias("artifact_key")
    )


@query
def size_delta(spark, root):
    written = table(spark, root, "part").filter("p_partkey % 11 <> 0").select(
        F.col("p_partkey").alias("video_id"), F.expr("cast(400 + (p_partkey * 7919) % 5000 + p_size * 7 as bigint)").alias("out_bytes")
    )
    read = fx.videos(spark, root).select("video_id", F.col("bytes").alias("in_bytes"))
    return read.join(written, "video_id", "left").withColumn("delta", F.col("out_bytes") - F.col("in_bytes"))


@query
def seeded_sample(spark, root):
    """A repeatable tenth of the orders: the draw of every order, and whether it is in."""
    keyed = table(spark, root, "orders").select("o_orderkey")
    draw = draws.uniform(F.lit(SAMPLE_SEED), F.col("o_orderkey"))
    return keyed.withColumn("draw", draw).withColumn("sampled", F.col("draw") < SAMPLE_SHARE)


# --- Joins ---


@query
def phash_compare(spark, root):
    return hashes.phash_compare(_compare_requests(spark, root), _hashes(spark, root))


@query
def candidate_pairs(spark, root):
    return hashes.candidate_pairs(_compare_requests(spark, root))


@query
def near_duplicates(spark, root):
    return hashes.near_duplicates(_hashes(spark, root))


@query
def near_duplicate_members(spark, root):
    return hashes.near_duplicate_members(_hashes(spark, root))


@query
def near_duplicate_pairs(spark, root):
    return hashes.near_duplicate_pairs(_hashes(spark, root))


@query
def near_duplicate_arrivals(spark, root):
    """Groups of near copies over three arrivals: each clip's group when it came, and when all have come."""
    index = hashindex.Index(spark, runs.scratch_folder(spark, "near_duplicate_arrivals"), buckets=8)
    arrival = F.expr("cast(clip_id div 2 % 3 + 1 as bigint)").alias("arrival")
    # Written once, as each arrival reads them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = landed(_hashes(spark, root, parts).select("*", arrival), "hashes")
    then = []
    for number in (1, 2, 3):
        index.arrive(hashed.filter(F.col("arrival") == number).drop("arrival"), number)
        then.append(index.groups().filter(F.expr(f"clip_id div 2 % 3 + 1 = {number}")).select("clip_id", F.col("group_id").alias("group_then")))
    return reduce(DataFrame.unionByName, then).join(index.groups(), "clip_id").select("*", arrival)


def _reel_lengths(spark, root):
    return reels.accepted_reels(fx.shots(spark, root))


@query
def cue_frame_overlay(spark, root):
    return captions.cue_frame_overlay(fx.cues(spark, root), _reel_lengths(spark, root))


@query
def cue_overlay_runs(spark, root):
    return captions.cue_overlay_runs(fx.cues(spark, root), _reel_lengths(spark, root))


@query
def voice_over_fit(spark, root):
    return reels.voice_over_fit(fx.words(spark, root), fx.shots(spark, root), fx.voices(spark, root))


@query
def word_shot_alignment(spark, root):
    return reels.word_shot_alignment(fx.words(spark, root), fx.shots(spark, root), fx.voices(spark, root))


@query
def profile_lookup(spark, root):
    """Requests with known and unknown profiles; the level is absent, null, a number or junk."""
    asked = events(spark, root).select(
        "event_id",
        F.expr(
            "case event_type when 'signup' then 'studio' when 'view' then 'car' when 'click' then 'cafe' "
            "when 'purchase' then 'gym' else 'spaceship' end"
        ).alias("profile"),
        F.expr("event_id % 5 <> 0").alias("has_level"),
        F.expr("case event_id % 5 when 1 then null when 2 then '-30' when 3 then 'loud' when 4 then ' -12.5 ' end").alias("level_raw"),
    )
    return profiles.profile_lookup(asked, profiles.profile_table(spark))


def _asked_jobs(spark, root):
    return table(spark, root, "customer").select(F.col("c_custkey").alias("job_id"))


@query
def known_jobs(spark, root):
    return jobs.known_jobs(_asked_jobs(spark, root), fx.job_events(events(spark, root)))


@query
def missing_jobs(spark, root):
    return jobs.missing_jobs(_asked_jobs(spark, root), fx.job_events(events(spark, root)))


@query
def failed_shots(spark, root):
    return reels.failed_shots(fx.shots(spark, root))


# --- Aggregations ---


@query
def transcript_assemble(spark, root):
    """Transcripts of segmented responses, and the documents as responses without segments."""
    raw = table(spark, root, "documents").select(F.expr("-1 - doc_id").alias("video_id"), "text")
    return speech.with_raw_transcripts(speech.transcript_assemble(fx.segments(spark, root)), raw)


@query
def caption_chunks(spark, root):
    return captions.caption_chunks(fx.words(spark, root))


@query
def caption_longest(spark, root):
    chunks = captions.longest_chunk(fx.words(spark, root))
    cues = captions.longest_cue(fx.cues(spark, root)).select(F.col("reel_id").alias("video_id"), F.col("longest").alias("longest_cue"))
    return chunks.join(cues, "video_id", "full")


@query
def phash64(spark, root):
    return _hashes(spark, root)


@query
def phash64_relational(spark, root):
    frames = fx.edited_frames(spark, root).select("clip_id", "frame_idx", "gray")
    return hashes.hash_frames_relational(spark, frames, ["clip_id", "frame_idx"])


@query
def phash_distance_stats(spark, root):
    stats = _distances(spark, root).drop("base_frames", "other_frames")
    return stats.withColumn("mean_distance", F.round("mean_distance", 6))


@query
def largest_detection(spark, root):
    return detections.largest_detection(fx.frames(spark, root), fx.detections(spark, root))


@query
def detection_coverage(spark, root):
    return detections.detection_coverage(fx.frames(spark, root), fx.detections(spark, root))


@query
def reel_summary(spark, root):
    return reels.reel_summary(fx.reel_requests(spark, root), fx.shots(spark, root), fx.voices(spark, root), fx.cues(spark, root))


@query
def speech_coverage(spark, root):
    return speech.speech_coverage(fx.words(spark, root), fx.videos(spark, root))


@query
def vision_request_bundle(spark, root):
    """Requests by way of the gateway, which takes few frames, and direct ones with all frames."""
    count = sampling.dense_count(F.col("probe_duration"))
    routes = F.array(
        F.struct(F.lit("gateway").alias("route"), sampling.even_sample(count, sampling.VISION_FRAMES).alias("picks")),
        F.struct(F.lit("direct").alias("route"), sampling.indexes(count).alias("picks")),
    )
    clips = (
        fx.videos(spark, root)
        .select("video_id", "brief", sampling.clip_seconds(F.col("probe_duration")).alias("seconds"), count.alias("n_frames"), F.inline(routes))
        .select(
            "video_id",
            "route",
            "n_frames",
            "seconds",
            "brief",
            F.array_join(F.col("picks").cast("array<string>"), ",").alias("frame_list"),
            sampling.vision_note(F.col("n_frames"), F.size("picks")).alias("note"),
        )
    )
    return speech.request_bundle(clips, speech.transcript_assemble(fx.segments(spark, root)), CLOSING)


# --- Window functions ---


@query
def shot_timeline(spark, root):
    return (
        reels.shot_timeline(fx.shots(spark, root))
        .withColumn("start_s", F.round("start_s", 6))
        .withColumn("end_s", F.round("end_s", 6))
    )


@query
def stitch_order(spark, root):
    return reels.stitch_order(fx.reel_requests(spark, root), fx.shots(spark, root))


@query
def cap_per_group(spark, root):
    """The first cues of each reel under each of the caps that requests can ask for."""
    cues = fx.cues(spark, root).select("reel_id", "cue_idx", "text")
    capped = [captions.first_per_group(cues, ["reel_id"], ["cue_idx"], n).withColumn("cap", F.lit(name)) for name, n in ROW_CAPS.items()]
    return reduce(DataFrame.unionByName, capped)


@query
def progress_marks(spark, root):
    return detections.progress_marks(fx.frames(spark, root))


# --- Sort, limit, top-k, set operations ---


@query
def frame_name_order(spark, root):
    return sampling.name_order(sampling.dense(fx.videos(spark, root)).select("video_id", "name"))


@query
def image_file_filter(spark, root):
    names = table(spark, root, "documents").select(
        "doc_id",
        F.expr(
            "concat(lang, '_', cast(doc_id as string), case doc_id % 6 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' "
            "when 3 then '.gif' when 4 then '.jpg.tmp' else '.PnG' end)"
        ).alias("name"),
    )
    return media.image_files(names)


@query
def compare_results_union(spark, root):
    """Two lists of requests, each clip against its own edits and against the clips after it, as one sorted list."""
    clips = fx.gray_frames(spark, root).select(F.expr("video_id * 3").alias("base_id")).distinct()
    lists = {
        "edits": F.expr("array(base_id + 1, base_id + 2)"),
        "neighbours": F.expr("transform(sequence(1, 3), k -> base_id + 3 * k)"),
    }
    compared = [
        hashes.phash_compare(clips.withColumn("candidates", candidates), _hashes(spark, root)).withColumn("list", F.lit(name))
        for name, candidates in lists.items()
    ]
    return reduce(DataFrame.unionByName, compared).orderBy("base_id", "list", "index")


# --- Registries (batch forms of the streams) ---


def _artifacts(spark, root):
    token = F.concat_ws("_", F.lit("art"), F.col("job_id").cast("string"), "step")
    return fx.job_events(events(spark, root)).withColumn("token", token)


@query
def artifact_expiry(spark, root):
    return _plain_times(jobs.entry_expiry(_artifacts(spark, root), "token", jobs.ARTIFACT_TTL))


@query
def job_expiry(spark, root):
    return _plain_times(jobs.job_expiry(fx.job_events(events(spark, root))))


@query
def job_lifetimes(spark, root):
    return _plain_times(jobs.job_lifetimes(fx.job_events(events(spark, root))))


@query
def registry_reads(spark, root):
    return _plain_times(registry.registry_reads(fx.registry_log(events(spark, root))))


@query
def registry_lifetimes(spark, root):
    return _plain_times(registry.registry_lifetimes(fx.registry_log(events(spark, root))))


@query
def job_latest_state(spark, root):
    return _plain_times(jobs.latest_state(fx.job_events(events(spark, root))))


@query
def artifact_dedup(spark, root):
    return _plain_times(jobs.first_registrations(_artifacts(spark, root), "token"))


@query
def job_activity_window(spark, root):
    return _plain_times(jobs.activity_windows(fx.job_events(events(spark, root)), "1 hour"))


@query
def job_activity_sliding(spark, root):
    return _plain_times(jobs.activity_windows(fx.job_events(events(spark, root)), "1 hour", "15 minutes"))


@query
def job_activity_session(spark, root):
    return _plain_times(jobs.activity_sessions(fx.job_events(events(spark, root)), SESSION_GAP_MINUTES))
