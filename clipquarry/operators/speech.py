"""Transcripts, word timings and what is sent along with the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.functions.semantics import non_empty, or_default, round_digits, trim_blanks

# Confidence limits of a spoken segment.
NO_SPEECH_MAX = 0.6
LOGPROB_MIN = -1.0
COMPRESSION_MAX = 2.4

# The texts of model requests.
FRAMES_TEXT = "These %d frames were extracted from the video"
OWN_FRAMES_TEXT = "These %d frames were extracted from my own source video. "
DURATION_TEXT = "Its exact duration is %s seconds — use this figure, do not estimate.\n\n"
BRIEF_TEXT = "The background change I want: "
NO_BRIEF = "(none specified — ask one clarifying question in the ANALYSIS instead of guessing)"

# Segments that are put in order together before the parts of a clip are joined.
PART_SEGMENTS = 4096


def is_speech() -> Column:
    """Confident segments; a missing score counts in favour of the segment."""
    return (
        (F.coalesce("no_speech_prob", F.lit(0.0)) < NO_SPEECH_MAX)
        & (F.coalesce("avg_logprob", F.lit(0.0)) > LOGPROB_MIN)
        & (F.coalesce("compression_ratio", F.lit(1.0)) < COMPRESSION_MAX)
    )


def speech_segments(segments: DataFrame) -> DataFrame:
    return segments.filter(is_speech())


def transcript_assemble(segments: DataFrame, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """Kept segments of each clip joined by a blank, in order: one row per clip.

    Segments are put in order part by part, which spreads a clip with very many of them; the texts of its parts are
    joined afterwards, so the last step holds the transcript and nothing else.
    """
    text = trim_blanks(F.coalesce("text", F.lit("")))
    marked = segments.select(
        "video_id",
        F.expr(f"seg_idx div {part_segments}").alias("part"),
        is_speech().alias("keep"),
        F.when(is_speech() & (text != ""), F.struct("seg_idx", text.alias("text"))).alias("piece"),
    )
    parts = marked.groupBy("video_id", "part").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("rejected")
    )
    joined = parts.withColumn("text", F.array_join(F.col("pieces.text"), " ")).withColumn(
        "said", F.when(F.col("text") != "", F.struct("part", "text"))
    )
    return (
        joined.groupBy("video_id")
        .agg(F.array_sort(F.collect_list("said")).alias("said"), F.sum("kept").alias("kept"), F.sum("rejected").alias("rejected"))
        .select("video_id", F.array_join(F.col("said.text"), " ").alias("text"), "kept", "rejected")
        .withColumn("has_audio", F.col("text") != "")
    )


def with_raw_transcripts(assembled: DataFrame, raw: DataFrame) -> DataFrame:
    """Add the responses that came without segments, whose text is taken as it is."""
    text = F.coalesce("text", F.lit(""))
    none = F.lit(0).cast("bigint")
    whole = raw.select("video_id", text.alias("text"), none.alias("kept"), none.alias("rejected"), (text != "").alias("has_audio"))
    return assembled.unionByName(whole)


def transcript_presence(segments: DataFrame) -> DataFrame:
    """Per clip: kept and rejected segments, and whether anything is said. Needs no ordering, so it
    combines before the shuffle."""
    said = is_speech() & (trim_blanks(F.coalesce("text", F.lit(""))) != "")
    return segments.groupBy("video_id").agg(
        F.count_if(is_speech()).alias("kept"),
        F.count_if(~is_speech()).alias("rejected"),
        F.bool_or(said).alias("has_audio"),
    )


def word_normalize(words: DataFrame) -> DataFrame:
    """Trimmed words with usable numbers; blank words are dropped."""
    return words.select(
        "video_id",
        "word_idx",
        trim_blanks(F.coalesce("word", F.lit(""))).alias("word"),
        or_default(F.coalesce("start_s", F.lit(0.0)), 0.0).alias("start_s"),
        or_default(F.coalesce("end_s", F.lit(0.0)), 0.0).alias("end_s"),
    ).filter("word <> ''")


def speech_coverage(words: DataFrame, videos: DataFrame) -> DataFrame:
    """Where speech stops against where the file stops, for every clip; one without words is silent from the start."""
    last = word_normalize(words).groupBy("video_id").agg(F.max("end_s").alias("last_end"))
    clips = videos.select("video_id", F.coalesce("probe_duration", F.lit(0.0)).alias("duration"))
    found = clips.join(last, "video_id", "left").withColumn("last_end", F.coalesce("last_end", F.lit(0.0)))
    return found.withColumn("trailing_silence", F.round(F.col("duration") - F.col("last_end"), 6))


def request_bundle(clips: DataFrame, transcripts: DataFrame, closing: str) -> DataFrame:
    """Frame list and text of each model request; no call is made.

    `clips` has (video_id, route, n_frames, seconds, brief, frame_list, note), one row per route a request may take.
    Each gives two requests: one to describe the clip, with its transcript, and one to change its background, with the
    exact length and what is asked for.
    """
    spoken = transcripts.filter("text <> ''").select("video_id", "text")
    joined = clips.join(spoken, "video_id", "left")
    opening = F.format_string(FRAMES_TEXT, F.col("n_frames"))
    heard = F.concat(opening, F.lit('. Transcript: "'), F.col("text"), F.lit(f'"\n\n{closing}'))
    unheard = F.concat(opening, F.lit(f" (no audio). {closing}"))
    length = F.regexp_replace(round_digits(F.col("seconds"), 1).cast("string"), r"\.0$", "")
    brief = non_empty(trim_blanks(F.coalesce("brief", F.lit(""))))
    background = F.concat(
        F.format_string(OWN_FRAMES_TEXT, F.col("n_frames")),
        F.format_string(DURATION_TEXT, length),
        F.lit(BRIEF_TEXT),
        F.coalesce(brief, F.lit(NO_BRIEF)),
    )
    texts = F.array(
        F.struct(F.lit("describe").alias("kind"), F.when(F.col("text").isNotNull(), heard).otherwise(unheard).alias("body")),
        F.struct(F.lit("background").alias("kind"), background.alias("body")),
    )
    return joined.select("video_id", "route", "n_frames", "frame_list", "note", F.inline(texts)).select(
        "video_id", "route", "kind", "n_frames", "frame_list", F.concat("body", "note").alias("request_text")
    )
