"""Request bodies, transcription responses and probe output as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST_SCHEMA = "videoUrl string, frames string, maxSeconds string, count string, _corrupt string"
TRANSCRIPT_SCHEMA = (
    "text string, duration double, "
    "segments array<struct<text: string, no_speech_prob: double, avg_logprob: double, compression_ratio: double>>, "
    "words array<struct<word: string, start: double, end: double>>"
)


def scan_requests(bodies: DataFrame) -> DataFrame:
    """JSON bodies (req_id, body) with a reason where a body is refused."""
    parsed = F.from_json("body", REQUEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    url = F.col("parsed.videoUrl")
    return bodies.withColumn("parsed", parsed).select(
        "req_id",
        url.alias("video_url"),
        F.col("parsed.frames").alias("frames"),
        F.when(F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull(), "bad_json")
        .when(url.isNull() | (url == ""), "missing_video_url")
        .alias("reject_reason"),
    )


def scan_transcripts(responses: DataFrame) -> DataFrame:
    """Verbose transcription responses (response_id, body), parsed once."""
    return responses.select("response_id", F.from_json("body", TRANSCRIPT_SCHEMA).alias("parsed")).select("response_id", "parsed.*")


def transcript_words(parsed: DataFrame) -> DataFrame:
    """One row per word with its position; a response without words keeps one row without any."""
    return parsed.select("response_id", F.posexplode_outer("words").alias("word_idx", "w")).select(
        "response_id",
        F.col("word_idx").cast("bigint").alias("word_idx"),
        F.col("w.word").alias("word"),
        F.col("w.start").alias("start_s"),
        F.col("w.end").alias("end_s"),
    )


def transcript_segments(parsed: DataFrame) -> DataFrame:
    return parsed.select("response_id", F.posexplode_outer("segments").alias("seg_idx", "s")).select(
        "response_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "s.*"
    )


def first_video_stream(streams: Column) -> Column:
    return F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))


def probe_video_stream(probes: DataFrame) -> DataFrame:
    """Size of the first video stream; clips without one have size 0 and an error."""
    found = first_video_stream(F.col("streams"))
    return probes.select(
        "video_id",
        F.coalesce(found["width"], F.lit(0)).cast("bigint").alias("width"),
        F.coalesce(found["height"], F.lit(0)).cast("bigint").alias("height"),
        F.when(found.isNull(), "No video stream found").alias("error"),
    )
