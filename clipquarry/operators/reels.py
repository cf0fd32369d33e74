"""Edit lists: which shots make it into a reel, when they play, and what is said over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquarry.functions.semantics import clamp, or_default, trim_blanks
from clipquarry.operators.captions import caption_outcome, first_per_group
from clipquarry.operators.speech import word_normalize
from clipquarry.skew import salted_join, with_running_total

# Fixed values.
MIN_CLIPS = 2
SHOT_LONGEST = 10.0

# Silence, in seconds, that parts two islands of speech.
ISLAND_GAP = 0.3


def shot_seconds(raw: Column) -> Column:
    return clamp(or_default(raw, 1.0), 0.3, SHOT_LONGEST)


def shot_start(raw: Column) -> Column:
    return clamp(or_default(raw, 0.0), 0.0, 60.0)


def voice_delay(raw: Column) -> Column:
    return clamp(or_default(raw, 0.0), 0.0, 15.0)


def requested_shots(shots: DataFrame, cap: int | None = None) -> DataFrame:
    """Shots with a source, all or the first `cap` of each reel, with their clamped cut."""
    listed = first_per_group(shots.filter("url is not null and url <> ''"), ["reel_id"], ["shot_idx"], cap)
    return listed.select(
        "reel_id",
        "shot_idx",
        "url",
        "kind",
        F.coalesce("fetched", F.lit(False)).alias("fetched"),
        shot_seconds(F.col("seconds")).alias("seconds"),
        shot_start(F.col("start_at")).alias("start_at"),
    )


def reel_lengths(requests: DataFrame, shots: DataFrame, cap: int | None = None) -> DataFrame:
    """Requested and prepared shots and picture length of every request (reel_id); fewer than two are refused."""
    counted = (
        requested_shots(shots, cap)
        .groupBy("reel_id")
        .agg(
            F.count("*").alias("requested"),
            F.count_if("fetched").alias("prepared"),
            F.round(F.sum(F.when(F.col("fetched"), F.col("seconds")).otherwise(F.lit(0.0))), 6).alias("seconds"),
        )
    )
    return (
        requests.select("reel_id")
        .join(counted, "reel_id", "left")
        .fillna({"requested": 0, "prepared": 0, "seconds": 0.0})
        .withColumn(
            "status",
            F.when(F.col("requested") < MIN_CLIPS, "too_few_requested")
            .when(F.col("prepared") < MIN_CLIPS, "too_few_prepared")
            .otherwise("ok"),
        )
    )


def accepted_reels(shots: DataFrame, cap: int | None = None) -> DataFrame:
    """Reels with enough prepared shots, and their picture length."""
    named = shots.select("reel_id").distinct()
    return reel_lengths(named, shots, cap).filter("status = 'ok'").select("reel_id", "seconds")


def shot_timeline(shots: DataFrame, cap: int | None = None) -> DataFrame:
    """Running start and end of the prepared shots of accepted reels; a failed shot moves later ones earlier."""
    prepared = requested_shots(shots, cap).filter("fetched").join(accepted_reels(shots, cap).select("reel_id"), "reel_id", "left_semi")
    bucket = [F.expr("shot_idx div 65536")]
    return (
        with_running_total(prepared, ["reel_id"], ["shot_idx"], bucket, F.col("seconds"), "end_s")
        .withColumn("start_s", F.col("end_s") - F.col("seconds"))
        .select("reel_id", "shot_idx", "kind", "seconds", "start_at", "start_s", "end_s")
    )


def reel_summary(requests: DataFrame, shots: DataFrame, voices: DataFrame, cues: DataFrame, cap: int | None = None) -> DataFrame:
    """`reel_lengths`, whether a voice-over (reel_id, audio_url) goes with the reel, and what became of its captions."""
    spoken = voices.filter("audio_url <> ''").select("reel_id").distinct().withColumn("has_audio", F.lit(True))
    accepted = F.col("status") == "ok"
    return (
        reel_lengths(requests, shots, cap)
        .join(spoken, "reel_id", "left")
        .join(caption_outcome(cues), "reel_id", "left")
        .withColumn("has_audio", F.coalesce("has_audio", F.lit(False)))
        .withColumn("captions_burned", accepted & F.coalesce("captions_burned", F.lit(False)))
        .withColumn("caption_error", F.when(accepted, F.col("caption_error")))
    )


def failed_shots(shots: DataFrame, cap: int | None = None) -> DataFrame:
    """Requested shots that were not prepared. Each shot carries its outcome, so this needs no join with the
    prepared ones."""
    return requested_shots(shots, cap).filter(~F.col("fetched")).select("reel_id", "shot_idx", "url")


def valid_sources(requests: DataFrame, shots: DataFrame, cap: int | None = None) -> DataFrame:
    """Non-blank sources of every request (reel_id), all or the first `cap`, and whether two or more are left. A
    request without any is one row without a source."""
    named = shots.filter(trim_blanks(F.coalesce("url", F.lit(""))) != "").select("reel_id", "shot_idx", "url")
    listed = first_per_group(named, ["reel_id"], ["shot_idx"], cap)
    counts = listed.groupBy("reel_id").agg(F.count("*").alias("sources"))
    return (
        requests.select("reel_id")
        .join(counts, "reel_id", "left")
        .withColumn("sources", F.coalesce("sources", F.lit(0).cast("bigint")))
        .join(listed, "reel_id", "left")
        .select("reel_id", "shot_idx", "url", "sources", (F.col("sources") >= MIN_CLIPS).alias("accepted"))
    )


def stitch_order(requests: DataFrame, shots: DataFrame, cap: int | None = None) -> DataFrame:
    """1-based place of each source in the stitched clip of an accepted request."""
    accepted = valid_sources(requests, shots, cap).filter("accepted")
    bucket = [F.expr("shot_idx div 65536")]
    placed = with_running_total(accepted, ["reel_id"], ["shot_idx"], bucket, F.lit(1).cast("bigint"), "clip_order")
    return placed.select("reel_id", "clip_order", "url", F.col("sources").alias("clip_count"))


def word_shot_alignment(words: DataFrame, shots: DataFrame, voices: DataFrame, cap: int | None = None) -> DataFrame:
    """The shot on screen while each word is spoken; none past the end of the picture, or without one. The words of a
    reel start late by its own delay (`voices`: reel_id, delay_raw).

    A shot lasts ten seconds at most, so it lies in one or two tens of seconds. Words and shots meet on
    (reel, ten seconds) in an equi-join, which also spreads long reels.
    """
    span = lambda at: F.floor(at / SHOT_LONGEST).cast("bigint")
    shown = shot_timeline(shots, cap).select(
        F.col("reel_id").alias("video_id"),
        "shot_idx",
        "start_s",
        "end_s",
        F.explode(F.sequence(span(F.col("start_s")), span(F.col("end_s")))).alias("span"),
    )
    delays = voices.select(F.col("reel_id").alias("video_id"), voice_delay(F.col("delay_raw")).alias("delay"))
    spoken = (
        word_normalize(words)
        .select("video_id", "word_idx", "word", "start_s")
        .join(delays, "video_id", "left")
        .select("video_id", "word_idx", "word", (F.col("start_s") + F.coalesce("delay", F.lit(0.0))).alias("at"))
        .withColumn("span", span(F.col("at")))
    )
    w, s = spoken.alias("w"), shown.alias("s")
    met = w.join(
        s,
        (F.col("w.video_id") == F.col("s.video_id"))
        & (F.col("w.span") == F.col("s.span"))
        & (F.col("w.at") >= F.col("s.start_s"))
        & (F.col("w.at") < F.col("s.end_s")),
        "left",
    )
    return met.select(
        "w.video_id", "w.word_idx", "w.word", F.round("w.at", 6).alias("at"), "s.shot_idx", F.col("s.shot_idx").isNotNull().alias("heard")
    )


def _joined_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the spans (start_s, end_s) of a key as spans that do not touch."""
    line = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reached = F.max("end_s").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start_s") > reached), 1).otherwise(0)
    numbered = spans.withColumn("opens", opens).withColumn("span", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "span").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("span")


def voice_over_fit(words: DataFrame, shots: DataFrame, voices: DataFrame, cap: int | None = None) -> DataFrame:
    """How the voice-over of each accepted reel fits its picture, one row per reel that has one.

    The voice starts `delay_s` late and ends with its last word. If it is shorter than the picture it is padded with silence, if longer it is cut
    where the picture ends: `cut_words` start after that, `clipped_words` before and end after it. What is heard forms `islands` of speech,
    apart by more than `ISLAND_GAP`; `longest_silence_s` also counts the time before the first and after the last of them.

    Spans of words are united inside stretches of ten seconds first, so a reel of very many words enters its own window with few.
    """
    voiced = voices.filter("audio_url <> ''").select("reel_id", voice_delay(F.col("delay_raw")).alias("delay_s"))
    reels = accepted_reels(shots, cap).join(voiced, "reel_id").withColumnRenamed("seconds", "picture_s")
    spoken = word_normalize(words).select(F.col("video_id").alias("reel_id"), "word_idx", "start_s", "end_s")
    placed = salted_join(spoken, reels, ["reel_id"], ["word_idx"]).select(
        "reel_id",
        "picture_s",
        (F.col("start_s") + F.col("delay_s")).alias("start_s"),
        (F.greatest("end_s", "start_s") + F.col("delay_s")).alias("end_s"),
    )
    starts_in = F.col("start_s") < F.col("picture_s")
    counted = placed.groupBy("reel_id").agg(
        F.max("end_s").alias("voice_end"),
        F.count("*").alias("words"),
        F.count_if(~starts_in).alias("cut_words"),
        F.count_if(starts_in & (F.col("end_s") > F.col("picture_s"))).alias("clipped_words"),
    )
    heard = placed.filter(starts_in).select("reel_id", "start_s", F.least("end_s", "picture_s").alias("end_s"))
    parts = _joined_spans(heard.withColumn("stretch", F.floor(F.col("start_s") / SHOT_LONGEST).cast("bigint")), ["reel_id", "stretch"])
    whole = _joined_spans(parts.drop("stretch"), ["reel_id"])
    silence = F.col("start_s") - F.lag("end_s").over(Window.partitionBy("reel_id").orderBy("start_s"))
    islands = (
        whole.withColumn("silence", silence)
        .groupBy("reel_id")
        .agg(
            (F.count_if(F.col("silence") > ISLAND_GAP) + 1).alias("islands"),
            F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s"),
            F.greatest(F.max("silence"), F.min("start_s")).alias("gap_s"),
            F.max("end_s").alias("heard_until"),
        )
    )
    none = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    seconds = lambda column, name: F.round(column, 6).alias(name)
    voice_end = F.coalesce("voice_end", "delay_s")
    zero = F.lit(0.0)
    return (
        reels.join(counted, "reel_id", "left")
        .join(islands, "reel_id", "left")
        .select(
            "reel_id",
            seconds(F.col("picture_s"), "picture_s"),
            "delay_s",
            seconds(voice_end, "voice_end_s"),
            seconds(F.greatest(F.col("picture_s") - voice_end, zero), "pad_s"),
            seconds(F.greatest(voice_end - F.col("picture_s"), zero), "cut_s"),
            none("words"),
            none("cut_words"),
            none("clipped_words"),
            none("islands"),
            seconds(F.coalesce("speech_s", zero), "speech_s"),
            seconds(F.greatest(F.coalesce("gap_s", zero), F.col("picture_s") - F.coalesce("heard_until", zero)), "longest_silence_s"),
        )
    )
