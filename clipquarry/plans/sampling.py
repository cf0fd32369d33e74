"""Frame schedules. Every plan is computed from the clip row alone, so none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquarry.functions.semantics import clamp, int_param, or_default, round_digits, round_half_up

# Fixed values of the plans.
DEFAULT_SECONDS = 15.0
DENSE_FRAMES = 80
DENSE_MAX_FPS = 8.0
PICKER_FRAMES = 12
VISION_FRAMES = 20
HOOK_STAMPS = [0.3, 1.0, 2.0, 3.0]
OPENING_STAMP = 0.1
FRAME_RATE = 24
ZOOM_STEP, ZOOM_MAX = 0.0015, 1.10

TWO_DIGITS = [f"{n:02d}" for n in range(100)]


def clip_seconds(probed: Column) -> Column:
    """Length of a clip; a failed or zero probe counts as the default."""
    return or_default(probed, DEFAULT_SECONDS)


def dense_rate(probed: Column) -> Column:
    """Frames per second that spend the whole frame budget on the clip."""
    return F.least(F.lit(DENSE_MAX_FPS), F.lit(float(DENSE_FRAMES)) / F.greatest(clip_seconds(probed), F.lit(0.1)))


def dense_count(probed: Column) -> Column:
    return clamp(round_half_up(clip_seconds(probed) * dense_rate(probed)), 1, DENSE_FRAMES).cast("bigint")


def indexes(count: Column) -> Column:
    """0 .. count-1, or nothing."""
    return F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))


def even_sample(count: Column, keep: int) -> Column:
    """Indexes of `keep` items spread evenly over `count`, ends included; all where there are no more.
    Steps are longer than one, so no index comes twice."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: round_half_up(i * (count - 1) / F.lit(keep - 1)))
    return F.when(count <= keep, indexes(count)).otherwise(picks)


def dense(videos: DataFrame) -> DataFrame:
    return (
        videos.select("video_id", dense_rate(F.col("probe_duration")).alias("fps"), dense_count(F.col("probe_duration")).alias("n"))
        .select("video_id", "fps", F.explode(indexes(F.col("n"))).alias("i"))
        .select(
            "video_id",
            "i",
            (F.col("i") / F.col("fps")).alias("ts"),
            F.format_string("frame-%03d.jpg", F.col("i") + 1).alias("name"),
        )
    )


def picker(videos: DataFrame) -> DataFrame:
    rate = dense_rate(F.col("probe_duration"))
    return (
        videos.select("video_id", rate.alias("fps"), even_sample(dense_count(F.col("probe_duration")), PICKER_FRAMES).alias("picks"))
        .select("video_id", "fps", F.posexplode("picks").alias("slot", "frame_idx"))
        .select(
            "video_id",
            F.col("slot").cast("bigint").alias("i"),
            "frame_idx",
            round_digits(F.col("frame_idx") / F.col("fps"), 1).alias("ts"),
        )
    )


def vision_note(count: Column, sent: Column) -> Column:
    """Remark for the model when it sees only a part of the frames."""
    shown = F.format_string(" (%d representative frames shown, evenly sampled from the full clip.)", sent)
    return F.when(sent < count, shown).otherwise(F.lit(""))


def vision_cap(videos: DataFrame) -> DataFrame:
    count = dense_count(F.col("probe_duration"))
    return (
        videos.select("video_id", count.alias("n"), even_sample(count, VISION_FRAMES).alias("picks"))
        .withColumn("note", vision_note(F.col("n"), F.size("picks")))
        .select("video_id", "note", F.posexplode("picks").alias("slot", "frame_idx"))
        .select("video_id", F.col("slot").cast("bigint").alias("i"), "frame_idx", "note")
    )


def hook(videos: DataFrame) -> DataFrame:
    stamps = F.array(*[F.lit(x) for x in HOOK_STAMPS])
    inside = F.filter(stamps, lambda ts: ts < clip_seconds(F.col("probe_duration")))
    return videos.select("video_id", F.posexplode(inside).alias("i", "ts")).withColumn("i", F.col("i").cast("bigint"))


def opening(videos: DataFrame) -> DataFrame:
    """The opening frame, or the first picker frame of a clip too short to have one."""
    has_one = clip_seconds(F.col("probe_duration")) > OPENING_STAMP
    return videos.select(
        "video_id",
        F.when(has_one, F.lit(OPENING_STAMP)).otherwise(F.lit(0.0)).alias("ts"),
        F.when(has_one, "opening").otherwise("picker").alias("source"),
    )


def frame_count_param(raw: Column) -> Column:
    return int_param(raw, 3, 1, 5)


def hash_count_param(raw: Column) -> Column:
    return int_param(raw, 6, 3, 12)


def interior(requests: DataFrame) -> DataFrame:
    """Stamps strictly inside a clip, for requests with (req_id, raw, probe_duration)."""
    seconds = F.coalesce("probe_duration", F.lit(0.0))
    base = F.when(seconds > 0.2, seconds).otherwise(F.lit(1.0))
    return (
        requests.select("req_id", base.alias("base"), frame_count_param(F.col("raw")).alias("n"))
        .select("req_id", "base", "n", F.explode(indexes(F.col("n"))).alias("i"))
        .withColumn("exact", F.greatest(F.lit(0.05), F.col("base") * ((F.col("i") + 1) / (F.col("n") + 1))))
        .select("req_id", "i", round_digits(F.col("exact"), 3).alias("seek"), round_digits(F.col("exact"), 2).alias("ts"))
    )


def hash_schedule(requests: DataFrame) -> DataFrame:
    """Evenly spaced stamps in proportion to the length, so that sped-up copies stay aligned."""
    seconds = F.coalesce("probe_duration", F.lit(0.0))
    n = hash_count_param(F.col("raw"))
    rate = F.when(seconds > 0.1, n / seconds).otherwise(F.lit(1.0))
    return (
        requests.select("req_id", rate.alias("exact"), F.explode(indexes(n)).alias("i"))
        .select(
            "req_id",
            "i",
            round_digits(F.col("exact"), 6).alias("rate"),
            round_digits(F.col("i") / F.col("exact"), 6).alias("ts"),
        )
    )


def frame_file(index: Column) -> Column:
    """File name of a constant-rate frame. Clips have thousands of them, so numbers of four digits are put together from a list of
    two-digit ones instead of being formatted."""
    number = index + 1
    pair = lambda n: F.get(F.array(*[F.lit(p) for p in TWO_DIGITS]), n.cast("int"))
    short = F.concat(F.lit("frame_"), pair(F.floor(number / 100)), pair(number % 100), F.lit(".jpg"))
    plain = number.cast("string")
    other = F.concat(F.lit("frame_"), F.when(index < 9999, F.lpad(plain, 4, "0")).otherwise(plain), F.lit(".jpg"))
    return F.when((index >= 0) & (index < 9999), short).otherwise(other)


def fixed_rate(clips: DataFrame, seconds: Column, rate: int = FRAME_RATE) -> DataFrame:
    """Constant-rate frames of each clip."""
    count = F.floor(seconds * rate).cast("bigint")
    return clips.select("*", F.explode(indexes(count)).alias("i")).select(
        *clips.columns,
        "i",
        (F.col("i") / F.lit(float(rate))).alias("ts"),
        frame_file(F.col("i")).alias("name"),
    )


def still_zoom(stills: DataFrame, seconds: Column) -> DataFrame:
    """Frame by frame zoom of stills: a slow push of constant speed up to a limit."""
    count = F.greatest(F.lit(2), round_half_up(seconds * FRAME_RATE)).cast("bigint")
    return stills.select("*", F.explode(indexes(count)).alias("i")).select(
        *stills.columns,
        "i",
        F.least(F.lit(1.0) + F.lit(ZOOM_STEP) * (F.col("i") + 1), F.lit(ZOOM_MAX)).alias("zoom"),
    )


def name_order(names: DataFrame) -> DataFrame:
    """0-based place of each frame file of a clip by name. Names are zero-padded, so this is frame order; a
    clip has as many names as the frame budget allows."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("name")) - 1
    return names.withColumn("place", place.cast("bigint"))
