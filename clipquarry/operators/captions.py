"""Caption cues: grouping words, filtering cues, sizing text, placing cues on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquarry.functions import geometry
from clipquarry.functions.semantics import round_digits, round_half_up, to_number, trim_blanks, utf16_length
from clipquarry.plans.sampling import FRAME_RATE
from clipquarry.skew import salted_join, with_position

# Fixed values.
WORDS_PER_CHUNK = 3
NO_CUES = "no usable cues"


def caption_chunks(words: DataFrame, size: int = WORDS_PER_CHUNK) -> DataFrame:
    """Words in groups of `size` by position. The group number is part of the key, so no group has more
    than `size` rows however long the clip is. Groups this small gain nothing from a partial aggregation;
    a window sorts the words once, after the shuffle."""
    text = trim_blanks(F.coalesce("word", F.lit("")))
    group = Window.partitionBy("video_id", "chunk_idx").orderBy("word_idx")
    rest = group.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        words.select("video_id", F.expr(f"word_idx div {size}").alias("chunk_idx"), "word_idx", "start_s", "end_s", text.alias("word"))
        .select(
            "video_id",
            "chunk_idx",
            F.row_number().over(group).alias("place"),
            F.array_join(F.collect_list("word").over(rest), " ").alias("text"),
            "start_s",
            F.last("end_s").over(rest).alias("end_s"),
        )
        .filter("place = 1")
        .drop("place")
        .withColumn("usable", F.coalesce(_is_usable(), F.lit(False)))
    )


def _is_usable() -> Column:
    """Text, and finite times in order. NaN sorts above every number, so it fails one of the bounds."""
    start, end = F.col("start_s"), F.col("end_s")
    in_order = (end > start) & (end < float("inf")) & (start > float("-inf"))
    return in_order & (trim_blanks(F.col("text")) != "")


def usable_chunks(words: DataFrame) -> DataFrame:
    """Chunks with text and real timings; a missing time is not a time."""
    return caption_chunks(words).filter("usable").drop("usable")


def usable_cues(cues: DataFrame) -> DataFrame:
    """Cues as clients send them, numbers read from text; here a missing time is 0.

    The cleaned values pass through a generator, so that the filter reads them instead of cleaning each
    value again for every comparison.
    """
    cleaned = F.struct(
        trim_blanks(F.coalesce("text", F.lit(""))).alias("text"),
        to_number(F.col("start_raw")).alias("start_s"),
        to_number(F.col("end_raw")).alias("end_s"),
    )
    return cues.select("reel_id", "cue_idx", F.inline(F.array(cleaned))).filter(_is_usable())


def first_per_group(df: DataFrame, keys: list[str], order: list[str], cap: int | None) -> DataFrame:
    """The first `cap` rows of each group, or all. The rank limit is applied before the shuffle as well, so a
    hot group sends at most `cap` rows per task."""
    if cap is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= cap).drop("_rank")


def longest_chunk(words: DataFrame) -> DataFrame:
    return caption_chunks(words).groupBy("video_id").agg(F.max(utf16_length(F.col("text"))).alias("longest"))


def longest_cue(cues: DataFrame) -> DataFrame:
    return usable_cues(cues).groupBy("reel_id").agg(F.max(utf16_length(F.col("text"))).alias("longest"))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def chunk_font_size(words: DataFrame, videos: DataFrame) -> DataFrame:
    """Font size of word captions: the longest of all chunks counts, usable or not."""
    longest = longest_chunk(words).select("video_id", F.greatest("longest", F.lit(1)).alias("longest"))
    return _sized(longest, videos.withColumn("size_name", F.lit(geometry.DEFAULT_SIZE)), geometry.CHUNK_BORDER)


def cue_font_size(cues: DataFrame, videos: DataFrame) -> DataFrame:
    """Font size of client cues: only usable cues count, and the size that was asked for (`size_name` of `videos`)."""
    return _sized(longest_cue(cues).withColumnRenamed("reel_id", "video_id"), videos, geometry.CUE_BORDER)


def _sized(longest: DataFrame, videos: DataFrame, border: float) -> DataFrame:
    width = F.coalesce(round_half_up(_positive(F.col("width"))), F.lit(geometry.CANVAS_W))
    height = F.coalesce(round_half_up(_positive(F.col("height"))), F.lit(geometry.CANVAS_H))
    ratio = geometry.caption_ratio(F.col("size_name"))
    return (
        longest.join(videos.select("video_id", "width", "height", "size_name"), "video_id", "left")
        .select("video_id", "longest", geometry.caption_font_px(width, height, F.col("longest"), ratio).alias("font_px"))
        .withColumn("border_px", round_half_up(F.col("font_px") * F.lit(border)))
    )


def caption_outcome(cues: DataFrame) -> DataFrame:
    """Per reel with cues: whether captions are burned in, and if not, why."""
    usable = usable_cues(cues).groupBy("reel_id").agg(F.count("*").alias("usable"))
    asked = cues.select("reel_id").distinct()
    burned = F.col("usable").isNotNull()
    return asked.join(usable, "reel_id", "left").select(
        "reel_id", burned.alias("captions_burned"), F.when(~burned, NO_CUES).alias("caption_error")
    )


def cue_frame_overlay(cues: DataFrame, reels: DataFrame, rate: int = FRAME_RATE, cap: int | None = None) -> DataFrame:
    """Cues visible on each output frame, both ends included; all cues of a reel or the first `cap`.

    A cue lists its own frames up to the end of its reel, so the only join is an equi-join of cues with
    one row per reel (`reels`: reel_id, seconds); there is no range join and no frame table.
    """
    usable = usable_cues(first_per_group(cues, ["reel_id"], ["cue_idx"], cap)).select(
        "reel_id", "cue_idx", round_digits(F.col("start_s"), 3).alias("start_s"), round_digits(F.col("end_s"), 3).alias("end_s")
    )
    last_frame = F.floor(F.col("seconds") * rate).cast("bigint") - 1
    first = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("start_s") * rate).cast("bigint"))
    last = F.least(last_frame, F.ceil(F.col("end_s") * rate).cast("bigint"))
    moment = F.col("frame_idx") / F.lit(float(rate))
    return (
        usable.join(reels.select("reel_id", "seconds"), "reel_id")
        .withColumn("first", first)
        .withColumn("last", last)
        .filter("first <= last")
        .select("reel_id", "cue_idx", "start_s", "end_s", F.explode(F.sequence("first", "last")).alias("frame_idx"))
        .filter((moment >= F.col("start_s")) & (moment <= F.col("end_s")))
        .select("reel_id", "frame_idx", "cue_idx")
    )


def cue_overlay_runs(cues: DataFrame, reels: DataFrame, rate: int = FRAME_RATE, cap: int | None = None) -> DataFrame:
    """`cue_frame_overlay` as runs of frames that show the same cues: (reel_id, first_frame, last_frame, cues), cues in order, comma-joined.

    A sweep line over the frames at which a cue starts, or has just stopped: they cut a reel into runs, and a cue lies in those from its start to its
    stop. Rows grow with the cues, not with the frame rate; a reel of very many cues is numbered in buckets (`with_position`).
    """
    usable = usable_cues(first_per_group(cues, ["reel_id"], ["cue_idx"], cap)).select(
        "reel_id", "cue_idx", round_digits(F.col("start_s"), 3).alias("start_s"), round_digits(F.col("end_s"), 3).alias("end_s")
    )
    last_frame = F.floor(F.col("seconds") * rate).cast("bigint") - 1
    near = lambda side, steps: [F.floor(F.col(side) * rate).cast("bigint") + k for k in steps]
    moment = lambda frame: frame / F.lit(float(rate))
    # The product may be off by a rounding, so neighbours are tried with the comparison that decides.
    first = F.least(*[F.when(moment(f) >= F.col("start_s"), f) for f in near("start_s", (-1, 0, 1, 2))])
    last = F.greatest(*[F.when(moment(f) <= F.col("end_s"), f) for f in near("end_s", (-1, 0, 1, 2))])
    shown = (
        salted_join(usable, reels.select("reel_id", "seconds"), ["reel_id"], ["cue_idx"])
        .select("reel_id", "cue_idx", F.greatest(first, F.lit(0).cast("bigint")).alias("first"), (F.least(last, last_frame) + 1).alias("stop"))
        .filter("first < stop")
    )
    edges = shown.select("reel_id", F.explode(F.array("first", "stop")).alias("frame")).distinct()
    runs = with_position(edges, ["reel_id"], ["frame"], [F.expr("frame div 65536")], "run")
    of = lambda side: runs.select("reel_id", F.col("frame").alias(side), F.col("run").alias(f"{side}_run"))
    placed = shown.join(of("first"), ["reel_id", "first"]).join(of("stop"), ["reel_id", "stop"])
    covered = placed.select("reel_id", "cue_idx", F.explode(F.sequence("first_run", F.col("stop_run") - 1)).alias("run"))
    sets = covered.groupBy("reel_id", "run").agg(F.array_join(F.array_sort(F.collect_list("cue_idx")).cast("array<string>"), ",").alias("cues"))
    starts = runs.select("reel_id", "run", F.col("frame").alias("first_frame"))
    stops = runs.select("reel_id", (F.col("run") - 1).alias("run"), (F.col("frame") - 1).alias("last_frame"))
    return sets.join(starts, ["reel_id", "run"]).join(stops, ["reel_id", "run"]).select("reel_id", "first_frame", "last_frame", "cues")
