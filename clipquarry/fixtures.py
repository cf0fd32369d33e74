"""Input tables of the operators, derived from the given tables.

The given tables hold no media, so probe rows, word timings, shot lists and the like are computed from
them by fixed formulas. Nothing is generated from thin air: every table grows with its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.functions.phash import FRAME_SIDE
from clipquarry.skew import with_position
from clipquarry.sources.tables import events, table

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")


def videos(spark: SparkSession, root: str) -> DataFrame:
    """Probe rows; the probe of some clips failed (null or 0 duration, null size)."""
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.expr("if(p_partkey % 13 = 0, null, cast((p_partkey * 37) % 6000 as double) / 10e0)").alias("probe_duration"),
        F.expr("if(p_partkey % 17 = 0, null, cast(200 + p_size * 37 as int))").alias("width"),
        F.expr("if(p_partkey % 17 = 0, null, cast(300 + p_size * 61 as int))").alias("height"),
        F.expr("cast(500 + (p_partkey * 7919) % 5000 as bigint)").alias("bytes"),
        F.expr("case p_partkey % 3 when 0 then null when 1 then '  ' else p_name end").alias("brief"),
        F.expr(
            "case p_partkey % 6 when 0 then 'small' when 1 then 'MEDIUM' when 2 then 'large' when 3 then 'XLarge' "
            "when 4 then null else 'huge' end"
        ).alias("size_name"),
    )


def _user_events(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Events numbered per user in time order; a very busy user is spread over the seconds of the log."""
    log = events(spark, root)
    return with_position(log, ["user_id"], ["ts", "event_id"], [F.date_trunc("second", "ts")], name)


def words(spark: SparkSession, root: str) -> DataFrame:
    return _user_events(spark, root, "word_idx").select(
        F.col("user_id").alias("video_id"),
        "word_idx",
        F.expr("if(event_id % 29 = 0, '  ', concat(' ', event_type))").alias("word"),
        F.expr("if(event_id % 31 = 0, null, word_idx * 0.4e0)").alias("start_s"),
        F.expr("word_idx * 0.4e0 + if(event_type = 'error', 0e0, least(value, 350e0) / 1000e0)").alias("end_s"),
    )


def segments(spark: SparkSession, root: str) -> DataFrame:
    return _user_events(spark, root, "seg_idx").select(
        F.col("user_id").alias("video_id"),
        "seg_idx",
        F.expr("concat(' ', event_type, ' ')").alias("text"),
        F.expr("if(event_id % 7 = 0, null, cast(event_id % 10 as double) / 10e0)").alias("no_speech_prob"),
        F.expr("if(event_id % 5 = 0, null, 0e0 - value / 50e0)").alias("avg_logprob"),
        F.expr(
            "if(event_id % 3 = 0, null, 1e0 + cast(regexp_extract(props, '([0-9]+)', 1) as double) / 50e0)"
        ).alias("compression_ratio"),
    )


def cues(spark: SparkSession, root: str) -> DataFrame:
    return _user_events(spark, root, "cue_idx").select(
        F.col("user_id").alias("reel_id"),
        "cue_idx",
        F.expr("if(event_id % 19 = 0, '   ', concat(event_type, ' ', cast(event_id as string)))").alias("text"),
        F.expr(
            "case when event_id % 23 = 0 then 'abc' when event_id % 37 = 0 then null else cast(event_id % 60 as string) end"
        ).alias("start_raw"),
        F.expr("cast((event_id % 60) + (event_id % 4) as string)").alias("end_raw"),
    )


def _numbered_lines(spark: SparkSession, root: str, name: str, *extra: str) -> DataFrame:
    """Order lines numbered per order; a huge order is spread over line numbers and parts."""
    lines = table(spark, root, "lineitem").select("l_orderkey", *LINE_ORDER, *extra)
    bucket = [F.col("l_linenumber"), F.expr("l_partkey div 65536")]
    return with_position(lines, ["l_orderkey"], list(LINE_ORDER), bucket, name)


def shots(spark: SparkSession, root: str) -> DataFrame:
    extra = ("l_returnflag", "l_linestatus", "l_discount")
    return _numbered_lines(spark, root, "shot_idx", *extra).select(
        F.col("l_orderkey").alias("reel_id"),
        "shot_idx",
        F.expr("if(l_linenumber = 7, null, concat('shots/', cast(l_partkey as string)))").alias("url"),
        F.expr("if(l_returnflag = 'R', 'video', 'still')").alias("kind"),
        F.expr("l_quantity / 4e0").alias("seconds"),
        F.expr("if(l_linestatus = 'F', l_discount * 1000e0, null)").alias("start_at"),
        F.expr("l_suppkey % 9 <> 0").alias("fetched"),
    )


def reel_requests(spark: SparkSession, root: str) -> DataFrame:
    """Every reel that was asked for, with or without shots."""
    return table(spark, root, "orders").select(F.col("o_orderkey").alias("reel_id"))


def voices(spark: SparkSession, root: str) -> DataFrame:
    """Voice-over of each reel, missing or empty for some, and how late it is to start."""
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("reel_id"),
        F.expr("case o_orderkey % 4 when 0 then null when 1 then '' else concat('voice/', o_orderkey) end").alias("audio_url"),
        F.expr("case o_orderkey % 5 when 0 then null when 1 then 0.5e0 when 2 then 99e0 when 3 then -1e0 else 2.25e0 end").alias("delay_raw"),
    )


def detections(spark: SparkSession, root: str) -> DataFrame:
    return _numbered_lines(spark, root, "det_idx").select(
        F.col("l_orderkey").alias("frame_id"),
        "det_idx",
        F.lit(10.0).alias("x1"),
        F.lit(20.0).alias("y1"),
        F.expr("10e0 + l_quantity").alias("x2"),
        F.expr("20e0 + cast(l_linenumber as double) * 3e0").alias("y2"),
    )


def frames(spark: SparkSession, root: str) -> DataFrame:
    """Decoded frames: every order is one frame of the job of its customer; some cannot be read."""
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("frame_id"),
        F.col("o_custkey").alias("job_id"),
        F.expr("o_orderkey % 23 <> 0").alias("readable"),
    )


def urls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "pages").select(
        "page_id",
        F.expr(
            "case page_id % 7 when 0 then concat('https://www.instagram.com/reel/', cast(page_id as string), '/') "
            "when 1 then concat('https://www.tiktok.com/@u/video/', cast(page_id as string)) "
            "when 2 then concat('https://www.tiktok.com/t/', cast(page_id as string)) "
            "when 3 then concat('https://instagram.com/stories/', cast(page_id as string)) "
            "when 4 then '  ' else url end"
        ).alias("url"),
        F.expr(
            "case page_id % 4 when 0 then 'video/mp4' when 1 then 'text/html; charset=utf-8' when 2 then null "
            "else 'application/octet-stream' end"
        ).alias("content_type"),
        F.expr("case page_id % 3 when 0 then 'ftypmp42' when 1 then substring(html, 1, 20) else '<html>' end").alias("head"),
        F.expr(
            "case page_id % 13 when 0 then 62914560L when 1 then 62914561L when 2 then 209715200L when 3 then 209715201L "
            "when 4 then 314572800L when 5 then 314572801L when 6 then 999L when 7 then 1000L when 8 then 1001L when 9 then 1999L "
            "else cast(length(html) as bigint) end"
        ).alias("bytes"),
    )


def fetch_errors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        "event_id",
        F.expr(
            "case event_id % 10 when 0 then 'not_found' when 1 then 'restricted_page' when 2 then '' when 3 then null "
            "when 4 then 'Post not found or private' when 5 then 'Post DELETED, login required' "
            "when 6 then 'empty message' when 7 then 'HTTP 403' when 8 then 'no results' else 'timeout' end"
        ).alias("error"),
        F.expr("if(event_id % 2 = 0, 'geoblock', null)").alias("error_description"),
    )


def lane_responses(spark: SparkSession, root: str) -> DataFrame:
    """Model responses with header lines, one for each turn of the conversations."""
    return (
        table(spark, root, "conversations")
        .select(
            "conv_id",
            "turn",
            F.expr(
                "concat(case conv_id % 4 when 0 then concat('LANE: AUTHENTIC', chr(10)) "
                "when 1 then concat('lane: high-end', chr(10)) when 2 then concat('LANE: OTHER', chr(10)) else '' end, "
                "case turn % 3 when 0 then concat('TALKING: YES', chr(10), chr(10)) "
                "when 1 then concat('talking: no', chr(10)) else '' end, text)"
            ).alias("response"),
        )
    )


def section_responses(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "conversations")
        .select(
            "conv_id",
            "turn",
            F.expr(
                "concat(if(conv_id % 5 = 0, '', concat('ANALYSIS', chr(10))), 'summary ', cast(conv_id as string), chr(10), "
                "'PROMPT A | warm', chr(10), 'first body ', cast(turn as string), chr(10), "
                "case conv_id % 3 when 0 then concat('PROMPT B', chr(10), 'second body', chr(10)) "
                "when 1 then concat('PROMPT B | empty', chr(10)) else '' end)"
            ).alias("response"),
        )
    )


def job_events(log: DataFrame) -> DataFrame:
    """The registry log, from a batch or a stream of events."""
    return log.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.col("ts").alias("created_at"),
        F.expr(
            "case event_type when 'signup' then 'downloading' when 'view' then 'extracting_frames' "
            "when 'click' then 'processing' when 'purchase' then 'done' else 'error' end"
        ).alias("step"),
    )


def registry_log(log: DataFrame) -> DataFrame:
    """What events ask of the two registries. Any route may register an artifact, but only the upload route sweeps; a job's route does both.
    Some reads name a key that nothing registers."""
    kind = F.col("event_type")
    return log.select(
        F.inline(
            F.array(
                F.struct(F.lit("artifacts").alias("registry"), (kind == "signup").alias("sweeps"), kind.isin("signup", "purchase").alias("registers")),
                F.struct(F.lit("jobs").alias("registry"), (kind == "error").alias("sweeps"), (kind == "error").alias("registers")),
            )
        ),
        F.concat_ws("_", F.lit("key"), F.when((kind == "click") & (F.col("event_id") % 7 == 0), -1).otherwise(F.col("user_id") % 15).cast("string")).alias("key"),
        "event_id",
        F.col("ts").alias("at"),
        kind.isin("view", "click").alias("reads"),
    )


def metadata(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.expr(
            "case p_partkey % 5 when 0 then 'make' when 1 then 'model' when 2 then 'creation_time' "
            "when 3 then 'location' else 'x-evil' end"
        ).alias("key"),
        F.expr(
            "case p_partkey % 7 when 0 then null when 1 then '   ' when 2 then concat(' ', p_name, chr(10), p_brand, ' ') "
            "when 3 then repeat('z', 300) when 4 then concat(chr(9), chr(1)) else p_name end"
        ).alias("value"),
    )


def params(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("req_id"),
        F.expr(
            "case o_orderkey % 9 when 0 then null when 1 then '0' when 2 then '-4' when 3 then 'abc' when 4 then '6.7' "
            "when 5 then '12abc' when 6 then '' when 7 then '999' else cast(o_orderkey % 15 as string) end"
        ).alias("raw"),
    )


def gray_frames(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """One row per frame with its 32x32 gray values, row by row; fifteen frames make a clip. The short rows these come from may be
    dealt to `parts` tasks, however few files they lie in."""
    pixel = (
        "transform(sequence(0, {n}), i -> cast(floor(least(greatest(128e0 + 400e0 * cast(embedding[i div {side}] as double) "
        "* cast(embedding[{side} + i % {side}] as double), 0e0), 255e0)) as int))"
    ).format(n=FRAME_SIDE * FRAME_SIDE - 1, side=FRAME_SIDE)
    vectors = table(spark, root, "embeddings")
    if parts:
        vectors = vectors.select("vec_id", "embedding").repartition(parts, "vec_id")
    return vectors.select(
        F.expr("vec_id div 15").alias("video_id"),
        F.expr("cast(vec_id % 15 as int)").alias("frame_idx"),
        F.expr(pixel).alias("gray"),
    )


def edited_frames(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """Every frame three times: as it is (kind 0), brightened (1) and with a texture laid over (2)."""
    frames_ = gray_frames(spark, root, parts)
    edits = F.expr(
        "array(struct(0 as kind, gray as gray), "
        "struct(1 as kind, transform(gray, v -> cast(v + 5 as int)) as gray), "
        f"struct(2 as kind, transform(gray, (v, i) -> cast(v + 12 * ((7 * (i % {FRAME_SIDE}) + 13 * (i div {FRAME_SIDE})) % 5) as int)) as gray))"
    )
    return frames_.select("video_id", "frame_idx", F.inline(edits)).select(
        F.expr("video_id * 3 + kind").alias("clip_id"), "video_id", F.col("kind").cast("int"), "frame_idx", "gray"
    )
