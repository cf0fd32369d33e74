"""Boxes found on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.skew import with_position

# Fixed value: a progress mark is due every so many frames, and on the last one.
MARK_EVERY = 20

def box_area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def largest_detection(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """The largest box of each frame (frame_id, readable), the earliest on ties; an unreadable frame has none.

    Boxes of equal size are folded first, then sizes; both steps run on plain numbers in hash aggregations.
    """
    edges = ("x1", "y1", "x2", "y2")
    by_size = detections.withColumn("area", box_area()).groupBy("frame_id", "area").agg(
        *[F.min_by(edge, "det_idx").alias(edge) for edge in edges], F.min("det_idx").alias("det_idx"), F.count("*").alias("boxes")
    )
    best = by_size.groupBy("frame_id").agg(
        F.sum("boxes").alias("boxes"), *[F.max_by(c, "area").alias(c) for c in ("det_idx", *edges)]
    )
    found = frames.select("frame_id", "readable").join(best, "frame_id", "left")
    seen = lambda c: F.when(F.col("readable"), F.col(c)).alias(c)
    return found.select(
        "frame_id",
        F.coalesce(seen("boxes"), F.lit(0)).cast("bigint").alias("boxes"),
        *[seen(c) for c in ("det_idx", *edges)],
    )


def detection_coverage(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames with a box against all frames, per job; an unreadable frame counts as one without."""
    found = detections.select("frame_id").distinct().withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False)) & F.col("readable")
    return (
        frames.join(found, "frame_id", "left")
        .groupBy("job_id")
        .agg(F.count("*").alias("total"), F.count_if(hit).alias("swappable"))
        .withColumn("coverage", F.round(F.col("swappable") / F.col("total"), 6))
    )


def progress_marks(frames: DataFrame, every: int = MARK_EVERY) -> DataFrame:
    """`i/total` for every 20th frame of a job and for its last, unless that frame is unreadable and skipped."""
    placed = with_position(frames, ["job_id"], ["frame_id"], [F.expr("frame_id div 65536")], "place")
    totals = frames.groupBy("job_id").agg(F.count("*").alias("total"))
    done = F.col("place") + 1
    due = placed.select("job_id", "readable", done.alias("done")).join(totals, "job_id")
    return due.filter(F.col("readable") & ((F.col("done") % every == 0) | (F.col("done") == F.col("total")))).select(
        "job_id", "done", "total", F.format_string("%d/%d frames", "done", "total").alias("mark")
    )
