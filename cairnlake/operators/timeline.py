"""Media timelines: segments, clips and point-in-interval lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_times(segments: DataFrame) -> DataFrame:
    """Segments with their start: the running sum of the durations before."""
    w = Window.partitionBy("video").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum("duration").over(w), F.lit(0)))


def segments_at(segments: DataFrame, points: DataFrame, bin_size: int) -> DataFrame:
    """(video, at, idx): the segment [start, start + duration) that each point (video, at) lies in.

    Intervals are cut into bins of ``bin_size`` and joined by bin, so no video's segments are compared with all of its
    points; segments of no length hold no point.
    """
    s = start_times(segments).where("duration > 0").withColumn("end", F.col("start") + F.col("duration"))
    binned = s.select("video", "idx", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("bin"))
    return points.withColumn("bin", F.floor(F.col("at") / bin_size)).join(binned, ["video", "bin"]).where("at >= start and at < end").select("video", "at", "idx")


def segment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(video, idx): segments that are new or differ in id at their place; removed ones are not told."""
    o = old.select("video", "idx", F.col("segment_id").alias("was"))
    return new.join(o, ["video", "idx"], "left").where(~F.col("segment_id").eqNullSafe(F.col("was"))).select("video", "idx")


def track_durations(clips: DataFrame) -> DataFrame:
    """(project, track, duration, n_clips): the latest end of a track's clips (start + out - in)."""
    end = F.col("start") + F.col("out_point") - F.col("in_point")
    return clips.groupBy("project", "track").agg(F.max(end).alias("duration"), F.count(F.lit(1)).alias("n_clips"))


def clip_order(clips: DataFrame) -> DataFrame:
    """Clips in order of their start, with the gap to the one before (negative: they overlap)."""
    w = Window.partitionBy("project", "track").orderBy("start", "clip")
    end = F.col("start") + F.col("out_point") - F.col("in_point")
    return clips.select("project", "track", "clip", F.row_number().over(w).alias("nth"), (F.col("start") - F.lag(end).over(w)).alias("gap"))


def bandwidth_mbps(n_bytes: Column, ms: Column) -> Column:
    """Megabits a second (null for no time)."""
    return F.try_divide(n_bytes * 8, ms / 1000 * 1e6)
