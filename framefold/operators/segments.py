"""The two-state fold of start and end markers, without recursion.

The state before a row depends on the last marker before it alone: a start
that is ignored leaves the stream collecting, an ignored end leaves it idle.
So one window finds each row's role, and a running count of opened segments
names the segment. All windows and the grouping share one partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SAMPLE_RATE
from ..schemas import FRAME_STRUCT, SEGMENT_STRUCT
from .numbering import numbered

INSTANCE = "stream_processor"


def with_roles(frames: DataFrame, key: Sequence[str], order: str = "frame_id", marker: str = "marker") -> DataFrame:
    """frames with role (frame, open, mid, close or drop) and segment_id, from 1 in each stream."""
    run = Window.partitionBy(*key).orderBy(order)
    before = F.coalesce(F.last(marker, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit("end"))
    mark = F.col(marker)
    role = (
        F.when(mark.isNull(), F.when(F.col("__before") == "end", "frame").otherwise("mid"))
        .when((mark == "start") & (F.col("__before") == "end"), "open")
        .when((mark == "end") & (F.col("__before") == "start"), "close")
        .otherwise("drop")
    )
    rows = frames.withColumn("__before", before).withColumn("role", role).drop("__before")
    return rows.withColumn("segment_id", F.sum((F.col("role") == "open").cast("long")).over(run.rowsBetween(Window.unboundedPreceding, 0)))


def segments(roles: DataFrame, key: Sequence[str], order: str = "frame_id", time: str = "timestamp_ms", audio: str | None = None, open_too: bool = False) -> DataFrame:
    """Closed segments (open ones too if asked): bounds, frames, duration, and the audio in order if named.

    Without audio no binary is shuffled; segments_audio adds it later, where it is wanted.
    """
    inside = roles.filter(F.col("role").isin("open", "mid", "close") & (F.col("segment_id") > 0))
    at = F.col(order)
    more = []
    if audio:
        more = [F.aggregate(F.sort_array(F.collect_list(F.struct(order, audio))), F.lit(b""), lambda a, x: F.concat(a, x[audio])).alias("audio_data")]
    rows = inside.groupBy(*key, "segment_id").agg(
        F.min_by(time, at).alias("start_timestamp_ms"), F.max_by(time, at).alias("end_timestamp_ms"), F.count("*").alias("frame_count"), F.min(at).alias("first_frame"), F.max(at).alias("last_frame"),
        F.max((F.col("role") == "close").cast("int")).alias("__closed"), *more,
    )
    rows = rows if open_too else rows.filter("__closed = 1")
    return rows.drop("__closed").withColumn("duration_ms", duration(F.col("start_timestamp_ms"), F.col("end_timestamp_ms")))


def segments_audio(found: DataFrame, frames: DataFrame, roles: DataFrame, key: Sequence[str], order: str = "frame_id") -> DataFrame:
    """found with audio_data of the frames that belong to each segment."""
    own = roles.filter(F.col("role").isin("open", "mid", "close")).select(*key, "segment_id", order).join(found.select(*key, "segment_id"), [*key, "segment_id"], "left_semi")
    parts = frames.select(*key, order, "audio_data").join(own, [*key, order])
    audio = F.aggregate(F.sort_array(F.collect_list(F.struct(order, "audio_data"))), F.lit(b""), lambda a, x: F.concat(a, x["audio_data"]))
    return found.join(parts.groupBy(*key, "segment_id").agg(audio.alias("audio_data")), [*key, "segment_id"])


def in_results(roles: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of roles, the frames that results hold: single ones and those of closed segments."""
    ends = F.max((F.col("role") == "close").cast("int")).over(Window.partitionBy(*key, "segment_id"))
    inside = F.col("role").isin("open", "mid", "close") & (F.col("segment_id") > 0) & (F.col("__ends") == 1)
    return roles.withColumn("__ends", ends).filter((F.col("role") == "frame") | inside).drop("__ends")


def duration(start: Column, end: Column) -> Column:
    """end - start, a frame less than the audio; 0.0 of nothing."""
    return F.coalesce(end - start, F.lit(0.0))


def open_segments(roles: DataFrame, key: Sequence[str], order: str = "frame_id") -> DataFrame:
    """Segments with no end, which are discarded when a stream ends."""
    inside = roles.filter(F.col("role").isin("open", "mid", "close"))
    rows = inside.groupBy(*key, "segment_id").agg(F.count("*").alias("frame_count"), F.min(order).alias("first_frame"), F.max((F.col("role") == "close").cast("int")).alias("closed"))
    return rows.filter("closed = 0").drop("closed")


def results(roles: DataFrame, closed: DataFrame, key: str = "stream_id") -> DataFrame:
    """Frames and segments in one table (schemas.RESULT): exactly one of the two structs is set."""
    marker = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("value"))
    frame = F.struct("frame_id", "audio_data", "timestamp_ms", F.lit(None).cast("struct<kind:string,value:double>").alias("vad_result"), F.lit(SAMPLE_RATE).alias("sample_rate"), F.lit(512).alias("frame_size"))
    segment = F.struct("segment_id", "audio_data", "start_timestamp_ms", "end_timestamp_ms", "frame_count", marker("start").alias("start_vad_result"), marker("end").alias("end_vad_result"), F.lit(SAMPLE_RATE).alias("sample_rate"))
    stamp = [F.lit(None).cast("double").alias("processing_time_ms"), F.lit(INSTANCE).alias("instance_id")]
    single = roles.filter("role = 'frame'").select(key, F.lit("frame").alias("result_type"), frame.cast(FRAME_STRUCT).alias("frame"), F.lit(None).cast(SEGMENT_STRUCT).alias("segment"), *stamp)
    return single.union(closed.select(key, F.lit("segment").alias("result_type"), F.lit(None).cast(FRAME_STRUCT).alias("frame"), segment.cast(SEGMENT_STRUCT).alias("segment"), *stamp))


def only(rows: DataFrame, kind: str) -> DataFrame:
    """Results of one type: 'segment' or 'frame'."""
    return rows.filter(F.col("result_type") == kind)


def every_nth(rows: DataFrame, n: int, key: Sequence[str], order: str, part: Column | None = None) -> DataFrame:
    """Rows whose number in the stream is a multiple of n; part as in numbering.numbered, where a stream is too long for one task."""
    return numbered(rows, key, [order], part, "__n").filter(F.col("__n") % n == 0).drop("__n")
