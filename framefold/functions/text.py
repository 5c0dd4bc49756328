"""Renderings and small values as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_line(data: Column) -> Column:
    """base64 without line ends."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def seconds(ms: Column) -> Column:
    """Milliseconds as s.mmms."""
    return F.format_string("%d.%03ds", F.floor(ms / 1000).cast("long"), F.pmod(F.floor(ms).cast("long"), F.lit(1000)))


def segment_file(prefix: str, number: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.format_string(f"{prefix}_%03d_%dms-%dms.wav", number, start_ms.cast("long"), end_ms.cast("long"))


def version_part(text: Column, part: str) -> Column:
    """major, minor, patch (int), pre or build (null if absent) of a version; null of anything else."""
    rest, build = F.substring_index(text, "+", 1), F.substring(text, F.instr(text, "+") + 1, F.length(text))
    core, pre = F.substring_index(rest, "-", 1), F.substring(rest, F.instr(rest, "-") + 1, F.length(rest))
    has_build, has_pre, numbers = F.contains(text, F.lit("+")), F.contains(rest, F.lit("-")), F.split(core, "[.]", -1)
    fine = (F.size(numbers) == 3) & F.forall(numbers, lambda n: (F.length(n) > 0) & (F.translate(n, "0123456789", "") == ""))
    fine = fine & (~has_build | (build != "")) & (~has_pre | (pre != ""))
    value = {"pre": F.when(has_pre, pre), "build": F.when(has_build, build)}.get(part)
    return F.when(fine, value if value is not None else numbers[("major", "minor", "patch").index(part)].try_cast("int"))


def version_compatible(own: Column, other: Column) -> Column:
    """Same major version, and own is not older in the rest."""
    rest = lambda t: F.struct(version_part(t, "minor").alias("a"), version_part(t, "patch").alias("b"))
    return (version_part(own, "major") == version_part(other, "major")) & (rest(own) >= rest(other))


def frame_text(frame_id: Column, timestamp_ms: Column, marker: Column) -> Column:
    return F.format_string("frame %d at %.1f ms (%s)", frame_id, timestamp_ms, F.coalesce(marker, F.lit("none")))


def segment_text(segment_id: Column, start_ms: Column, end_ms: Column, frames: Column) -> Column:
    return F.format_string("segment %d from %.1f ms to %.1f ms, %d frames", segment_id, start_ms, end_ms, frames)


def stats_text(chunks: Column, segments: Column, mean_ms: Column) -> Column:
    return F.format_string("%d chunks, %d segments, %.1f ms each", chunks, segments, mean_ms)


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps; right wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
