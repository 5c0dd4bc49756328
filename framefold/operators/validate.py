"""Checks of rows as boolean expressions, and the error struct of those that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RATES
from ..errors import error_column


def format_ok(form: Column, rate: Column, channels: Column) -> Column:
    """pcma takes 8000 Hz mono alone here; audio_config_ok is wider in rate and narrower in channels."""
    base = form.isin("wav", "pcma") & rate.isin(RATES) & channels.isin(1, 2)
    return F.coalesce(base & ((form != "pcma") | ((rate == 8000) & (channels == 1))), F.lit(False))


def audio_config_ok(form: Column, rate: Column, channels: Column, dtype: Column) -> Column:
    base = form.isin("wav", "pcma") & rate.isin(RATES) & (channels == 1) & dtype.isin("float32", "float64", "int16", "int32")
    return F.coalesce(base & ((form != "pcma") | rate.isin(8000, 16000)), F.lit(False))


def chunk_ok(samples: Column, chunk: Column, overlap: Column, rate: Column) -> Column:
    """Some samples, a rate, and an overlap below the chunk."""
    return F.coalesce((F.size(samples) > 0) & (rate > 0) & (chunk > 0) & (overlap >= 0) & (overlap < chunk), F.lit(False))


def timing_ok(chunk_ms: Column, overlap_ms: Column, pad_ms: Column, silence_ms: Column, compensation_ms: Column) -> Column:
    return (overlap_ms < chunk_ms * 0.5) & (pad_ms <= chunk_ms) & (silence_ms <= 2 * chunk_ms) & (compensation_ms <= chunk_ms)


def interval_ok(start_ms: Column, end_ms: Column) -> Column:
    return end_ms > start_ms


def capacity_ok(seconds: Column, channels: Column) -> Column:
    return (seconds > 0) & (seconds <= 300) & (channels == 1)


def buffer_ok(available: Column, capacity: Column) -> Column:
    return (available >= 0) & (available <= capacity)


def buffer_healthy(level: Column, overflows: Column) -> Column:
    return (level != "critical") & (overflows == 0)


def confident(confidence: Column, least: float = 0.8) -> Column:
    return confidence >= least


def speech_share(is_speech: Column, probability: Column) -> Column:
    return F.when(is_speech, probability).otherwise(0.0)


def chunk_times(timestamp_ms: Column, size: Column, overlap: Column, rate: Column) -> dict[str, Column]:
    """duration_ms and end_ms of the chunk without its overlap, and total_size with it."""
    length = size * F.lit(1000.0) / rate
    return {"duration_ms": length, "end_ms": timestamp_ms + length, "total_size": size + overlap}


def checked(rows: DataFrame, ok: Column, name: str, message: str) -> DataFrame:
    """rows with error, null where ok."""
    return rows.withColumn("error", error_column(name, F.lit(message), "medium", ~F.coalesce(ok, F.lit(False))))


def required(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """rows; a row that is not ok fails the query."""
    return rows.filter(F.coalesce(F.assert_true(ok, message).cast("boolean"), F.lit(True)))
