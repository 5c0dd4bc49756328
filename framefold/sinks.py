"""Where results go: WAV bytes, JSON messages, latest rows, files and callbacks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .config import SAMPLE_BYTES, SAMPLE_RATE
from .functions.text import base64_line


def le_bytes(value: Column, size: int) -> Column:
    """A number as size little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def wav(audio: Column, rate: int = SAMPLE_RATE, channels: int = 1, width: int = SAMPLE_BYTES) -> Column:
    """A WAV file of 16-bit audio: the 44-byte header and the samples."""
    n = F.length(audio)
    text = lambda s: F.lit(s.encode())
    num = lambda v, size: F.lit(v.to_bytes(size, "little"))
    head = [text("RIFF"), le_bytes(n + 36, 4), text("WAVEfmt "), num(16, 4), num(1, 2), num(channels, 2), num(rate, 4), num(rate * channels * width, 4), num(channels * width, 2), num(8 * width, 2), text("data"), le_bytes(n, 4)]
    return F.concat(*head, audio)


def message(segment: str = "segment") -> Column:
    """The JSON message of a segment, its audio in base64."""
    s = F.col(segment)
    body = F.struct(F.lit("segment").alias("type"), s["segment_id"].alias("segment_id"), s["start_timestamp_ms"].alias("start_ms"), s["end_timestamp_ms"].alias("end_ms"), (s["end_timestamp_ms"] - s["start_timestamp_ms"]).alias("duration_ms"), base64_line(s["audio_data"]).alias("audio"))
    return F.to_json(body)


def error_message(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("type"), text.alias("message")))


def latest(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One row of each key, the last to arrive; a struct maximum, so no key is sorted in one task."""
    order = F.struct(*arrival)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_by_window(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The same by row numbers, for columns that a struct cannot hold."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in arrival]))
    return rows.withColumn("__n", number).filter("__n = 1").drop("__n")


def write_wavs(segments: DataFrame, path: str) -> None:
    """One Parquet row for each segment: name and the WAV file's bytes."""
    name = F.format_string("%s_%03d_%dms-%dms.wav", F.col("stream_id").cast("string"), "segment_id", F.col("start_timestamp_ms").cast("long"), F.col("end_timestamp_ms").cast("long"))
    segments.select(name.alias("name"), wav(F.col("audio_data")).alias("content")).write.mode("overwrite").parquet(path)


def iterate(results: DataFrame) -> Iterator[Row]:
    """Results one by one, a partition at a time on the driver."""
    return results.toLocalIterator()


def report(rows: DataFrame, order: str, n: int = 50) -> str:
    """An aligned table of the first n rows."""
    return rows.orderBy(order)._jdf.showString(n, 40, False)
