"""Frames: tumbling and hopping windows counted in bytes or samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BUFFER_BYTES, CHUNK_MS, CHUNK_SAMPLES, FRAME_BYTES, FRAME_MS, FRAME_SAMPLES, MODEL_SAMPLES, SAMPLE_BYTES, SAMPLE_RATE
from ..functions.codecs import indices, let


def kept_tail(data: Column, cap: int = BUFFER_BYTES) -> Column:
    """What a buffer of cap bytes keeps of one push: all, or beyond cap the last half of cap."""
    return F.when(F.length(data) > cap, F.substring(data, F.length(data) - cap // 2 + 1, F.lit(cap // 2))).otherwise(data)


def frames_of(data: Column, size: int = FRAME_BYTES) -> Column:
    """The whole frames of a binary; a short tail is left out."""
    return F.transform(indices(F.floor(F.length(data) / size)), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def joined(chunks: DataFrame) -> DataFrame:
    """stream_id, data: each stream's chunks in the order of seq."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "data")))
    return chunks.groupBy("stream_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, F.coalesce(p["data"], F.lit(b"")))).alias("data"))


def aligned(chunks: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """stream_id, frame_id (from 1), audio_data, timestamp_ms, sample_rate, frame_size of chunks (stream_id, seq, data).

    Chunks of any size: a running sum of lengths gives each byte its place, and
    only frames that several chunks share are put together from their parts;
    others are cut out of their chunk where it is. So a long stream is never
    one value, and audio is shuffled once at most, to meet its place. Pushes beyond a buffer's cap are a matter of the streaming operator or of
    kept_tail; here nothing is dropped.
    """
    order = Window.partitionBy("stream_id").orderBy("seq")
    rows = chunks.select("stream_id", "seq", F.coalesce("data", F.lit(b"")).alias("data")).withColumn("n", F.length("data").cast("long"))
    lengths = rows.select("stream_id", "seq", "n").withColumn("at", F.sum("n").over(order) - F.col("n")).filter("n > 0")
    parts = rows.drop("n").join(lengths, ["stream_id", "seq"]).withColumn("frame", F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + n - 1) div {size}"))))
    start = F.greatest(F.col("frame") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("frame") + 1) * size - F.col("at"), F.col("n"))
    piece = F.substring("data", (start + 1).cast("int"), (end - start).cast("int"))
    whole = parts.filter(end - start == size).select("stream_id", (F.col("frame") + 1).alias("frame_id"), piece.alias("audio_data"))
    shared = parts.filter(end - start < size).select("stream_id", "frame", "seq", piece.alias("piece")).groupBy("stream_id", "frame").agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    audio = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    put_together = shared.select("stream_id", (F.col("frame") + 1).alias("frame_id"), audio.alias("audio_data")).filter(F.length("audio_data") == size)
    rows = whole.union(put_together)
    return rows.select("stream_id", "frame_id", "audio_data", timestamp(F.col("frame_id")).alias("timestamp_ms"), F.lit(SAMPLE_RATE).alias("sample_rate"), F.lit(FRAME_SAMPLES).alias("frame_size"))


def timestamp(frame_id: Column) -> Column:
    """The end of a frame; the first is at 32.0."""
    return frame_id * F.lit(FRAME_MS)


def gauges(data: Column, size: int = FRAME_BYTES, cap: int = BUFFER_BYTES) -> dict[str, Column]:
    """Of a buffer's bytes: samples, whole frames, what a next frame would leave, and the share of cap."""
    n = F.length(data)
    return {"available_samples": F.floor(n / SAMPLE_BYTES), "available_frames": F.floor(n / size), "rest_bytes": n % size, "usage_ratio": n / F.lit(float(cap))}


def hops(samples: Column, chunk: int, overlap: int) -> Column:
    """Windows of chunk + overlap samples every chunk samples; a short last one is left out."""
    count = F.floor((F.size(samples) - overlap) / chunk)
    return let(samples, lambda a: F.transform(indices(count), lambda i: F.slice(a, i * chunk + 1, F.lit(chunk + overlap))))


def frame_samples(ms: Column, rate: Column) -> Column:
    """Samples of a duration, truncated; unlike chunk_table, 352 at 16 ms and 22050 Hz."""
    return F.floor(ms * rate / 1000).cast("int")


def chunk_table(spark: SparkSession) -> DataFrame:
    """sample_rate, duration_ms, samples, formula_samples: the fixed table beside the formula."""
    rows = spark.createDataFrame([(r, ms, n) for r, ns in CHUNK_SAMPLES.items() for ms, n in zip(CHUNK_MS, ns)], "sample_rate int, duration_ms int, samples int")
    return rows.withColumn("formula_samples", frame_samples(F.col("duration_ms"), F.col("sample_rate")))


def model_samples(rate: Column) -> Column:
    """Samples that a model needs at once; an unknown rate raises."""
    known = F.create_map(*[x for k, v in MODEL_SAMPLES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[rate], F.raise_error(F.concat(F.lit("unsupported rate "), rate.cast("string"))).cast("int"))
