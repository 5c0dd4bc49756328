"""Files as streams: WAV through the binary reader, split into frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FRAME_BYTES, FRAME_SAMPLES, SAMPLE_RATE
from ..functions.codecs import alaw_to_float, float_to_int16, indices, int8_to_float, ints_to_pcm16, pcm16_to_float, resample
from ..operators.framing import timestamp


def little_endian(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned number of size bytes at a place counted from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.substring(data, at + k + 1, F.lit(1)) for k in reversed(range(size))]
    return F.conv(F.hex(F.concat(*parts)), 16, 10).cast("long")


def wav_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, format (1: PCM, 6: A-law), channels, sample_rate, bits, payload of every WAV file; error names what is wrong.

    The chunks of the file are walked by an aggregate, so extra ones before the payload do no harm.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parsed_wav(files.select("path", "content"))


def parsed_wav(files: DataFrame, most_chunks: int = 64) -> DataFrame:
    content = F.col("content")
    state = "struct<at:long,fmt:long,data:long,size:long>"
    start = F.struct(F.lit(12).alias("at"), F.lit(-1).alias("fmt"), F.lit(-1).alias("data"), F.lit(0).alias("size")).cast(state)

    def step(s: Column, _: Column) -> Column:
        size = little_endian(content, s["at"].cast("int") + 4, 4)
        name = F.substring(content, s["at"].cast("int") + 1, F.lit(4)).cast("string")
        is_data = name == "data"
        here = F.struct(
            (s["at"] + 8 + size + size % 2).alias("at"), F.when(name == "fmt ", s["at"] + 8).otherwise(s["fmt"]).alias("fmt"),
            F.when(is_data, s["at"] + 8).otherwise(s["data"]).alias("data"), F.when(is_data, F.least(size, F.length(content) - s["at"] - 8)).otherwise(s["size"]).alias("size"),
        )
        return F.when((s["data"] >= 0) | (s["at"] + 8 > F.length(content)), s).otherwise(here.cast(state))

    is_wav = (F.substring(content, 1, 4).cast("string") == "RIFF") & (F.substring(content, 9, 4).cast("string") == "WAVE")
    rows = files.withColumn("w", F.when(is_wav, F.aggregate(F.sequence(F.lit(1), F.lit(most_chunks)), start, step)))
    ok = F.coalesce((F.col("w.fmt") >= 0) & (F.col("w.data") >= 0), F.lit(False))
    field = lambda at, size: F.when(ok, little_endian(content, F.col("w.fmt").cast("int") + at, size)).cast("int")
    return rows.select(
        "path", field(0, 2).alias("format"), field(2, 2).alias("channels"), field(4, 4).alias("sample_rate"), field(14, 2).alias("bits"),
        F.when(ok, F.substring(content, F.col("w.data").cast("int") + 1, F.col("w.size").cast("int"))).alias("payload"), F.when(~ok, "not a WAV file").alias("error"),
    )


def samples(wavs: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """stream_id and samples (floats at rate) of mono WAV rows; other rows are left out."""
    value = F.when((F.col("format") == 1) & (F.col("bits") == 16), pcm16_to_float(F.col("payload")))
    bytes_ = F.transform(indices(F.length("payload")), lambda k: F.conv(F.hex(F.substring("payload", k + 1, F.lit(1))), 16, 10).cast("int"))
    value = value.when((F.col("format") == 1) & (F.col("bits") == 8), int8_to_float(bytes_)).when(F.col("format") == 6, alaw_to_float(bytes_))
    rows = wavs.filter(F.col("error").isNull() & (F.col("channels") == 1)).select(F.col("path").alias("stream_id"), "sample_rate", value.alias("raw")).filter("raw is not null")
    known = [8000, 16000, 22050, 44100, 48000]
    out = F.when(F.col("sample_rate") == rate, F.col("raw"))
    for other in known:
        out = out if other == rate else out.when(F.col("sample_rate") == other, resample(F.col("raw"), other, rate))
    return rows.select("stream_id", out.alias("samples")).filter("samples is not null")


def sample_frames(rows: DataFrame, size: int = FRAME_SAMPLES) -> DataFrame:
    """Frames of 16-bit audio from float samples; a short tail is left out."""
    ids = F.posexplode(F.transform(indices(F.floor(F.size("samples") / size)), lambda i: F.slice("samples", i * size + 1, F.lit(size))))
    frames = rows.select("stream_id", ids.alias("pos", "part"))
    frame_id = (F.col("pos") + 1).cast("long")
    return frames.select("stream_id", frame_id.alias("frame_id"), ints_to_pcm16(float_to_int16(F.col("part"))).alias("audio_data"), timestamp(frame_id).alias("timestamp_ms"), F.lit(SAMPLE_RATE).alias("sample_rate"), F.lit(size).alias("frame_size"))


def chunked(rows: DataFrame, size: int = 4096, data: str = "payload", stream: str = "path") -> DataFrame:
    """A payload as chunks (stream_id, seq, data) of size bytes, the last one short: a file played as a stream."""
    n = F.ceil(F.length(data) / size)
    parts = F.posexplode(F.transform(indices(n), lambda i: F.substring(data, i * size + 1, F.lit(size))))
    return rows.select(F.col(stream).alias("stream_id"), parts.alias("seq", "data")).withColumn("seq", F.col("seq").cast("long"))


def tone(spark: SparkSession, seconds: float, rate: int = SAMPLE_RATE, seed: int = 0) -> DataFrame:
    """id, sample: 0.3 sin 440 Hz + 0.2 sin 880 Hz + a little noise, of a seed."""
    angle = lambda hz: F.sin(2 * F.pi() * hz * F.col("id") / rate)
    return spark.range(int(seconds * rate)).select("id", (0.3 * angle(440) + 0.2 * angle(880) + 0.01 * F.randn(seed)).cast("float").alias("sample"))


def silence(spark: SparkSession, chunks: int, size: int = FRAME_BYTES, stream: str = "silence") -> DataFrame:
    """Chunks of zero bytes."""
    return spark.range(chunks).select(F.lit(stream).alias("stream_id"), F.col("id").alias("seq"), F.unhex(F.repeat(F.lit("00"), size)).alias("data"))
