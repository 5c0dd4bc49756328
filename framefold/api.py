"""The engine in one call: files, streams or chunks to results, with batch plans or a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import FormatError, InputError, StateError
from .operators import framing, scoring, segments
from .sources import files


class Engine:
    """A configured processor. open() before use, or a with statement. loud is the level that scores 1."""

    def __init__(self, spark: SparkSession, config: Config | None = None, loud: float = 0.1) -> None:
        self.spark, self.config, self.loud, self.is_open = spark, config or Config(), loud, False

    def open(self) -> Engine:
        self.is_open = True
        return self

    def close(self) -> None:
        self.is_open = False

    def __enter__(self) -> Engine:
        return self.open()

    def __exit__(self, *_: object) -> None:
        self.close()

    def of_frames(self, frames: DataFrame) -> DataFrame:
        """Results (schemas.RESULT) of aligned frames."""
        if not self.is_open:
            raise StateError("the engine is not open")
        # Scores alone go through the windows; audio meets its frame's role once, at the end.
        scored = scoring.energy_score(frames, loud=self.loud).select("stream_id", "frame_id", "score")
        marked = scoring.hysteresis_markers(scored, "stream_id", "frame_id", "score", self.config.vad_threshold, 0.15, scoring.silence_frames(self.config.min_silence_duration_ms))
        roles = segments.in_results(segments.with_roles(marked, ["stream_id"]), ["stream_id"]).select("stream_id", "frame_id", "role", "segment_id")
        found = frames.join(roles, ["stream_id", "frame_id"])
        return segments.results(found, segments.segments(found, ["stream_id"], audio="audio_data"))

    def from_files(self, path: str) -> DataFrame:
        """Results of every WAV file below a path."""
        rows = files.wav_files(self.spark, path)
        if rows.isEmpty():
            raise InputError(f"no WAV file at {path}")
        return self.of_frames(files.sample_frames(files.samples(rows)))

    def from_chunks(self, chunks: DataFrame) -> DataFrame:
        """Results of chunks (stream_id, seq, data) of any size."""
        return self.of_frames(framing.aligned(chunks))

    def from_bytes(self, data: bytes, stream_id: str = "chunk") -> DataFrame:
        """Results of one push; a tail of less than a frame is dropped."""
        one = self.spark.createDataFrame([(stream_id, 0, bytearray(data))], "stream_id string, seq long, data binary")
        return self.from_chunks(one.withColumn("data", framing.kept_tail(F.col("data"))))

    def from_stream(self, chunks: DataFrame) -> DataFrame:
        """Results of a streaming frame of chunks or session rows, row for row those of from_chunks."""
        from .streaming import fold

        if not self.is_open:
            raise StateError("the engine is not open")
        fold.enable(self.spark)
        return fold.results(chunks, fold.EnergyMarks(self.config.vad_threshold, 0.15, self.config.min_silence_duration_ms, self.loud))


def process_file(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Results of files; any failure to read them is a FormatError."""
    try:
        with Engine(spark, Config.of(**options)) as engine:
            return engine.from_files(path)
    except InputError as e:
        raise FormatError(e.message, cause=e.code) from e


def debug_info(spark: SparkSession) -> dict[str, object]:
    """Versions, scorers and the options that matter."""
    from . import __version__
    from .config import environment

    return environment() | {"version": __version__, "spark": spark.version, "scorers": [scoring.scorer_info(x) for x in scoring.SCORERS]}
