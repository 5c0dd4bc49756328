"""Markers: where activity starts and ends, from a score of each frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BackendConfig, ONNXConfig
from ..errors import BackendUnavailable, ModelError, StreamError
from ..functions.codecs import pcm16_rms

#: A scorer: rows of one stream in order, in blocks, to one probability each. State is its own.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.Series]]


def threshold_marker(score: Column, start: float, end: float) -> Column:
    """'start' from start on, 'end' below end, null between."""
    return F.when(score >= start, "start").when(score < end, "end")


def marker_kind(start: Column, end: Column) -> Column:
    """The kind of a raw marker with either field; a start wins, and neither is none."""
    return F.when(start.isNotNull(), "start").when(end.isNotNull(), "end")


def silence_frames(min_silence_ms: float, frame_ms: float = 32.0) -> int:
    return math.ceil(min_silence_ms / frame_ms)


def hysteresis_markers(frames: DataFrame, key: str, order: str, score: str, threshold: float = 0.5, gap: float = 0.15, frames_of_silence: int = 4) -> DataFrame:
    """frames with marker: start at a score of threshold; end once scores were below threshold - gap, and never
    again at threshold, for frames_of_silence frames. Windows over one partitioning: a single shuffle."""
    low = threshold - gap
    by = Window.partitionBy(key)
    run = by.orderBy(order)
    rows = frames.withColumn("__island", F.sum((F.col(score) >= threshold).cast("int")).over(run))
    per = Window.partitionBy(key, "__island")
    quiet = F.when((F.col(score) < low) & (F.col("__island") > 0), F.col(order))
    rows = rows.withColumn("__quiet", F.min(quiet).over(per))
    ends = F.when((F.col(score) < low) & (F.col(order) - F.col("__quiet") >= frames_of_silence), F.col(order))
    rows = rows.withColumn("__end", F.min(ends).over(per))
    before = F.lag("__end").over(run)
    begins = (F.col(score) >= threshold) & ((F.col("__island") == 1) | before.isNotNull())
    marker = F.when(begins, "start").when(F.col(order) == F.col("__end"), "end")
    return rows.withColumn("marker", marker).drop("__island", "__quiet", "__end")


def energy_score(frames: DataFrame, audio: str = "audio_data", loud: float = 0.1) -> DataFrame:
    """frames with score: root mean square of the samples over loud, 1 at most."""
    return frames.withColumn("score", F.least(pcm16_rms(F.col(audio)) / F.lit(loud), F.lit(1.0)))


def model_score(frames: DataFrame, scorer: Scorer, key: str = "stream_id", order: str = "frame_id") -> DataFrame:
    """frames with score of a model whose state runs through each stream: one task a stream, in order."""
    kind = frames.select("*", F.lit(0.0).alias("score")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(score=pd.concat(list(scorer(iter([rows])))).to_numpy(float))

    return frames.groupBy(key).applyInPandas(run, kind)


def probability(output: Column) -> Column:
    """Of a model's output row: the second of two values, else the first."""
    return F.when(F.size(output) == 2, output[1]).otherwise(output[0])


def verdict(score: Column, threshold: float) -> dict[str, Column]:
    """is_speech, from the threshold on, and how sure that is."""
    speech = score >= threshold
    return {"is_speech": speech, "confidence": F.when(speech, score).otherwise(1.0 - score)}


def marker_probability(kind: Column, given: Column) -> Column:
    """Of an iterator's marker: 1.0 at a start or end, else what it gives, else 0.0."""
    return F.when(kind.isNotNull(), 1.0).otherwise(F.coalesce(given, F.lit(0.0)))


def onnx_scorer(config: ONNXConfig, column: str = "samples") -> Scorer:
    """A scorer with one session for each Python worker; the file is needed where it runs."""
    sessions: dict[str, object] = {}

    def session():
        if not sessions:
            try:
                import onnxruntime

                made = onnxruntime.InferenceSession(config.model_path, providers=list(config.providers))
            except Exception as e:
                raise ModelError(f"cannot load {config.model_path}: {e}") from e
            if len(made.get_inputs()) != 1 or len(made.get_outputs()) != 1:
                raise ModelError("a model of one input and one output is needed")
            import numpy as np

            shape = [d if isinstance(d, int) else 1 for d in made.get_inputs()[0].shape]
            for _ in range(config.warmup_iterations):
                made.run(None, {made.get_inputs()[0].name: np.zeros(shape, np.float32)})
            sessions["one"] = made
        return sessions["one"]

    def scorer(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        import numpy as np

        for rows in blocks:
            model = session()
            name = model.get_inputs()[0].name
            out = [np.ravel(model.run(None, {name: np.asarray(x, np.float32).reshape(1, -1)})[0]) for x in rows[column]]
            yield pd.Series([float(x[1] if len(x) == 2 else x[0]) for x in out], index=rows.index)

    return scorer


def column_scorer(config: BackendConfig | None = None, column: str = "score") -> Scorer:
    """The deterministic scorer: a numeric column as it is."""
    return lambda blocks: (rows[column].astype(float) for rows in blocks)


#: Scorers by name.
SCORERS: dict[str, Callable[..., Scorer]] = {"onnx": onnx_scorer, "column": column_scorer}


def scorer(name: str, *args: object) -> Scorer:
    if name not in SCORERS:
        raise BackendUnavailable(f"no scorer {name}", known=sorted(SCORERS))
    return SCORERS[name](*args)


def scorer_info(name: str) -> dict[str, object]:
    """What a scorer is and whether its library is here."""
    try:
        if name == "onnx":
            import onnxruntime

            return {"name": name, "available": True, "version": onnxruntime.__version__, "providers": onnxruntime.get_available_providers()}
        return {"name": name, "available": name in SCORERS, "version": None, "providers": []}
    except (ImportError, StreamError) as e:
        return {"name": name, "available": False, "version": None, "providers": [], "error": str(e)}
