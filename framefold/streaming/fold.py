"""Stateful operators: reorder by seq, align frames, score, and fold markers.

State is keyed by stream and kept in the RocksDB store, so it outlives tasks
and executors. Rows may come in any order: only the contiguous prefix from the
expected seq is processed and later rows wait in a map state. The audio of an
open segment is a list state; all else is one small value.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_BYTES, FRAME_MS, CAP = 1024, 32.0, 256000
RESULT = "stream_id string, epoch long, result_type string, frame_id long, segment_id long, start_timestamp_ms double, end_timestamp_ms double, frame_count long, audio_data binary"
SEGMENT = "stream_id string, segment_id long, first_frame long, last_frame long, frame_count long"


def enable(spark: SparkSession) -> None:
    """The state store that these operators need, and its coordinator, which batch plans ask for as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark._jsparkSession.streams()  # starts the coordinator


class EnergyMarks:
    """Markers of frames by loudness: start at threshold, end after silence below threshold - gap. State is a dictionary."""

    def __init__(self, threshold: float = 0.5, gap: float = 0.15, min_silence_ms: float = 100, loud: float = 0.1) -> None:
        self.threshold, self.low, self.silence, self.loud = threshold, threshold - gap, math.ceil(min_silence_ms / FRAME_MS), loud

    def __call__(self, frame_id: int, audio: bytes, state: dict) -> str | None:
        samples = np.frombuffer(audio, "<i2").astype(np.float64) / 32768
        return self.mark(frame_id, min(1.0, math.sqrt(float((samples * samples).mean())) / self.loud), state)

    def configured(self, config: dict) -> EnergyMarks:
        """The same with a session's own threshold and silence, where it gives any."""
        threshold, silence = config.get("vad_threshold"), config.get("min_silence_duration_ms")
        if threshold is None and silence is None:
            return self
        made = EnergyMarks(self.threshold if threshold is None else threshold, self.threshold - self.low, 0, self.loud)
        made.silence = self.silence if silence is None else math.ceil(silence / FRAME_MS)
        return made

    def mark(self, frame_id: int, score: float, state: dict) -> str | None:
        if score >= self.threshold:
            state["quiet"] = None
            if not state.get("active"):
                state["active"] = True
                return "start"
        elif score < self.low and state.get("active"):
            if state.get("quiet") is None:
                state["quiet"] = frame_id
            if frame_id - state["quiet"] >= self.silence:
                state["active"], state["quiet"] = False, None
                return "end"
        return None


def fold(marker: str | None, collecting: bool) -> tuple[str, bool]:
    """The role of a frame and whether the stream collects after it."""
    if marker == "start":
        return ("drop", True) if collecting else ("open", True)
    if marker == "end":
        return ("close", False) if collecting else ("drop", False)
    return ("mid", True) if collecting else ("frame", False)


class Ordered(StatefulProcessor):
    """Hands rows to step() in the order of seq, from 0 or what first is."""

    first, payload = 0, "data binary"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "state string, buffer binary")
        self.waiting = handle.getMapState("waiting", "seq long", self.payload)
        self.audio = handle.getListState("audio", "audio binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.at.get()
        state = json.loads(kept[0]) if kept else {"next": self.first}
        state["buffer"] = bytes(kept[1]) if kept else b""
        names = [x.split()[0] for x in self.payload.split(", ")]
        here: dict[int, tuple] = {}
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for seq, *values in zip(part["seq"], *[part[n] for n in names]):
                if int(seq) >= state["next"]:
                    here.setdefault(int(seq), tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in values))
        out: list[tuple] = []
        while True:
            seq = state["next"]
            if seq in here:
                values = here.pop(seq)
            elif self.waiting.containsKey((seq,)):
                values = tuple(self.waiting.getValue((seq,)))
                self.waiting.removeKey((seq,))
            else:
                break
            state["next"] = seq + 1
            out += self.step(key[0], seq, values, state)
        for seq, values in here.items():
            self.waiting.updateValue((seq,), values)
        buffer = state.pop("buffer")
        self.at.update((json.dumps(state), buffer))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in self.schema.split(", ")])

    def close(self) -> None:
        pass


class MarkerFold(Ordered):
    """Rows (stream_id, seq from 1, marker) to closed segments."""

    first, payload, schema = 1, "marker string", SEGMENT

    def step(self, key: str, seq: int, values: tuple, state: dict) -> list[tuple]:
        role, state["collecting"] = fold(values[0], state.get("collecting", False))
        if role == "open":
            state["segment"], state["start"], state["count"] = state.get("segment", 0) + 1, seq, 0
        if role in ("open", "mid", "close"):
            state["count"] += 1
        return [(key, state["segment"], state["start"], seq, state["count"])] if role == "close" else []


class ByteFold(Ordered):
    """Session rows (stream_id, seq from 0, kind, config as JSON, data) to results.

    The config of a start holds until the next one; marks that have configured() take it. kind is data, start or stop; without a start a stream begins by itself. A start ends the old session with all of its
    state; data after a stop is ignored. The tail of a frame and an open segment at the end are dropped. Segment numbers
    begin anew in each session.
    """

    first, payload, schema = 0, "kind string, config string, data binary", RESULT

    def __init__(self, marks: Callable[[int, bytes, dict], str | None], cap: int = CAP, controlled: bool = False) -> None:
        self.marks, self.cap, self.controlled = marks, cap, controlled

    def step(self, key: str, seq: int, values: tuple, state: dict) -> list[tuple]:
        kind, config, data = values
        if kind in ("start", "stop"):
            epoch, following = state.get("epoch", 0), state["next"]
            state.clear()
            state.update(next=following, buffer=b"", epoch=epoch + (kind == "start"), live=kind == "start", config=json.loads(config) if kind == "start" and config else {})
            self.audio.clear()
            return []
        if not state.get("live", not self.controlled) or not data:
            return []
        buffer = state["buffer"] + bytes(data)
        if len(buffer) > self.cap:
            buffer = buffer[-(self.cap // 2) :]
        out = []
        for at in range(0, len(buffer) - FRAME_BYTES + 1, FRAME_BYTES):
            out += self.frame(key, buffer[at : at + FRAME_BYTES], state)
        state["buffer"] = buffer[len(buffer) // FRAME_BYTES * FRAME_BYTES :]
        return out

    def marks_of(self, state: dict) -> Callable[[int, bytes, dict], str | None]:
        config = state.get("config")
        return self.marks.configured(config) if config and hasattr(self.marks, "configured") else self.marks

    def frame(self, key: str, audio: bytes, state: dict) -> list[tuple]:
        number = state["frame"] = state.get("frame", 0) + 1
        time, epoch = number * FRAME_MS, state.get("epoch", 0)
        role, state["collecting"] = fold(self.marks_of(state)(number, audio, state.setdefault("marks", {})), state.get("collecting", False))
        if role == "frame":
            return [(key, epoch, "frame", number, None, time, time, 1, audio)]
        if role == "open":
            state["segment"], state["start"], state["count"] = state.get("segment", 0) + 1, time, 0
            self.audio.clear()
        if role in ("open", "mid", "close"):
            state["count"] += 1
            self.audio.appendValue((audio,))
        if role != "close":
            return []
        whole = b"".join(bytes(x[0]) for x in self.audio.get())
        self.audio.clear()
        return [(key, epoch, "segment", None, state["segment"], state["start"], time, state["count"], whole)]


def marker_segments(rows: DataFrame) -> DataFrame:
    """Streaming or batch rows (stream_id, seq, marker) to schemas of SEGMENT."""
    return rows.select("stream_id", "seq", "marker").groupBy("stream_id").transformWithStateInPandas(MarkerFold(), SEGMENT, "Append", "None")


def results(rows: DataFrame, marks: Callable[[int, bytes, dict], str | None] | None = None, cap: int = CAP) -> DataFrame:
    """Streaming or batch chunks (stream_id, seq, data) or session rows (with kind) to RESULT."""
    from pyspark.sql import functions as F

    controlled = "kind" in rows.columns
    rows = rows if controlled else rows.withColumn("kind", F.lit("data"))
    config = F.to_json("config") if "config" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("config", config)
    fold_ = ByteFold(marks or EnergyMarks(), cap, controlled)
    return rows.select("stream_id", "seq", "kind", "config", "data").groupBy("stream_id").transformWithStateInPandas(fold_, RESULT, "Append", "None")


def run_available(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming frame over what is available now into Parquet, and the rows written."""
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)
