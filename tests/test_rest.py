import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framefold import api, config, errors, sinks
from framefold.operators import stats, validate
from framefold.sources import files, streams


def test_wav_there_and_back(spark, tmp_path):
    raw = np.append(np.sin(np.arange(3000) / 9) * 20000, np.zeros(2900)).astype("<i2").tobytes()
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000), f.writeframes(raw)
    body = (tmp_path / "a.wav").read_bytes()
    extra = body[:12] + b"LIST" + (5).to_bytes(4, "little") + b"abcde\0" + body[12:]
    (tmp_path / "b.wav").write_bytes(extra)
    (tmp_path / "c.wav").write_bytes(b"no such thing")
    rows = {r.path[-5:]: r for r in files.wav_files(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.wav"].payload) == raw == bytes(rows["b.wav"].payload) and rows["b.wav"].sample_rate == 16000
    assert rows["c.wav"].error and rows["c.wav"].payload is None
    made = bytes(spark.createDataFrame([(bytearray(raw),)], "d binary").select(sinks.wav(F.col("d"))).first()[0])
    with wave.open(io.BytesIO(made)) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(9999)) == (1, 2, 16000, raw)
    frames = files.sample_frames(files.samples(files.wav_files(spark, str(tmp_path), "a.wav")))
    assert frames.count() == 11 and api.process_file(spark, str(tmp_path), vad_threshold=0.4).count() > 0
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(errors.FormatError):
        api.process_file(spark, str(tmp_path / "empty"))


def test_options():
    with pytest.raises(errors.ConfigError):
        config.Config.of(buffer_size_seconds=3)
    for bad in ({"vad_threshold": 1.5}, {"max_instances": 0}, {"buffer_size_frames": 300}):
        with pytest.raises(errors.ConfigError):
            config.Config.of(**bad)
    for bad in ({"overlap_ms": 60, "chunk_duration_ms": 100}, {"speech_pad_ms": 600}, {"min_silence_duration_ms": 1001}, {"workers": 99}):
        with pytest.raises(errors.ConfigError):
            config.VADConfig.of(**bad)
    with pytest.raises(errors.ConfigError):
        config.AudioConfig.of(channels=2)
    assert config.Config().buffer_size_seconds == 2.048 and config.AudioConfig(sample_rate=22050).frame_size(16) == 352
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}
    assert str(config.Version.parse("1.2.3-x+y")) == "1.2.3-x+y" and not config.Version(1, 2, 3).is_compatible_with(config.Version(1, 3, 0))
    assert errors.error_info(ValueError("x"))["error_code"] == "E0000" and errors.InputError("y", path="p").to_dict()["context"] == {"path": "p"}


def test_stats(spark):
    made = spark.createDataFrame([("frame",), ("segment",), ("frame",)], "result_type string")
    pushed = spark.createDataFrame([(2.0, False), (4.0, False), (9.0, True)], "processing_time_ms double, error boolean")
    row = stats.processor_stats(made, pushed).first()
    assert (row.total_chunks_processed, row.average_processing_time_ms, row.error_rate, row.memory_usage_mb) == (2, 3.0, 0.5, 80.0) and row.speech_ratio == pytest.approx(1 / 3)
    none = stats.processor_stats(made.limit(0), pushed.limit(0)).first()
    assert none.speech_ratio == none.throughput_chunks_per_second == none.error_rate == 0.0


def test_validators(spark):
    rows = spark.createDataFrame([("pcma", 8000, 1), ("pcma", 16000, 1), ("wav", 16000, 2), (None, 1, 1)], "f string, r int, c int")
    got = rows.select(validate.format_ok(F.col("f"), F.col("r"), F.col("c")).alias("a"), validate.audio_config_ok(F.col("f"), F.col("r"), F.col("c"), F.lit("int16")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (True, False), (False, False)]
    bad = validate.checked(rows, F.col("r") > 1, "INVALID_SAMPLE_RATE", "rate").filter("error is not null").collect()
    assert len(bad) == 1 and bad[0].error.error_code == "E1002"
    with pytest.raises(Exception, match="too low"):
        validate.required(rows, F.col("r") > 1, "too low").collect()


def test_sinks_and_sources(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "k int, at int, v string")
    want = [(1, 3, "c"), (2, 1, None)]
    assert sorted(map(tuple, sinks.latest(rows, ["k"], ["at"]).collect())) == want == sorted(map(tuple, sinks.latest_by_window(rows, ["k"], ["at"]).collect()))
    assert files.silence(spark, 10).count() == 10 and files.tone(spark, 0.1).count() == 1600
    said = spark.createDataFrame([("c1", 0, '{"type": "start", "config": {"vad_threshold": 0.4}}', None), ("c1", 1, None, bytearray(b"xy"))], "client_id string, seq long, text string, data binary")
    got = streams.from_messages(said).orderBy("seq").collect()
    assert [r.kind for r in got] == ["start", "data"] and got[0].config.vad_threshold == 0.4
