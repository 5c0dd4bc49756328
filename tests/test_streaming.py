import json
import math
import random

import numpy as np

from framefold.api import Engine
from framefold.sources import streams
from framefold.streaming import fold


def signal(seed, n=24):
    """Frames of 16-bit noise, loud or quiet by turns."""
    rng = np.random.default_rng(seed)
    loud = np.repeat(rng.random(n // 4) < 0.5, 4)
    return b"".join((rng.normal(0, 0.3 if x else 0.001, 512).clip(-1, 1) * 32767).astype("<i2").tobytes() for x in loud)


def chunks(data, seed):
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(data)), 9))
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]


def test_stream_equals_batch(spark, tmp_path):
    streams = {f"s{k}": signal(k) for k in range(3)}
    rows = [(s, k, bytearray(c)) for s, d in streams.items() for k, c in enumerate(chunks(d, 3))]
    random.Random(4).shuffle(rows)
    schema = "stream_id string, seq long, data binary"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with Engine(spark) as engine:
        live = fold.run_available(engine.from_stream(source), f"{tmp_path}/out", f"{tmp_path}/state")
        batch = engine.from_chunks(spark.createDataFrame(rows, schema))
        got = sorted((r.stream_id, r.result_type, r.start_timestamp_ms, r.end_timestamp_ms, bytes(r.audio_data)) for r in live.collect())
        want = []
        for r in batch.collect():
            x = r.frame or r.segment
            times = (x.timestamp_ms, x.timestamp_ms) if r.frame else (x.start_timestamp_ms, x.end_timestamp_ms)
            want.append((r.stream_id, r.result_type, *times, bytes(x.audio_data)))
    assert got == sorted(want) and any(x[1] == "segment" for x in got)


def test_sessions(spark):
    quiet, loud = bytes(1024), (np.ones(512) * 20000).astype("<i2").tobytes()
    rows = [("a", 0, "data", loud), ("a", 1, "start", None), ("a", 2, "data", loud + quiet * 5), ("a", 3, "start", None), ("a", 4, "data", loud + quiet * 5), ("a", 5, "stop", None), ("a", 6, "data", loud)]
    df = spark.createDataFrame([(s, k, kind, bytearray(d) if d else None) for s, k, kind, d in rows], "stream_id string, seq long, kind string, data binary")
    got = [(r.epoch, r.segment_id, r.frame_count) for r in fold.results(df).filter("result_type = 'segment'").orderBy("epoch").collect()]
    n = math.ceil(100 / 32) + 2
    assert got == [(1, 1, n), (2, 1, n)]


def test_overflow_in_a_stream(spark):
    data = bytes(256001)
    df = spark.createDataFrame([("a", 0, bytearray(data))], "stream_id string, seq long, data binary")
    assert fold.results(df).count() == 125


def test_engine_on_one_push(spark):
    with Engine(spark) as engine:
        assert engine.from_bytes(bytes(1023)).count() == 0
        assert engine.from_bytes(bytes(2050)).count() == 2


def test_a_start_brings_its_config(spark):
    quiet, loud = bytes(1024), (np.ones(512) * 20000).astype("<i2").tobytes()
    soft = (np.ones(512) * 1000).astype("<i2").tobytes()
    config = lambda **k: json.dumps({"type": "start", "config": k})
    rows = [
        ("new", "c1", 0, config(min_silence_duration_ms=320), None), ("new", "c1", 1, None, loud + quiet * 20), ("new", "c1", 2, config(vad_threshold=0.2), None), ("new", "c1", 3, None, soft + quiet * 20),
        ("new", "c2", 0, config(), None), ("new", "c2", 1, None, soft + quiet * 20), ("new", "c2", 2, None, loud + quiet * 20),
    ]
    said = spark.createDataFrame([(c, n, k, t, bytearray(d) if d else None) for c, n, k, t, d in rows], "client_id string, connection string, seq long, text string, data binary")
    sessions = streams.from_messages(said)
    ids = {r.stream_id for r in sessions.select("stream_id").distinct().collect()}
    got = sorted((r.epoch, r.frame_count) for r in fold.results(sessions).filter("result_type = 'segment'").collect())
    # Silence of 320 ms is 10 frames, the default 4; a soft sound is heard from 0.2 on.
    assert len(ids) == 2 and got == sorted([(1, 12), (2, 6), (1, 6)])
