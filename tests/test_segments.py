import random

from pyspark.sql import functions as F

from framefold.operators import scoring, segments
from framefold.streaming import fold


def by_hand(markers):
    """Results of a direct fold: frames, and segments as (id, first, last, count)."""
    collecting, out, number, inside = False, [], 0, []
    for k, m in enumerate(markers, 1):
        role, collecting = fold.fold(m, collecting)
        if role == "frame":
            out.append(("frame", k))
        if role == "open":
            number, inside = number + 1, []
        if role in ("open", "mid", "close"):
            inside.append(k)
        if role == "close":
            out.append(("segment", number, inside[0], inside[-1], len(inside)))
    return out


def test_windows_equal_the_fold(spark):
    rng = random.Random(1)
    streams = {f"s{k}": [rng.choice([None, None, "start", "end"]) for _ in range(rng.randrange(0, 40))] for k in range(60)}
    streams |= {"empty": [], "end first": ["end", "start", "end"], "twice": ["start", "start", None, "end", "end"], "open": ["start", None], "next": ["start", "end"]}
    rows = [(s, k, m, bytearray([k])) for s, ms in streams.items() for k, m in enumerate(ms, 1)]
    df = spark.createDataFrame(rows, "stream_id string, frame_id long, marker string, audio_data binary").withColumn("timestamp_ms", F.col("frame_id") * 32.0)
    roles = segments.with_roles(df, ["stream_id"]).cache()
    found = segments.segments(roles, ["stream_id"], audio="audio_data")
    got = {s: [] for s in streams}
    for r in roles.filter("role = 'frame'").collect():
        got[r.stream_id].append(("frame", r.frame_id))
    for r in found.collect():
        got[r.stream_id].append(("segment", r.segment_id, r.first_frame, r.last_frame, r.frame_count))
        assert len(r.audio_data) == r.frame_count and r.audio_data == bytearray(sorted(r.audio_data)) and r.duration_ms == (r.last_frame - r.first_frame) * 32
    assert {s: sorted(map(str, x)) for s, x in got.items()} == {s: sorted(map(str, by_hand(ms))) for s, ms in streams.items()}
    assert roles.count() == sum(map(len, streams.values()))  # each frame has one role
    later = segments.segments_audio(segments.segments(roles, ["stream_id"]), df, roles, ["stream_id"])
    audio = lambda x: sorted((r.stream_id, r.segment_id, bytes(r.audio_data)) for r in x.collect())
    assert audio(later) == audio(found)
    union = segments.results(roles, found)
    assert union.filter("(frame is null) = (segment is null)").count() == 0
    assert segments.only(union, "segment").count() == found.count()
    assert {r.stream_id for r in segments.open_segments(roles, ["stream_id"]).collect()} >= {"open"}


def test_hysteresis_equals_its_state_machine(spark):
    rng = random.Random(2)
    streams = {f"s{k}": [round(rng.random(), 2) for _ in range(50)] for k in range(40)}
    df = spark.createDataFrame([(s, k, p) for s, ps in streams.items() for k, p in enumerate(ps, 1)], "s string, k long, p double")
    got = {(r.s, r.k): r.marker for r in scoring.hysteresis_markers(df, "s", "k", "p", 0.5, 0.15, 3).filter("marker is not null").collect()}
    want = {}
    for s, ps in streams.items():
        marks, state = fold.EnergyMarks(0.5, 0.15, 96), {}
        for k, p in enumerate(ps, 1):
            if m := marks.mark(k, p, state):
                want[(s, k)] = m
    assert got == want


def test_scorers(spark):
    df = spark.createDataFrame([("a", 2, 0.2), ("a", 1, 0.1), ("b", 1, 0.9)], "stream_id string, frame_id long, p double")
    rows = scoring.model_score(df, scoring.scorer("column", None, "p")).collect()
    assert {(r.stream_id, r.frame_id): r.score for r in rows} == {("a", 1): 0.1, ("a", 2): 0.2, ("b", 1): 0.9}
    assert scoring.scorer_info("column")["available"]
