import random

import pytest
from pyspark.sql import functions as F

from framefold.operators import framing


def frames(spark, chunks):
    rows = spark.createDataFrame([("s", k, bytearray(c)) for k, c in enumerate(chunks)], "stream_id string, seq long, data binary")
    return [(r.frame_id, bytes(r.audio_data), r.timestamp_ms) for r in framing.aligned(rows).orderBy("frame_id").collect()]


@pytest.mark.parametrize("n, whole", [(0, 0), (1, 0), (1023, 0), (1024, 1), (1025, 1)])
def test_tails(spark, n, whole):
    assert len(frames(spark, [bytes(n)])) == whole


def test_chunking_does_not_matter(spark):
    rng = random.Random(5)
    data = rng.randbytes(7000)
    cuts = sorted(rng.sample(range(1, 7000), 12))
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, 7000])] + [b""]
    want = [(k + 1, data[k * 1024 : (k + 1) * 1024], (k + 1) * 32.0) for k in range(6)]
    assert frames(spark, parts) == want == frames(spark, [data])


def test_streams_do_not_mix(spark):
    rows = [(s, k, bytearray(bytes([k + 10 * n]) * 700)) for n, s in enumerate("ab") for k in range(3)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, data binary")
    got = {(r.stream_id, r.frame_id): bytes(r.audio_data) for r in framing.aligned(df).collect()}
    assert got[("b", 2)] == (bytes([10]) * 700 + bytes([11]) * 700 + bytes([12]) * 700)[1024:2048] and len(got) == 4


@pytest.mark.parametrize("n, kept, count", [(256000, 256000, 250), (256001, 128000, 125)])
def test_overflow_keeps_the_last_half(spark, n, kept, count):
    data = bytes(k % 251 for k in range(n))
    row = spark.createDataFrame([(bytearray(data),)], "data binary").select(framing.kept_tail(F.col("data")).alias("d")).select("d", F.size(framing.frames_of(F.col("d"))).alias("n")).first()
    assert bytes(row.d) == data[n - kept :] and row.n == count


def test_hops_and_sizes(spark):
    row = spark.range(1).select(framing.hops(F.sequence(F.lit(1), F.lit(10)), 3, 2).alias("h"), framing.frame_samples(F.lit(16), F.lit(22050)).alias("n"), framing.model_samples(F.lit(8000)).alias("m")).first()
    assert row.h == [[1, 2, 3, 4, 5], [4, 5, 6, 7, 8]] and row.n == 352 and row.m == 256
    assert framing.chunk_table(spark).filter("samples != formula_samples").collect()[0].samples == 353
    with pytest.raises(Exception, match="unsupported rate"):
        spark.range(1).select(framing.model_samples(F.lit(44100))).collect()
